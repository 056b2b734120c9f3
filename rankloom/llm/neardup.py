"""Near-duplicates by BagMinHash: weighted-Jaccard signatures, banding, and verification of every candidate.

A text is the multiset of its five-word shingles (a text of one to four words has one shingle, its words).  Weights are
discretised to units, and the weight axis of a shingle is a hierarchy of intervals [0, 1), [1, 2), [2, 4), [4, 8), ...
Each interval has a Poisson process of its own, seeded by shingle and level, whose rate is the interval's width; a point
also has a place on the weight axis, and belongs to all texts in which the shingle's weight reaches beyond that place.
Every point falls on one of ``COMPONENTS`` components, and a component keeps its earliest point, so that two texts agree
in a component with a probability of their weighted Jaccard similarity.  Points are made lazily: a process stops once its
next point is later than all components of its text.

1. Texts with equal words are one node.
2. Nodes that agree in all components of a band meet.  A band's centre is its node that meets most others in all of its
   bands (a text that the others are edits of does), and every other node is compared with the centre: as many candidates
   as nodes, whatever the sizes of the groups.
3. Candidates are verified on whole texts: sum of minima over sum of maxima of the shingles' counts at least ``LEAST``.
   Verified links give components.
4. Two nodes of a band in different components can still be linked, although one of them, x, failed against the centre c.
   What they differ in from c tells: if D(x) is the multiset of shingles in which x and c differ, and |x| the number of its
   shingles, x and y are linked if and only if |D(x)| + |D(y)| - 2 |D(x) and D(y)| <= g (|x| + |y|) with
   g = (1 - LEAST) / (1 + LEAST).  So they share at least (alpha(x) + alpha(y)) / 2 differences, with alpha(x) = |D(x)| - g |x|.
   Differences that no other such node has can't be shared and are set aside; a prefix filter over the others, ordered by the
   number of nodes that have them, asks of each pair what that pair must share, and up to ``SEVERAL`` of it in the prefixes,
   each that much longer.  It misses no link, and edits that others haven't made, or that too many have, meet nobody.
   Nodes whose bound is 0 or less are linked.
   Where up to ``FEW`` nodes outside the centre's component have a difference, they are compared with all that have it, a
   pair at a time.  A difference of more nodes counts only where a node has as many such as a pair must share; the nodes that
   it then brings together are a new band with a centre of its own, and go through 2 to 4 again, until no such band is left.
   A node's hub is its centre that meets most; two nodes with the same hub are left to that.
5. Components again; a class is named by its smallest doc_id.

At a similarity of 0.8 two texts share a band with a probability of 1 - (1 - 0.8 ** 5) ** 25 = 0.99995; no step after that
loses a link.  Joins on a node, a centre or a band salt what is hot.
Rules for odd rows: a text without words (null, empty) is in a class of its own; repeated rows and equal texts are one class;
a null doc_id comes after all others, and a class of only such has a null id; an empty table gives no rows; further columns
don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import column, grams, mix64, of_texts, ranges, slabs, window_bounds
from .runtime import Hot, count_by, mapped, prepare, written

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 25, 5
COMPONENTS = BANDS * ROWS
#: Up to so many open nodes with a common difference are compared with all that have it; more get a centre of their own.
FEW = 128
#: A pair that must share so many differences or more is a candidate only if its prefixes share so many.
SEVERAL = 8
#: Up to so many links (16 MB) are joined up by one task.
ONE_TASK = 500_000
#: Words of the filter that marks involved nodes, 63 bits of each, and of the one that has a byte for a difference: 16 MiB,
#: whatever the number of nodes.
SLOTS = 1 << 21
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle of some texts."""
    starts, doc = window_bounds(bounds, size)
    whole = grams(hashes, size)[starts] if len(starts) else np.zeros(0, _U)
    few = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < size))
    short = np.array([int(grams(hashes[bounds[i] : bounds[i + 1]], bounds[i + 1] - bounds[i], 5)[0]) for i in few], dtype=_U)
    return np.concatenate([whole, short]), np.concatenate([doc, few])


def counted(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, weight) of the different shingles of each text."""
    order = np.argsort(hashes)
    # Numbers of 16 bits are sorted by radix; a slab seldom has more texts.
    small = doc.astype(np.uint16) if doc.max(initial=0) < 1 << 16 else doc
    order = order[np.argsort(small[order], kind="stable")]
    h, d = hashes[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[new], d[new], np.diff(np.append(new, len(h)))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from 53 bits."""
    return ((x >> _U(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(h: np.ndarray, d: np.ndarray, w: np.ndarray, texts: int, m: int = COMPONENTS) -> np.ndarray:
    """The earliest point of each component of each text; inf throughout for a text without shingles."""
    best = np.full(texts * m, np.inf)
    level = np.frexp(np.maximum(w - 1, 0).astype(float))[1]  # the highest level whose interval begins below w
    n = level + 1
    row = np.repeat(np.arange(len(h)), n)
    j = ranges(np.zeros(len(h), np.int64), n)
    seed = mix64(h[row] + (j.astype(_U) + _U(1)) * _GOLD)
    low = np.where(j == 0, 0, 2.0 ** (j - 1))
    width = np.where(j == 0, 1.0, low)
    doc, weight, time, made, block = d[row], w[row].astype(float), np.zeros(len(row)), 0, 1
    while len(doc):
        k = np.arange(made + 1, made + block + 1, dtype=_U)
        x = mix64(seed[:, None] + k[None, :] * _GOLD)
        at = time[:, None] + np.cumsum(-np.log(_uniform(x)), axis=1) / width[:, None]
        y = mix64(x ^ _U(0xA3EC647659359ACD))
        own = low[:, None] + _uniform(mix64(y + _GOLD)) * width[:, None] <= weight[:, None]
        cell = doc[:, None] * m + (y % _U(m)).astype(np.int64)
        np.minimum.at(best, cell[own], at[own])
        time = at[:, -1]
        made += block
        go = time < best.reshape(-1, m).max(axis=1)[doc]
        seed, doc, low, width, weight, time = (a[go] for a in (seed, doc, low, width, weight, time))
        block = min(2 * block, 64)
    return best.reshape(-1, m)


def band_keys(best: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = np.ascontiguousarray(best[:, : bands * rows]).view(_U).reshape(len(best), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=_U), (len(best), bands)).copy()
    for i in range(rows):
        out = mix64(out * _GOLD + bits[:, :, i])
    return out.astype(np.int64)


def bags(text_slab) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted hashes, counts) of the shingles of each text."""
    w = text_slab.words()
    h, d, n = counted(*shingles(w.hashes(), w.bounds))
    at = np.searchsorted(d, np.arange(len(text_slab) + 1))
    return [(h[a:b], n[a:b]) for a, b in zip(at[:-1], at[1:])]


def difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What multiset b differs in from a, an integer for each copy of a shingle: even if it is missing, odd if added."""
    h = np.concatenate([a[0], b[0]])
    n = np.concatenate([-a[1], b[1]]).astype(np.int64)
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    n = np.add.reduceat(n, new) if len(new) else n
    h, some = h[new], n != 0
    h, n = h[some], n[some]
    copy = ranges(np.zeros(len(n), np.int64), np.abs(n))
    at = np.repeat(np.arange(len(n)), np.abs(n))
    return ((mix64(h[at] + copy.astype(_U) * _GOLD) >> _U(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE) | (n[at] > 0)).astype(np.uint32).view(np.int32)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, node (16 bytes of a hash of the words; null without words), bands."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for s in slabs(column(batch, "text")):
                w = s.words()
                node = [hashlib.md5(b" ".join(s.text(i).split()), usedforsecurity=False).digest() if n else None for i, n in enumerate(w.counts)]
                keys = band_keys(signatures(*counted(*shingles(w.hashes(), w.bounds)), len(s)))
                bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.ravel())
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(s.first, len(s)), pa.array(node, pa.binary()), bands], names=["doc_id", "node", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(mapped, run, f"doc_id {kind}, node binary, bands array<long>")


def centred(met: DataFrame) -> DataFrame:
    """node, centres, is_centre, hub (its centre that meets most) of the nodes that meet others; met has (band, node) rows.

    Rows of a band that many nodes share are salted for both joins with what is known of the band."""
    crowd = written(count_by(met, "band").where("_n > 1"), "crowds")
    hot = Hot(crowd, "band", "_n")
    per = written(hot.join(met, crowd, "node").groupBy("node").agg(F.sum("_n").alias("_s"), F.collect_set("band").alias("bands")), "crowded")
    each = per.select("node", "_s", F.explode("bands").alias("band"))
    centre = each.groupBy("band").agg(F.max(F.struct("_s", "node")).alias("c")).select("band", "c", F.col("c.node").alias("centre"))
    own = hot.join(each.select("band", "node"), centre, "node").groupBy("node").agg(F.collect_set("centre").alias("centres"), F.max("c")["node"].alias("hub"))
    return written(own.select("node", F.array_except("centres", F.array("node")).alias("centres"), F.array_contains("centres", F.col("node")).alias("is_centre"), "hub"), "centred")


def compared(pairs: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    """a, b, b_centre, hub, na, nb (shingles), diff, ok of pairs (a, b, _tb, b_centre, hub) with the texts (a, _ta)."""
    hot = Hot(pairs.select("a"), "a")
    full = hot.join(pairs, heads, "b").select("a", "b", "b_centre", "hub", "_ta", "_tb")

    def run(batches):
        last, one = None, None
        for batch in batches:
            a, ta = column(batch, "a").to_pylist(), column(batch, "_ta")
            for s in slabs(column(batch, "_tb")):
                na, nb, diffs = [], [], []
                for i, own in enumerate(bags(s)):
                    if a[s.first + i] != last:
                        last, one = a[s.first + i], bags(next(slabs(ta.slice(s.first + i, 1))))[0]
                    na.append(int(one[1].sum()))
                    nb.append(int(own[1].sum()))
                    diffs.append(difference(one, own))
                size = np.array([len(x) for x in diffs])
                both = (np.array(na) + nb - size) // 2
                ok = (both > 0) & (both >= least * (np.array(na) + nb - both))
                kept = [column(batch, c).slice(s.first, len(s)) for c in ("a", "b", "b_centre", "hub")]
                diff = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), np.concatenate([*diffs, np.zeros(0, np.int32)]))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(na, pa.int64()), pa.array(nb, pa.int64()), diff, pa.array(ok)], names=["a", "b", "b_centre", "hub", "na", "nb", "diff", "ok"])

    return written(full.transform(mapped, run, "a binary, b binary, b_centre boolean, hub binary, na long, nb long, diff array<int>, ok boolean"), "compared")


def stars(placed: DataFrame, least: float) -> DataFrame:
    """compared() of each node with its centres; placed has node, text, centres, is_centre."""
    pairs = placed.select(F.explode("centres").alias("a"), F.col("node").alias("b"), F.col("text").alias("_tb"), F.col("is_centre").alias("b_centre"), "hub")
    return compared(pairs, placed.where("is_centre").select(F.col("node").alias("a"), F.col("text").alias("_ta")), least)


def _united(batches):
    """(node, root) of the links of one task, by union and find."""
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(column(batch, "a").to_pylist(), column(batch, "b").to_pylist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([find(x) for x in nodes], pa.binary())], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of each linked node's component.

    Up to ``ONE_TASK`` links are joined up by one task.  More take rounds: each takes the smallest root among neighbours and
    then follows roots once, so that paths halve; every round is written, and it ends when nothing changes."""
    links = written(links.select("a", "b").distinct(), "links")
    if links.count() <= ONE_TASK:
        return written(links.coalesce(1).transform(mapped, _united, "node binary, root binary"), "roots")
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    hot = Hot(both, "b")
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select("node", F.least("node", "_m").alias("root")), "roots")
    while True:
        near = hot.join(both, roots.select(F.col("node").alias("b"), "root"), "a").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("_near"))
        step = roots.join(near, "node").select("node", F.col("root").alias("_old"), F.least("root", "_near").alias("_r"))
        own = Hot(step, "_r") if not hot.none else hot
        follow = roots.select(F.col("node").alias("_r"), F.col("root").alias("_rr"))
        step = own.join(step, follow, "node") if not hot.none else step.join(follow, "_r")
        step = written(step.select("node", "_old", F.least("_r", "_rr").alias("root")), "roots")
        changed = step.where(F.col("root") != F.col("_old")).limit(1).count()
        roots = step.select("node", "root")
        if not changed:
            return roots


class Links:
    """Verified links, and the component of each linked node.

    Most links are between a centre and its leaves.  A leaf that is no centre itself stands under the smallest of its
    centres, and components are found among the centres only."""

    def __init__(self, seen: DataFrame):
        ok = seen.where("ok")
        own = ok.groupBy("b").agg(F.collect_set("a").alias("_as"), F.max("b_centre").alias("_c"))
        self.homes = written(own.select(F.col("b").alias("node"), F.when(F.col("_c"), F.col("b")).otherwise(F.array_min("_as")).alias("key"), "_as"), "homes")
        self.heads = ok.select(F.col("a").alias("node"), F.col("a").alias("key")).distinct()
        self.edges = self.homes.select(F.col("key").alias("a"), F.explode("_as").alias("b")).where("a != b").distinct()
        self._solve()

    def _solve(self) -> None:
        self.edges = written(self.edges, "edges")
        base = self.homes.select("node", "key").unionByName(self.heads)
        if not self.edges.limit(1).count():
            self.labels = written(base.distinct().withColumnRenamed("key", "root"), "labels")
            return
        roots = components(self.edges)
        base = written(base.unionByName(roots.select("node", F.col("node").alias("key"))).distinct(), "keys")
        named = Hot(base, "key").join(base, roots.withColumnRenamed("node", "key"), "node", "left")
        self.labels = written(named.select("node", F.coalesce("root", "key").alias("root")), "labels")

    def add(self, more: DataFrame) -> None:
        """More links (a, b), between any nodes."""
        keys = self.homes.select("node", "key")
        more = written(more.join(keys.withColumnRenamed("node", "b"), "b", "left").select("a", F.coalesce("key", "b").alias("b")).distinct(), "more")
        more = Hot(more, "a").join(more, keys.withColumnRenamed("node", "a"), "b", "left").select(F.coalesce("key", "a").alias("a"), "b").where("a != b")
        heads = more.select(F.explode(F.array("a", "b")).alias("node"))
        self.edges = self.edges.unionByName(more).distinct()
        self.heads = self.heads.unionByName(heads.select("node", F.col("node").alias("key"))).distinct()
        self._solve()


def _common(rows: DataFrame, *more) -> DataFrame:
    """band, _n, _o (open ones) of the differences that can link nodes: nodes of one hub meet there."""
    crowd = rows.groupBy("band").agg(F.count(F.lit(1)).alias("_n"), F.count_if("open").alias("_o"), F.min("root").alias("_r1"), F.max("root").alias("_r2"), F.min("hub").alias("_h1"), F.max("hub").alias("_h2"), F.first("cid").alias("_c"), *more)
    return crowd.where("_n > 1 AND _o > 0 AND _r1 != _r2 AND (_h1 != _h2 OR _h1 = _c)").drop("_r1", "_r2", "_h1", "_h2", "_c")


def _often(rows: DataFrame) -> np.ndarray:
    """A byte for each slot of differences: 0 if none there can link nodes, else more bits the more nodes have one of them,
    and the highest if more than ``FEW`` open nodes have one.  Slots that differences share are taken for the most frequent."""
    levels = reduce(lambda x, y: x + y, [F.when(F.col("_n") > 1 << k, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(7)])
    crowd = _common(rows).select(F.pmod("band", F.lit(8 * SLOTS)).alias("slot"), (levels + F.when(F.col("_o") > FEW, F.lit(128)).otherwise(F.lit(0))).cast("long").alias("level"))
    words = crowd.select(F.expr("slot DIV 8").alias("word"), F.expr("shiftleft(level, CAST(8 * (slot % 8) AS INT))").alias("bits"))
    made = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(SLOTS, "<i8")
    out[made["word"].to_numpy()] = made["bits"].to_numpy()
    return out.view(np.uint8)


def _must_share(x, y):
    """How many differences two nodes must share, from their alphas."""
    return F.greatest(F.ceil((F.col(x) + F.col(y)) / 2 - 1e-9), F.lit(1))


def unsettled(seen: DataFrame, links: Links, least: float) -> tuple[DataFrame, DataFrame] | None:
    """(prefixes, pairs a, b of nodes that surely are linked) of the nodes that may have links which their centres don't show;
    None if there are no such nodes.

    A prefix has a row for each difference: band, node, most (a pair that must share more doesn't have it in its prefixes),
    plus, minus (how many differences that others can have the node has and lacks beside its centre), crowded (those of them
    that more than ``FEW`` open nodes have), n (its shingles), alpha, open, root, hub, cid (the centre)."""
    g = (1 - least) / (1 + least)
    failed = written(seen.where("NOT ok").select("a", "b"), "failed")
    if not failed.limit(1).count():
        return None
    root_b = links.labels.select(F.col("node").alias("b"), F.col("root").alias("_rb"))
    root_a = links.labels.select(F.col("node").alias("a"), F.col("root").alias("_ra"))
    apart = failed.join(root_b, "b", "left").select("a", "b", F.coalesce("_rb", "b").alias("_rb"))
    apart = Hot(failed, "a").join(apart, root_a, "b", "left").where(F.col("_rb") != F.coalesce("_ra", "a"))
    centres = written(apart.groupBy("a").agg(F.first(F.coalesce("_ra", "a")).alias("_ra")), "open")
    if not centres.limit(1).count():
        return None
    hot = Hot(seen.select("a"), "a")
    mem = hot.join(seen, centres, "b").join(root_b, "b", "left").withColumn("root", F.coalesce("_rb", "b"))
    mem = written(mem.select("a", "b", "hub", "na", F.col("nb").alias("n"), "diff", "root", (F.col("root") != F.col("_ra")).alias("open"), (F.size("diff") - g * F.col("nb")).alias("alpha")), "members")
    # A centre with one node has nothing more to tell, nor has one all of whose nodes were compared with one other hub.
    lows = mem.groupBy("a").agg(F.min("alpha").alias("_low"), F.min(F.when(F.col("open"), F.col("alpha"))).alias("_open"), F.min(F.struct("alpha", "b"))["b"].alias("_y"), F.count(F.lit(1)).alias("_m"), F.min("hub").alias("_h1"), F.max("hub").alias("_h2")).where("_m > 1 AND (_h1 != _h2 OR _h1 = a)").drop("_h1", "_h2")
    hashed = [F.xxhash64("root").alias("root"), F.xxhash64("hub").alias("hub"), F.xxhash64("a").alias("cid")]
    mem = written(hot.join(mem, lows, "b").select("a", "b", "n", "diff", "open", "alpha", "_low", "_open", "_y", *hashed), "members")
    keyed = mem.select("b", "n", "alpha", F.when(F.col("open"), F.col("_low")).otherwise(F.col("_open")).alias("_with"), "open", "root", "hub", "cid", "diff", F.expr("transform(diff, e -> xxhash64(a, e))").alias("bands"))
    shared = mem.sparkSession.sparkContext.broadcast(_often(keyed.select("open", "root", "hub", "cid", F.explode("bands").alias("band"))))

    def run(batches):
        levels = shared.value
        for batch in batches:
            alpha, low = (column(batch, x).to_numpy(zero_copy_only=False) for x in ("alpha", "_with"))
            bands, diff = column(batch, "bands"), column(batch, "diff")
            ends, bands, added = bands.offsets.to_numpy(), bands.values.to_numpy(), (diff.values.to_numpy() & 1) == 1
            level = levels[bands % (8 * SLOTS)]
            # A node that none can be linked with has no lower bound.
            need = np.where(np.isnan(low), 1 << 40, np.maximum(np.ceil((alpha + np.nan_to_num(low)) / 2 - 1e-9), 1)).astype(np.int64)
            at, out, nums = [], [], []
            for i in range(len(batch)):
                part = ends[i] + np.flatnonzero(level[ends[i] : ends[i + 1]])
                if (shares := len(part)) >= need[i]:
                    # Those that many open nodes have come last.
                    part = part[np.lexsort((bands[part], level[part]))]
                    crowded, plus = int((level[part] >= 128).sum()), int(added[part].sum())
                    most = np.minimum(shares, shares - np.arange(shares) + SEVERAL - 1)
                    most[shares - crowded :] = np.minimum(most[shares - crowded :], crowded)
                    part, most = part[most >= need[i]], most[most >= need[i]]
                    at.append(np.full(len(part), i))
                    out.append(bands[part])
                    nums.append(np.stack([most, *(np.full(len(part), x) for x in (plus, shares - plus, crowded))]))
            place = pa.array(np.concatenate([*at, np.zeros(0, np.int64)]))
            nums = np.concatenate([*nums, np.zeros((4, 0), np.int64)], axis=1).astype(np.int64)
            kept = [column(batch, x).take(place) for x in ("b", "n", "alpha", "open", "root", "hub", "cid")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*out, np.zeros(0, np.int64)])), *(pa.array(x) for x in nums), *kept], names=["band", "most", "plus", "minus", "crowded", "node", "n", "alpha", "open", "root", "hub", "cid"])

    prefix = keyed.transform(mapped, run, "band long, most long, plus long, minus long, crowded long, node binary, n long, alpha double, open boolean, root long, hub long, cid long")
    sure = F.col("open") & (F.col("alpha") + F.col("_low") <= 1e-9) & (F.col("b") != F.col("_y"))
    return written(prefix, "prefixes"), mem.where(sure).select(F.col("_y").alias("a"), "b").distinct()


def groups(prefix: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(pairs a, b of nodes that share differences with few others; met rows of the differences that many share)."""
    # The alpha up to which a node has the difference in the prefix of a pair, and what the band has of both.
    reach = 2 * F.col("most") - F.col("alpha") + 2e-9
    bounds = [f(F.when(F.col("open"), x) if o else x).alias(f"_{name}{o}") for name, f, x in (("low", F.min, F.col("alpha")), ("reach", F.max, reach)) for o in ("", "o")]
    crowd = written(_common(prefix, *bounds), "differing")
    of_band = lambda name: F.when(F.col("open"), F.col(f"_{name}")).otherwise(F.col(f"_{name}o"))
    near = Hot(crowd, "band", "_n").join(prefix, crowd, "node").where((of_band("low") <= reach) & (F.col("alpha") <= of_band("reach")))
    near = written(near.select(*prefix.columns), "differing")
    crowd = written(_common(near), "differing")
    hot = Hot(crowd, "band", "_n")
    met = written(hot.join(near, crowd, "node"), "differing")
    few = met.where(F.col("_o") <= FEW)
    names = ("most", "plus", "minus", "crowded", "n", "alpha", "open", "root", "hub")
    side = lambda x, *more: few.select("band", F.col("node").alias(x), *(F.col(c).alias(f"_{c}{x}") for c in names), *more)
    both = hot.spread(side("a", "cid").where("_opena")).join(hot.split(side("b"), "b"), ["band", "_salt"])
    once = (F.col("a") != F.col("b")) & ((F.col("_huba") != F.col("_hubb")) | (F.col("_huba") == F.col("cid"))) & (~F.col("_openb") | (F.col("a") < F.col("b")))
    need = _must_share("_alphaa", "_alphab")
    can = (need <= F.least("_mosta", "_mostb", F.least("_plusa", "_plusb") + F.least("_minusa", "_minusb"))) & (F.least("_na", "_nb") >= least * F.greatest("_na", "_nb"))
    # Of those in the prefixes, so many can be differences that many nodes have and that weren't looked at.
    ask = F.least(need, F.lit(SEVERAL))
    ask -= F.greatest(F.least(F.col("_crowdeda"), F.col("_crowdedb")) - need + ask, F.lit(0))
    found = both.where(once & (F.col("_roota") != F.col("_rootb")) & can).groupBy("a", "b", "cid").agg(F.count(F.lit(1)).alias("_same"), F.first(F.greatest(ask, F.lit(1))).alias("_ask"))
    pairs = found.where("_same >= _ask").select(F.col("b").alias("a"), F.col("a").alias("b")).distinct()
    return written(pairs, "pairs"), met.where(F.col("_o") > FEW).select("band", "node")


def classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, class_id: the smallest doc_id of its class."""
    rows = written(sketch(docs.select("doc_id", "text")), "sketch")
    nodes = written(rows.where("node IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "nodes")
    placed = written(_texts(docs, centred(nodes.select("node", F.explode("bands").alias("band")))), "texts")
    texts = placed.select("node", "text")
    seen = stars(placed, least)
    links = Links(seen)
    while (left := unsettled(seen, links, least)) is not None:
        pairs, met = groups(left[0], least)
        pairs, found = pairs.unionByName(left[1]).distinct(), []
        if pairs.limit(1).count():
            sides = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("_tb")), "b").withColumns({"b_centre": F.lit(False), "hub": F.lit(None).cast("binary")})
            found.append(compared(sides, texts.select(F.col("node").alias("a"), F.col("text").alias("_ta")), least))
        if more := met.limit(1).count():
            seen = stars(written(texts.join(centred(met), "node"), "texts"), least)
            found.append(seen)
        new = [x.where("ok").select("a", "b") for x in found]
        if any(x.limit(1).count() for x in new):
            links.add(reduce(DataFrame.unionByName, new))
        if not more:
            break
    linked = links.labels.join(nodes.select("node", "first_id"), "node")
    of_root = linked.groupBy("root").agg(F.min("first_id").alias("class_id"))
    label = Hot(links.labels, "root").join(links.labels, of_root, "node").select("node", "class_id")
    shared = nodes.where("copies > 1").select("node", "first_id", F.col("copies").alias("_n"))
    both = written(shared.join(label, "node", "full_outer").select("node", F.coalesce("class_id", "first_id").alias("class_id")), "labels")
    alone = rows.where("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"))
    named = Hot(shared, "node", "_n").join(rows.where("node IS NOT NULL").select("doc_id", "node"), both.withColumn("_in", F.lit(True)), "doc_id", "left")
    return named.select("doc_id", F.when(F.col("_in"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id")).unionByName(alone)


def _mark(node: bytes) -> tuple[int, int]:
    """A node's word of the filter and its two bits there."""
    x = int.from_bytes(node[:8], "little")
    return x % SLOTS, 1 << (x >> 24) % 63 | 1 << (x >> 44) % 63


def _marks(involved: DataFrame) -> np.ndarray:
    """A Bloom filter of ``SLOTS`` words; the workers make it, and its size doesn't depend on the number of nodes."""

    def run(batches):
        for batch in batches:
            found = {}
            for node in column(batch, "node").to_pylist():
                slot, bits = _mark(node)
                found[slot] = found.get(slot, 0) | bits
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["slot", "bits"])

    made = involved.transform(mapped, run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[made["slot"].to_numpy()] = made["bits"].to_numpy()
    return out


def _texts(docs: DataFrame, involved: DataFrame) -> DataFrame:
    """The rows of ``involved`` and one text of each node; a copy that a task has sent already isn't sent again.

    The filter keeps most other texts from being shuffled; the join decides, so that a full filter costs time only."""
    shared = docs.sparkSession.sparkContext.broadcast(_marks(involved))

    def run(batches):
        marks = shared.value
        sent = set()
        for batch in batches:
            at, nodes = [], []
            for s in slabs(column(batch, "text")):
                for i in range(len(s)):
                    if words := s.text(i).split():
                        x = hashlib.md5(b" ".join(words), usedforsecurity=False).digest()
                        slot, bits = _mark(x)
                        if x not in sent and int(marks[slot]) & bits == bits:
                            sent.add(x)
                            at.append(s.first + i)
                            nodes.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), column(batch, "text").take(pa.array(at, pa.int64()))], names=["node", "text"])

    one = docs.select("text").transform(mapped, run, "node binary, text string").groupBy("node").agg(F.min("text").alias("text"))
    return one.join(involved, "node")


def report(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, class_id of every document."""
    return classes(docs, least)


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents with the smallest doc_id of their class, with their columns as they were; rows without id stay."""
    keep = classes(docs, least).where("doc_id = class_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(keep, "doc_id", "left_semi")
    return named.unionByName(docs.where("doc_id IS NULL"))
