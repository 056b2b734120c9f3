"""Substring dedup by prefix-partitioned suffix trees over words.

A word is removed if a window of ``WINDOW`` consecutive words covers it whose words also start earlier in the corpus
(a smaller doc_id, or an earlier place in the same document).

1. *Prefixes.*  Of each window the ``PREFIX``-word prefix with the smallest hash among its own prefixes is its anchor, so
   that equal windows have equal anchors at equal places.  About one place in seven is an anchor.  Anchors that occur
   once in the corpus are leaves near the root: their windows can't repeat.  Only hashes and places are shuffled; those of
   anchors so frequent that one group of them would be large aren't, a bounded table of these is broadcast instead.
2. *Groups.*  Suffixes below repeated anchors are dealt out by their prefix, which has the length that it needs to fit into
   memory.  An anchor that occurs up to ``FREQUENT`` times is a prefix by itself: a suffix starts there, and takes along the
   words before it that its windows begin with.  Below a more frequent anchor each window is a suffix of its own, and its
   prefix has 12 words, 16 or all ``WINDOW`` of them, the longer the more frequent the anchor is; the last are dealt in two
   rounds, the first of them salted.  A task has one group after another in memory, not all that it is dealt.
3. *Subtrees.*  The suffixes of a group are sorted, and the common prefixes of neighbours are the depths of the subtree's
   internal nodes.  The words before the suffixes, read backwards, make a second tree.  A node of the one and a node of the
   other whose depths add up to the window are a repeat that is as long as the window; all its leaves but the earliest are
   marked.  This is done with the suffixes of a block of texts first, so that of equal ones only the earliest is sent.
4. Marks come back to their documents as intervals of words.

Hashes of prefixes only bring suffixes together.  What is compared are the words, one by one, as 64-bit hashes: a false repeat
needs two windows that agree in all words but for different words with one hash.
Rules for odd rows: a null text has no words; rows with one doc_id and one text are the same document, and none of them is
a repeat of another; a null doc_id comes before all others; an empty table gives no rows; a doc_id that isn't an integer is
refused (TypeError), since the order of ids decides; further columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import column, grams, mix64, ranges, slabs, window_bounds
from .runtime import free, mapped, parts, prepare, written

WINDOW, PREFIX = 20, 8
#: Words of texts that are looked at together before anything is sent.
BLOCK_WORDS = 2_000_000
#: Windows whose anchors are looked for at once.
PIECE = 1 << 18
#: An anchor that occurs more often has its windows dealt out one by one.
FREQUENT = 2000
_NULL_ID = -(1 << 63)


#: Words of the prefixes of windows below an anchor that occurs more than FREQUENT, 16 or 256 times as often.
LONGER = (12, 16)
#: Most entries of the broadcast table of very frequent anchors.
MOST_FREQUENT = 1_000_000
#: Bytes of text whose suffixes make a group of prefixes.
GROUP_BYTES = 32 << 20

_ANCHOR = [("hash", "<u8"), ("id", "<i8"), ("tag", "<i8"), ("place", "<u4")]
_FOUND = [("id", "<i8"), ("tag", "<i8"), ("place", "<u4"), ("often", "<u1")]
#: place, n: the first of the windows that belong to the suffix, and their number; off: words of the first before the suffix.
_SUFFIX = [("hash", "<u8"), ("id", "<i8"), ("tag", "<i8"), ("place", "<u4"), ("n", "<u1"), ("off", "<u1")]
_MARK = [("id", "<i8"), ("tag", "<i8"), ("place", "<u4"), ("n", "<u1")]
_BLOB = "bucket int, data binary"


def _width(n: int) -> str:
    return "<u2" if n < 1 << 16 else "<u4"


def squeeze(columns: dict[str, np.ndarray]) -> bytes:
    """Columns of a few rows as bytes; ids as differences, since neighbours are alike; words by a table of the different ones."""
    import zstandard

    parts_ = [np.diff(v, prepend=0) if k == "id" else v for k, v in columns.items() if k != "words"]
    if "words" in columns:
        some, which, often = np.unique(columns["words"], return_inverse=True, return_counts=True)
        # Frequent words first: their numbers are small, and the bytes of a place stand together.
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), _width(len(some)))
        rank[order] = np.arange(len(order))
        parts_ += [np.array([len(some)], "<u4"), some[order], rank[which].view(np.uint8).reshape(len(which), -1).T]
    raw = b"".join(np.ascontiguousarray(v).tobytes() for v in parts_)
    return len(columns["id"]).to_bytes(4, "little") + zstandard.ZstdCompressor(level=3).compress(raw)


def expand(blob: bytes, kind: list[tuple[str, str]], extra: str = "") -> dict[str, np.ndarray]:
    import zstandard

    n, raw, out, at = int.from_bytes(blob[:4], "little"), zstandard.ZstdDecompressor().decompress(blob[4:]), {}, 0
    for name, dtype in kind:
        size = np.dtype(dtype).itemsize * n
        out[name] = np.frombuffer(raw, dtype=dtype, count=n, offset=at)
        at += size
    if extra:
        k = int(np.frombuffer(raw, "<u4", 1, at)[0])
        bytes_ = np.frombuffer(raw, np.uint8, offset=at + 4 + 8 * k).reshape(np.dtype(_width(k)).itemsize, -1)
        out[extra] = np.frombuffer(raw, "<u8", k, at + 4)[np.ascontiguousarray(bytes_.T).view(_width(k)).ravel()]
    out["id"] = np.cumsum(out["id"])
    return out


def gathered(blobs, kind, extra: str = "") -> dict[str, np.ndarray]:
    """The rows of several blobs as one table."""
    got = [expand(b, kind, extra) for b in blobs]
    return {k: np.concatenate([g[k] for g in got]) for k in got[0]}


def dealt(bucket: np.ndarray, n: int, columns: dict[str, np.ndarray], words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
    """Rows (bucket, data): a table split by bucket.  words: (of the texts, first of each row, number in each row)."""
    order = np.argsort(bucket, kind="stable")
    full, first = np.unique(bucket[order], return_index=True)
    cut = np.append(first, len(order))
    data = []
    for i in range(len(full)):
        own = order[cut[i] : cut[i + 1]]
        table = {k: v[own] for k, v in columns.items()}
        if words:
            table["words"] = words[0][ranges(words[1][own], words[2][own])]
        data.append(squeeze(table))
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "data"])


def _by_document(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix64(ids.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def blocks(batches, with_found: bool = False, most: int = BLOCK_WORDS):
    """(ids, tags, word hashes on end, bounds, the found anchors of each text) of about ``most`` words of whole texts."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        ids, tags = column(batch, "_id").to_numpy(zero_copy_only=False), column(batch, "_tag").to_numpy(zero_copy_only=False)
        found = column(batch, "_found").to_pylist() if with_found else None
        for s in slabs(column(batch, "text")):
            w = s.words()
            at = slice(s.first, s.first + len(s))
            held.append((ids[at], tags[at], w.hashes(), w.counts, found[at] if found else []))
            size += len(w)
            if size >= most:
                yield _joined(held)
                size = 0
    if held:
        yield _joined(held)


def _joined(held):
    """One block of what is held; nothing is held on to."""
    ids, tags, hashes, counts = (np.concatenate([h[i] for h in held]) for i in range(4))
    found = [x for h in held for x in h[4]]
    held.clear()
    return ids, tags, hashes, np.concatenate([[0], np.cumsum(counts)]), found


def anchors(hashes: np.ndarray, bounds: np.ndarray, window: int = WINDOW, prefix: int = PREFIX, bits: int = 64):
    """(window starts, the text of each, the place of each window's anchor, hashes of prefixes by place).

    Ties go to the first place, so that equal windows agree.  A block is worked through in pieces, which bounds what is held
    beside the results."""
    starts, doc = window_bounds(bounds, window)
    g = np.zeros(max(len(hashes) - prefix + 1, 0), dtype=np.uint64)
    for i in range(0, len(g), PIECE):
        g[i : i + PIECE] = grams(hashes[i : i + PIECE + prefix - 1], prefix) >> np.uint64(64 - bits)
    reach = window - prefix + 1
    place = np.zeros(len(starts), dtype=np.int64)
    for i in range(0, len(starts), PIECE):
        own = starts[i : i + PIECE]
        low = g[own[0] : own[-1] + reach]
        at = np.arange(own[0], own[0] + len(low))
        span = 1
        while span < reach:
            step = min(span, reach - span)
            later = low[step:] < low[: len(low) - step]
            at = np.where(later, at[step:], at[: len(at) - step])
            low = np.where(later, low[step:], low[: len(low) - step])
            span += step
        place[i : i + PIECE] = at[own - own[0]]
    return starts, doc, place, g


def by_bucket(batches):
    """The blobs of one bucket after another; the rows are sorted by bucket."""
    at, blobs = None, []
    for batch in batches:
        for bucket, data in zip(column(batch, "bucket").to_pylist(), column(batch, "data").to_pylist()):
            if bucket != at and blobs:
                yield blobs
                blobs = []
            at = bucket
            blobs.append(data)
    if blobs:
        yield blobs


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition(parts(rows.sparkSession), "bucket").sortWithinPartitions("bucket")


def _level(count: np.ndarray, frequent: int) -> np.ndarray:
    """0: the anchor is the prefix; 1, 2, 3: its windows have a prefix of 12, 16 or all their words."""
    return ((count > frequent).astype(np.uint8) + (count > 16 * frequent) + (count > 256 * frequent)).astype(np.uint8)


class Shape:
    """What all tasks agree on: lengths, bits of hashes, number of buckets, and the very frequent anchors with their levels."""

    def __init__(self, window: int, prefix: int, bits: int, buckets: int, frequent: int):
        self.window, self.prefix, self.bits, self.buckets, self.frequent = window, prefix, bits, buckets, frequent
        self.hot, self.levels = np.zeros(0, np.uint64), np.zeros(0, np.uint8)

    def anchors(self, hashes, bounds):
        return anchors(hashes, bounds, self.window, self.prefix, self.bits)

    def level(self, g: np.ndarray) -> np.ndarray:
        """One more than the level of a very frequent anchor, 0 for others."""
        if not len(self.hot):
            return np.zeros(len(g), np.uint8)
        at = np.minimum(np.searchsorted(self.hot, g), len(self.hot) - 1)
        return np.where(self.hot[at] == g, self.levels[at] + np.uint8(1), np.uint8(0))


def _shape(keyed: DataFrame, window: int, prefix: int, bits: int) -> Shape:
    """Finds the anchors that occur so often that their places shouldn't meet in one group.

    Only what occurs twice or more within a block is counted, so that the rest has a place a block at most."""
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shape = Shape(window, prefix, bits, max(parts(keyed.sparkSession), size // GROUP_BYTES), FREQUENT)

    def often(batches):
        for _, _, hashes, bounds, _ in blocks(batches):
            _, _, at, g = shape.anchors(hashes, bounds)
            some, n = np.unique(g[np.unique(at)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(some[n > 1].astype(np.int64)), pa.array(n[n > 1])], names=["hash", "n"])

    found = keyed.transform(mapped, often, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") > shape.frequent)
    found = written(found, "frequent")
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    got = found.where(F.col("n") > total // MOST_FREQUENT).toArrow()
    key, n = got.column("hash").to_numpy().astype(np.uint64), got.column("n").to_numpy()
    order = np.argsort(key)
    shape.hot, shape.levels = key[order], _level(n, shape.frequent)[order]
    return shape


def _repeated_anchors(keyed: DataFrame, shape: Shape) -> DataFrame:
    """Places of anchors that occur more than once, dealt out by document; very frequent ones are left out."""
    n, frequent = shape.buckets, shape.frequent
    shared = keyed.sparkSession.sparkContext.broadcast(shape)

    def send(batches):
        for ids, tags, hashes, bounds, _ in blocks(batches):
            starts, doc, at, g = shared.value.anchors(hashes, bounds)
            place, first = np.unique(at, return_index=True)
            rare = shared.value.level(g[place]) == 0
            place, owner = place[rare], doc[first[rare]]
            yield dealt((g[place] % np.uint64(n)).astype(np.int64), n, {"hash": g[place], "id": ids[owner], "tag": tags[owner], "place": (place - bounds[owner]).astype(np.uint32)})

    def meet(batches):
        for blobs in by_bucket(batches):
            t = gathered(blobs, _ANCHOR)
            _, back, count = np.unique(t["hash"], return_inverse=True, return_counts=True)
            some = np.flatnonzero(count[back] > 1)
            some = some[np.argsort(t["id"][some], kind="stable")]
            yield dealt(_by_document(t["id"][some], n), n, {"id": t["id"][some], "tag": t["tag"][some], "place": t["place"][some], "often": _level(count[back[some]], frequent)})

    return _together(keyed.transform(mapped, send, _BLOB)).transform(mapped, meet, _BLOB)


def _per_document(rows: DataFrame, kind, out: str) -> DataFrame:
    """(_id, _tag, out): what the blobs hold of each document, as the bytes of its own rows."""
    names = [k for k, _ in kind if k not in ("id", "tag")]

    def run(batches):
        for blobs in by_bucket(batches):
            t = gathered(blobs, kind)
            order = np.lexsort((t["place"], t["tag"], t["id"]))
            ids, tags = t["id"][order], t["tag"][order]
            if not len(ids):
                continue
            edge = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]), [True]]))
            table = np.rec.fromarrays([t[k][order] for k in names], dtype=[(k, d) for k, d in kind if k in names])
            data = [table[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ids[edge[:-1]]), pa.array(tags[edge[:-1]]), pa.array(data, pa.binary())], names=["_id", "_tag", out])

    return _together(rows).transform(mapped, run, f"_id long, _tag long, {out} binary")


def _tree(key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, depth) of suffixes, a row of words each: their sorted order, and the words that each has in common with the
    one before it; -1 where the key differs.  A node of depth d is a stretch in which no depth is less than d."""
    raw = np.ascontiguousarray(np.column_stack([key, words]).astype(">u8"))
    order = np.argsort(raw.view(f"S{8 * raw.shape[1]}").ravel(), kind="stable")
    same = raw[order[1:]] == raw[order[:-1]]
    common = np.where(same.all(axis=1), raw.shape[1], same.argmin(axis=1)) - 1
    return order, np.concatenate([[-1], common])


def _nodes(tree: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    """For each suffix the number of its node of that depth."""
    order, common = tree
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def repeats(key, texts, first, n, off, ids, place, window: int):
    """(row, t, later, spoken) of the windows of some suffixes: later, if equal words start at an earlier window; spoken, if
    the window is the earliest of its kind or alone of it.

    texts[first:first + n + window - 1] are the words of a row's windows; off of them are before the suffix; ids and place
    order them by where their first window starts."""
    step = np.arange(window)
    reach = n + window - 1
    at = first[:, None] + off[:, None] + step
    right = _tree(key, np.where(off[:, None] + step < reach[:, None], texts[np.minimum(at, len(texts) - 1)], np.uint64(0)))
    most = int(off.max(initial=0))
    back = np.arange(most)
    left = _tree(key, np.where(back < off[:, None], texts[np.maximum(first[:, None] + off[:, None] - 1 - back, 0)], np.uint64(0)))
    out = []
    for j in range(most + 1):
        t = off - j
        some = np.flatnonzero((t >= 0) & (t < n))
        if not len(some):
            continue
        where = place[some] + t[some]
        r, l = _nodes(right, window - j)[some], _nodes(left, j)[some]
        order = np.lexsort((where, ids[some], l, r))
        r, l, i, p = r[order], l[order], ids[some][order], where[order]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (l[1:] != l[:-1])])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        out.append((some[order], t[some][order], (i != i[head]) | (p != p[head]), new))
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool))
    return tuple(np.concatenate([o[i] for o in out]) if out else empty[i] for i in range(4))


def _suffixes(hashes, bounds, found, shape: Shape):
    """(key, first, n, off, text, level) of the suffixes of a block whose anchors repeat."""
    kind = [(k, d) for k, d in _FOUND if k not in ("id", "tag")]
    starts, doc, at, g = shape.anchors(hashes, bounds)
    flag = np.zeros(len(g) + 1, dtype=np.uint8)
    for i, raw in enumerate(found):
        if raw:
            t = np.frombuffer(raw, dtype=kind)
            flag[bounds[i] + t["place"]] = 1 + t["often"]
    flag[:-1] = np.maximum(flag[:-1], shape.level(g))
    keep = np.flatnonzero(flag[at] > 0)
    starts, doc, at = starts[keep], doc[keep], at[keep]
    level = flag[at] - 1
    # One suffix for an anchor and its windows, unless it is frequent: then one for each window.
    row = np.where(level > 0, starts + len(hashes), at)
    edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]])) if len(row) else np.zeros(1, np.int64)
    a, n = edge[:-1], np.diff(edge)
    starts, at, level, doc = starts[a], at[a], level[a], doc[a]
    key = g[at] if len(at) else np.zeros(0, np.uint64)
    for k, length in enumerate((*LONGER, shape.window), start=1):
        if (level == k).any():
            key[level == k] = grams(hashes, min(length, shape.window), 7)[starts[level == k]] >> np.uint64(64 - shape.bits)
    return key, starts, n, np.where(level > 0, 0, at - starts), doc, level


def _marks(found_docs: DataFrame, shape: Shape) -> DataFrame:
    """Marked windows, dealt out by document."""
    n, window = shape.buckets, shape.window
    hot = bool((shape.levels == 3).any())
    shared = found_docs.sparkSession.sparkContext.broadcast(shape)

    def rows(kind: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([kind] * len(batch), pa.int32()), batch.column(1)], names=["bucket", "kind", "data"])

    def settled(key, texts, first, n_, off, ids, tags, place, level, salt):
        """Marks of what repeats among some suffixes, and the suffixes that speak for others: kinds 0 marks, 1 suffixes, 2 suffixes
        of very frequent windows, salted."""
        row, t, later, spoken = repeats(key, texts, first, n_, off, ids, place, window)
        yield rows(0, _runs(ids[row[later]], tags[row[later]], place[row[later]] + t[later], n))
        send = np.zeros(len(key), dtype=bool)
        send[row[spoken]] = True
        for kind, some in ((1, send & ((level < 3) | (not hot))), (2, send & (level == 3) & hot)):
            some = np.flatnonzero(some)
            if len(some):
                bucket = mix64(key[some] + np.uint64(salt)) if kind == 2 else key[some]
                table = {"hash": key[some], "id": ids[some], "tag": tags[some], "place": place[some].astype(np.uint32), "n": n_[some].astype(np.uint8), "off": off[some].astype(np.uint8)}
                yield rows(kind, dealt((bucket % np.uint64(n)).astype(np.int64), n, table, (texts, first[some], n_[some] + window - 1)))

    def send(batches):
        for number, (ids, tags, hashes, bounds, found) in enumerate(blocks(batches, with_found=True)):
            key, first, n_, off, doc, level = _suffixes(hashes, bounds, found, shared.value)
            if len(key):
                salt = int(mix64(np.array([ids[0]]).astype(np.uint64))[0]) % n + number
                yield from settled(key, hashes, first, n_, off, ids[doc], tags[doc], first - bounds[doc], level, salt)

    def meet(kind: int):
        def run(batches):
            passed = []

            def own():
                for batch in batches:
                    mine = pa.compute.equal(column(batch, "kind"), kind)
                    passed.append(batch.filter(pa.compute.invert(mine)))
                    yield batch.filter(mine)

            for blobs in by_bucket(own()):
                t = gathered(blobs, _SUFFIX, "words")
                n_, off = t["n"].astype(np.int64), t["off"].astype(np.int64)
                first = np.cumsum(n_ + window - 1) - (n_ + window - 1)
                yield from settled(t["hash"], t["words"], first, n_, off, t["id"], t["tag"], t["place"].astype(np.int64), np.zeros(len(n_), np.uint8), 0)
                yield from passed
                passed.clear()
            yield from passed

        return run

    kinds = "bucket int, kind int, data binary"
    rows_ = found_docs.transform(mapped, send, kinds)
    if hot:
        rows_ = _together(rows_).transform(mapped, meet(2), kinds)
    return _together(rows_).transform(mapped, meet(1), kinds).where("kind = 0").select("bucket", "data")


def _runs(ids, tags, place, n: int) -> pa.RecordBatch:
    """Marked windows as runs of neighbours, dealt out by document."""
    order = np.lexsort((place, tags, ids))
    ids, tags, place = ids[order], tags[order], place[order].astype(np.int64)
    step = np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (place[1:] > place[:-1] + 1)]) if len(ids) else np.zeros(0, bool)
    first = np.flatnonzero(step)
    last = np.append(first[1:], len(ids)) - 1
    length = place[last] - place[first] + 1 if len(first) else np.zeros(0, np.int64)
    # A run is stored in stretches of up to 255 windows.
    pieces = -(-length // 255)
    owner = np.repeat(np.arange(len(first)), pieces)
    k = ranges(np.zeros(len(first), np.int64), pieces)
    size = np.minimum(length[owner] - 255 * k, 255)
    at = first[owner]
    return dealt(_by_document(ids[at], n), n, {"id": ids[at], "tag": tags[at], "place": (place[at] + 255 * k).astype(np.uint32), "n": size.astype(np.uint8)})


def marked(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, bits: int = 64) -> tuple[DataFrame, str]:
    """The documents' columns and one more, and its name: which of their windows repeat, as stretches (first word, number),
    or null.  bits: of the hashes of prefixes; fewer bring more suffixes together that differ, and nothing else."""
    prepare(docs.sparkSession)
    if docs.schema["doc_id"].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise TypeError("doc_id must be an integer")
    names = [free(x, docs.columns) for x in ("_id", "_tag", "_runs")]
    keys = (F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)), F.xxhash64("text"))
    rows = docs.withColumns(dict(zip(names, keys)))
    keyed = docs.select(keys[0].alias("_id"), keys[1].alias("_tag"), "text")
    shape = _shape(keyed, window, prefix, bits)
    found = written(_per_document(written(_repeated_anchors(keyed, shape), "anchors"), _FOUND, "_found"), "found")
    with_found = keyed.join(found, ["_id", "_tag"], "left" if len(shape.hot) else "inner")
    marks = written(_per_document(_marks(with_found, shape), _MARK, "_runs"), "marks").toDF(*names)
    return rows.join(marks, names[:2], "left").select(*docs.columns, names[2]), names[2]


def kept_mask(n_words: int, runs: bytes | None, window: int = WINDOW) -> np.ndarray:
    """Which words of a text stay."""
    cover = np.zeros(n_words + 1, dtype=np.int64)
    if runs:
        t = np.frombuffer(runs, dtype=_MARK[2:])
        np.add.at(cover, t["place"].astype(np.int64), 1)
        np.add.at(cover, np.minimum(t["place"].astype(np.int64) + t["n"] - 1 + window, n_words), -1)
    return np.cumsum(cover)[:n_words] == 0


def _each(batch, name, window):
    """(place in the batch, slab, words, mask) of each text."""
    runs = column(batch, name).to_pylist()
    for s in slabs(column(batch, "text")):
        w = s.words()
        for i in range(len(s)):
            a, b = w.bounds[i], w.bounds[i + 1]
            yield s.first + i, s, i, w.starts[a:b], w.ends[a:b], kept_mask(int(b - a), runs[s.first + i], window)


def digest(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words with single spaces) of every document."""
    rows, name = marked(docs.select("doc_id", "text"), window, prefix, bits)

    def run(batches):
        for batch in batches:
            n, gone, sha = [], [], []
            for _, s, _, starts, ends, keep in _each(batch, name, window):
                words = [s.data[a:b].tobytes() for a, b in zip(starts[keep].tolist(), ends[keep].tolist())] if not keep.all() else s.data[starts[0] : ends[-1]].tobytes().split() if len(keep) else []
                n.append(len(keep))
                gone.append(int(len(keep) - keep.sum()))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.transform(mapped, run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """The documents with their repeats cut out of ``text``; what stays keeps its white space.  ``n_chars`` follows, where
    there is such a column; a null text stays null."""
    names = docs.columns
    rows, name = marked(docs, window, prefix)

    def run(batches):
        for batch in batches:
            texts = []
            for at, s, i, starts, ends, keep in _each(batch, name, window):
                if keep.all():
                    texts.append(s.text(i))
                    continue
                # A stretch of kept words reaches to the next word, so that it brings its white space along.
                reach = np.append(starts[1:], s.offsets[i + 1])
                edge = np.flatnonzero(np.diff(keep.astype(np.int8), prepend=0, append=0))
                texts.append(b"".join(s.data[starts[a] : reach[b - 1]].tobytes() for a, b in zip(edge[::2], edge[1::2])).strip())
            old = column(batch, "text")
            new = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
            arrays = [pa.compute.if_else(old.is_valid(), new, None) if c == "text" else column(batch, c) for c in names]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = docs.schema
    out = rows.transform(mapped, run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out
