"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs of the training texts are quantised on a logarithmic scale.  An n-gram of level q is put
into the filter once for each level 1..q; its count is read back by probing level after level until one is absent.  The
filter is blocked (all probes of a key fall into one segment), is built in segments by the workers, and is broadcast.
Word pairs seen once leave their mass to the words: they would tell as much as the filter's false positives do.

    P(w | v) = (1 - m) * P(w) + m * c(v w) / c(v),   P(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))

with c(v w) and c(v) read from the filter, rounded so that the ratios of a context never add up to more than 1, and m
grows with the logarithm of the context's count (``MIX`` for each doubling, up to ``MOST_MIX``): a frequent context has
told most of what can follow it, a rare one hasn't.  P(w) comes from exact counts: the most frequent words, up to ``FREQUENT_WORDS``,
are broadcast; occurrences of the others are shuffled to their counts, one row for each text and word.

A filter is bounded by ``FILTER_BYTES``.  Where the training texts need more, it is split by ranges of the first word's
hash, which leads a pair's key, into as many filters, each sized from its own words and pairs; texts are read once for each:
every position is then scored with the filter of its context.  Only a single leading value that needs more exceeds the bound.
Rules for odd rows: a null text is empty and has one token, the end; a null doc_id's remainder is that of the empty text's
hash; rows that repeat an id are each scored (repeats equal in id and text score alike); without training texts N = V = 0.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import column, crc32_of_ids, mix64, slabs
from .runtime import parts, prepare, written

_U = np.uint64
END = _U(0x5E0F5E0F5E0F5E0F)
START = _U(0x57A2757A2757A275)
ADD = 0.1
#: Weights fitted once on training texts set apart by another remainder of the same hash.
MIX, MOST_MIX = 0.035, 0.6
#: Quantisation: level q stands for counts from STEP ** (q - 1) on, in units of the least stored count.
STEP = 1.4
PAIR_LEAST = 2
PROBES, BITS = 6, 10
SEGMENT = 1 << 13
#: Bits of its first word's hash that lead a pair's key.
LEAD = 12
FILTER_BYTES = 64 << 20
FREQUENT_WORDS = 1 << 19
BLOCK_WORDS = 1_000_000


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    tail = mix64(v * _U(0x9E3779B97F4A7C15) + w * _U(3) + _U(1)) >> _U(LEAD)
    return (v >> _U(64 - LEAD) << _U(64 - LEAD)) | tail


def level(count: np.ndarray, least: int) -> np.ndarray:
    return (np.log(np.maximum(count, least) / least) / math.log(STEP) + 1e-9).astype(np.int64) + 1


def low(q: np.ndarray, least: int) -> np.ndarray:
    """The least count of a level."""
    return least * STEP ** (q - 1.0)


class Filter:
    """Segments of bits; a key at a level has PROBES bits in one segment."""

    def __init__(self, segments: int, data: np.ndarray | None = None):
        self.segments = segments
        self.data = np.zeros(segments * SEGMENT, dtype=np.uint8) if data is None else data

    def segment(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> _U(20)) % _U(self.segments)).astype(np.int64)

    def bits(self, keys: np.ndarray, q) -> np.ndarray:
        """Bit places in a segment, a row for each probe."""
        x = mix64(keys + np.asarray(q, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
        a, b = x & _U(0xFFFFFFFF), (x >> _U(32)) | _U(1)
        return np.stack([((a + _U(i) * b) % _U(SEGMENT * 8)).astype(np.int64) for i in range(PROBES)])

    def has(self, keys: np.ndarray, q: int) -> np.ndarray:
        base = self.segment(keys) * SEGMENT
        alive = np.arange(len(keys))
        places = self.bits(keys, q)
        for row in places:
            bit = row[alive]
            alive = alive[(self.data[base[alive] + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(keys), dtype=bool)
        out[alive] = True
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level after level until one is absent: 0 for what isn't there."""
        out = np.zeros(len(keys), dtype=np.int64)
        some, back = np.unique(keys, return_inverse=True)
        found, alive, q = np.zeros(len(some), dtype=np.int64), np.arange(len(some)), 1
        while len(alive):
            alive = alive[self.has(some[alive], q)]
            found[alive] = q
            q += 1
        out[:] = found[back]
        return out


def tokens(slab) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the lower-cased words with END after each text, bounds)."""
    w = slab.words()
    ends = w.bounds[1:]
    return np.insert(w.hashes(lower=True), ends, END), np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])


def contexts(t: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    v = np.empty_like(t)
    v[1:] = t[:-1]
    v[bounds[:-1]] = START
    return v


def _held_out(ids) -> np.ndarray:
    return crc32_of_ids(ids.to_pylist()) % 10 == 0


def _deal(kind: int, keys: np.ndarray, n: int):
    """Rows (bucket, kind, keys, counts) of the different keys."""
    keys, count = np.unique(keys, return_counts=True)
    order = np.argsort((keys % _U(n)).astype(np.int64), kind="stable")
    keys, count = keys[order], count[order].astype(np.uint32)
    cut = np.searchsorted((keys % _U(n)).astype(np.int64), np.arange(n + 1))
    full = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays(
        [pa.array(full.astype(np.int32)), pa.array([kind] * len(full), pa.int32()), pa.array([keys[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()), pa.array([count[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary())],
        names=["bucket", "kind", "keys", "counts"],
    )


def count(docs: DataFrame) -> DataFrame:
    """kind (1 words, 2 pairs), key, n of all training texts: counted in blocks of texts, then summed by key."""
    n = parts(docs.sparkSession)

    def send(batches):
        held: dict[int, list[np.ndarray]] = {1: [], 2: []}
        size = 0

        def out():
            for kind, keys in held.items():
                if keys:
                    yield _deal(kind, np.concatenate(keys), n)
                    held[kind] = []

        for batch in batches:
            train = ~_held_out(column(batch, "doc_id"))
            for s in slabs(column(batch, "text")):
                t, bounds = tokens(s)
                use = np.repeat(train[s.first : s.first + len(s)], np.diff(bounds))
                v = contexts(t, bounds)
                held[1].append(t[use])
                held[2].append(pair(v, t)[use])
                size += len(t)
                if size > BLOCK_WORDS:
                    yield from out()
                    size = 0
        yield from out()

    def meet(batches):
        got: dict[int, list] = {1: [], 2: []}
        for b in batches:
            for kind, keys, counts in zip(column(b, "kind").to_pylist(), column(b, "keys").to_pylist(), column(b, "counts").to_pylist()):
                got[kind].append((np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<u4")))
        for kind, blobs in got.items():
            if blobs:
                keys, back = np.unique(np.concatenate([x[0] for x in blobs]), return_inverse=True)
                total = np.bincount(back, weights=np.concatenate([x[1] for x in blobs])).astype(np.int64)
                # Pairs below the least stored count leave only their number, as key 0.
                keep = total >= (1 if kind == 1 else PAIR_LEAST)
                for i in range(0, int(keep.sum()), 100_000):
                    k, c = keys[keep][i : i + 100_000], total[keep][i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(k), pa.int32()), pa.array(k.astype(np.int64)), pa.array(c)], names=["kind", "key", "n"])

    return docs.select("doc_id", "text").mapInArrow(send, "bucket int, kind int, keys binary, counts binary").repartition(n, "bucket").mapInArrow(meet, "kind int, key long, n long")


def build(counted: DataFrame, segments: int) -> np.ndarray:
    """The filter's bytes, made by the workers segment by segment; their number is bounded by the caller."""
    n = parts(counted.sparkSession)
    shape = Filter(segments, np.zeros(0, np.uint8))

    def split(batches):
        for batch in batches:
            keys, kind, c = column(batch, "key").to_numpy().astype(np.uint64), column(batch, "kind").to_numpy(), column(batch, "n").to_numpy()
            q = np.where(kind == 1, level(c, 1), level(c, PAIR_LEAST)).astype(np.uint8)
            group = shape.segment(keys) % n
            order = np.argsort(group, kind="stable")
            full, first = np.unique(group[order], return_index=True)
            cut = np.append(first, len(order))
            own = [order[cut[i] : cut[i + 1]] for i in range(len(full))]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([keys[o].tobytes() for o in own], pa.binary()), pa.array([q[o].tobytes() for o in own], pa.binary())], names=["bucket", "keys", "levels"])

    def fill(batches):
        rows = [(k, q) for b in batches for k, q in zip(column(b, "keys").to_pylist(), column(b, "levels").to_pylist())]
        if not rows:
            return
        keys, q = np.frombuffer(b"".join(r[0] for r in rows), "<u8"), np.frombuffer(b"".join(r[1] for r in rows), "u1").astype(np.int64)
        at = np.repeat(np.arange(len(keys)), q)
        each = np.arange(len(at)) - np.repeat(np.cumsum(q) - q, q) + 1
        where = shape.segment(keys)
        used, slot = np.unique(where, return_inverse=True)
        data = np.zeros(len(used) * SEGMENT, dtype=np.uint8)
        for bit in shape.bits(keys[at], each):
            np.bitwise_or.at(data, slot[at] * SEGMENT + (bit >> 3), (1 << (bit & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([data[i * SEGMENT : (i + 1) * SEGMENT].tobytes() for i in range(len(used))], pa.binary())], names=["segment", "data"])

    out = np.zeros(segments * SEGMENT, dtype=np.uint8)
    got = counted.mapInArrow(split, "bucket int, keys binary, levels binary").repartition(n, "bucket").mapInArrow(fill, "segment long, data binary").toArrow()
    for s, raw in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        out[s * SEGMENT : (s + 1) * SEGMENT] = np.frombuffer(raw, dtype=np.uint8)
    return out


def score(docs: DataFrame, filter_bytes: int = FILTER_BYTES, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    spark = prepare(docs.sparkSession)
    counted = written(count(docs), "counts")
    words = counted.where("kind = 1").select("key", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    size_n, size_v = int(total["n"]), int(total["v"])
    below = size_n + ADD * (size_v + 1)
    # The least count of a frequent word, from the numbers of words by count: a row for each power of two.
    by = {r["b"]: r["c"] for r in words.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()}
    bar, many = 1 + max(by, default=0), 0
    while bar > 0 and many + by.get(bar - 1, 0) <= frequent_words:
        bar -= 1
        many += by.get(bar, 0)
    least = 2**bar
    top = words.where(F.col("n") >= least).toArrow()
    order = np.argsort(top.column("key").to_numpy().astype(np.uint64))
    frequent = top.column("key").to_numpy().astype(np.uint64)[order], top.column("n").to_numpy()[order]
    rare = written(words.where((F.col("n") < least)), "rare") if bar else words.limit(0)

    stored = counted.where(f"kind = 2 OR n >= {PAIR_LEAST}")
    levels = F.floor(F.log(F.col("n") / F.when(F.col("kind") == 1, 1).otherwise(PAIR_LEAST)) / math.log(STEP) + 1e-9) + 1
    entries = {r["lead"]: int(r["e"]) for r in stored.groupBy(F.shiftrightunsigned("key", 64 - LEAD).alias("lead")).agg(F.sum(levels).alias("e")).collect()}
    ranges = shards(entries, filter_bytes)
    passes = [_pass(docs, stored, frequent, below, *own).withColumn("_rows", F.when(F.col("word").isNull(), int(own[0] == 0)).otherwise(0)) for own in ranges]
    rows = written(reduce(DataFrame.unionByName, passes), "positions")

    known = rows.where("word IS NOT NULL").join(rare.withColumnRenamed("key", "word"), "word", "left")
    p = (F.coalesce("n", F.lit(0)) + ADD) / F.lit(below)
    tail = known.select(
        "_key", "doc_id", "_rows",
        F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("n_known"), F.lit(0).cast("long").alias("n_tokens"),
        (F.col("times") * F.log10(p)).alias("base_score"), (F.col("times") * F.log10(F.col("part") + F.col("left") * p)).alias("score"),
    )
    whole = rows.where("word IS NULL").select("_key", "doc_id", "_rows", "n_known", "n_tokens", "base_score", "score")
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    out = tail.unionByName(whole).groupBy("_key", "doc_id").agg(*sums, F.sum("_rows").alias("_rows"))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("_rows").cast("int")))
    each = [(F.col(c) / F.col("_rows")).cast(t).alias(c) for c, t in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double"))]
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10)) == 0
    return out.select("doc_id", *each, copies.alias("_c")).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(size_n).cast("long").alias("train_tokens"), "base_score", "score")


def shards(entries: dict[int, int], filter_bytes: int) -> list[tuple[int, int, int]]:
    """(first, end, segments) of ranges of leading values, each with BITS an entry within filter_bytes where it can."""
    size = lambda n: max(1, -(-n * BITS // (8 * SEGMENT)))
    out, first, held = [], 0, 0
    for lead in range(1 << LEAD):
        own = entries.get(lead, 0)
        if held and size(held + own) * SEGMENT > filter_bytes:
            out.append((first, lead, size(held)))
            first, held = lead, 0
        held += own
    return [*out, (first, 1 << LEAD, size(held))]


def _pass(docs: DataFrame, stored: DataFrame, frequent, below: float, first: int, end: int, segments: int) -> DataFrame:
    """Sums over the positions whose context's leading value is in a range, and rows for those whose word isn't frequent.

    A range's filter holds its words and all pairs that begin with them, so that a position asks the filter of its context."""
    spark = docs.sparkSession
    whole = end - first == 1 << LEAD
    own = stored if whole else stored.where(F.shiftrightunsigned("key", 64 - LEAD).between(first, end - 1))
    shared = spark.sparkContext.broadcast((build(own, segments), *frequent))

    def run(batches):
        data, top, top_n = shared.value
        bloom = Filter(segments, data)
        for batch in batches:
            ids, keys = column(batch, "doc_id"), column(batch, "_key")
            for s in slabs(column(batch, "text")):
                t, bounds = tokens(s)
                doc = np.repeat(np.arange(len(s)), np.diff(bounds))
                v = contexts(t, bounds)
                both = pair(v, t)
                if not whole:
                    lead = v >> _U(64 - LEAD)
                    mine = (lead >= _U(first)) & (lead < _U(end))
                    t, v, both, doc = t[mine], v[mine], both[mine], doc[mine]
                at = np.minimum(np.searchsorted(top, t), max(len(top) - 1, 0))
                hit = top[at] == t if len(top) else np.zeros(len(t), dtype=bool)
                p = (np.where(hit, top_n[at] if len(top) else 0, 0) + ADD) / below
                q, c = bloom.levels(both), bloom.levels(v)
                # A count from below over one from above; START stands for the texts, all of which have one.
                some = (q > 0) & ((c > 0) | (v == START))
                ratio = np.where(some, low(q, PAIR_LEAST) / low(c + 1.0, 1), 0.0)
                starts = v == START
                ratio[starts] = 0.0
                has = (c > 0) & ~starts
                m = np.where(has, np.minimum(MOST_MIX, MIX * np.log2(1 + low(c, 1))), 0.0)
                part, left = m * np.minimum(ratio, 1.0), 1 - m
                n = len(s)
                add = lambda x: np.bincount(doc[hit], weights=x[hit], minlength=n)
                sums = [np.bincount(doc, minlength=n), np.bincount(doc[hit], minlength=n), add(np.log10(p)), add(np.log10(part + left * p))]
                rest = np.flatnonzero(~hit)
                rest = rest[np.lexsort((part[rest], left[rest], t[rest], doc[rest]))]
                same = np.concatenate([[True], (t[rest][1:] != t[rest][:-1]) | (doc[rest][1:] != doc[rest][:-1]) | (part[rest][1:] != part[rest][:-1]) | (left[rest][1:] != left[rest][:-1])]) if len(rest) else np.zeros(0, bool)
                begin = rest[same]
                times = np.diff(np.append(np.flatnonzero(same), len(rest)))
                where = pa.array(np.concatenate([np.arange(n), doc[begin]]) + s.first)
                k = len(begin)
                both_ = lambda a, b, kind: pa.array(np.concatenate([a, b]), kind)
                zero, none = np.zeros(k), np.zeros(n)
                word = pa.array(np.concatenate([np.zeros(n, np.int64), t[begin].astype(np.int64)]), mask=np.arange(n + k) < n)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(where), ids.take(where), word, both_(none.astype(np.int64), times, pa.int64()), both_(none, part[begin], pa.float64()), both_(none, left[begin], pa.float64()), both_(sums[0], zero.astype(np.int64), pa.int64()), both_(sums[1], zero.astype(np.int64), pa.int64()), both_(sums[2], zero, pa.float64()), both_(sums[3], zero, pa.float64())],
                    names=["_key", "doc_id", "word", "times", "part", "left", "n_tokens", "n_known", "base_score", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_key")).mapInArrow(run, f"_key long, doc_id {kind}, word long, times long, part double, left double, n_tokens long, n_known long, base_score double, score double")

