"""Best-fit packing with exact complements: documents as token pieces into sequences of a fixed capacity.

Only lengths decide, and there are at most ``capacity`` of them, so the plan is made from a histogram: how many pieces
there are of each length.  An index of single, pair and triple length sums answers which one, two or three lengths exactly
fill the gap that a piece leaves; each found combination is consumed as often as the counts allow, so that every step
exhausts a length.  What has no exact complement is packed best fit, longest first, the same way.  A plan is a list of
patterns with multiplicities; its size depends on the capacity, never on the number of documents.  Documents then find
their place by their rank among pieces of equal length, which is counted in salted groups, so that a length which a third
of all documents share is spread over tasks.

Rules for odd rows: a null text is empty and is one piece with only the end id; repeated rows are packed each; a document
longer than the capacity is cut into full pieces with the shorter rest first; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import crc, encoded_slabs
from .blocks import column
from .runtime import mapped, parts, prepare, written

CAPACITY, END = 2048, 0


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens, end included: full ones, the rest before them."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for first, count, ids, bounds in encoded_slabs(batch, "text", path, chunks=False):
                for i in range(count):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end))
                    for k, (s, n) in enumerate(cut(len(own), capacity)):
                        at.append(first + i)
                        rows.append((k, s, n, crc(own[s : s + n])))
            k, s, n, c = map(list, zip(*rows)) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").take(pa.array(at, pa.int64())), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(mapped, run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class SumIndex:
    """Which lengths are available, and which sums two of them reach."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.count[length] = n
        self.refresh()

    def refresh(self) -> None:
        self.there = self.count > 0
        n = 2 * len(self.there)
        f = np.fft.rfft(self.there.astype(float), n)
        self.pairs = np.fft.irfft(f * f, n)[: len(self.there)] > 0.5

    def splits(self, total: int, other: np.ndarray) -> np.ndarray:
        """Lengths a, longest first, that are available with total - a in ``other``."""
        if total < 2:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.there[1:total] & other[total - 1 : 0 : -1])[::-1] + 1

    def times(self, combo: tuple[int, ...]) -> int:
        return min(int(self.count[x]) // k for x, k in Counter(combo).items())

    def fill(self, length: int, gap: int):
        """A combination with ``length`` that exactly fills the gap with one, two or three others, if the counts allow one."""
        if gap and self.there[gap] and self.times((length, gap)):
            return length, gap
        for a in self.splits(gap, self.there):
            if 2 * a >= gap and self.times(found := (length, int(a), int(gap - a))):
                return found
        for a in self.splits(gap, self.pairs):
            rest = int(gap - a)
            for b in self.splits(rest, self.there)[:4]:
                if self.times(found := (length, int(a), int(b), rest - int(b))):
                    return found
        return None

    def take(self, combo: tuple[int, ...]) -> int:
        n = self.times(combo)
        gone = False
        for x in combo:
            self.count[x] -= n
            gone |= self.count[x] == 0
        if gone:
            self.refresh()
        return n


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order) and how many sequences have each; together they use exactly the counted pieces."""
    out = []
    index = SumIndex(counts, capacity)
    if index.count[capacity]:
        out.append(((capacity,), index.take((capacity,))))
    for length in range(capacity - 1, 0, -1):
        while index.count[length] and (found := index.fill(length, capacity - length)):
            out.append((found, index.take(found)))
    while len(left := np.flatnonzero(index.count)):
        combo, gap, used = [int(left[-1])], capacity - int(left[-1]), Counter([int(left[-1])])
        while gap:
            fit = left[: np.searchsorted(left, gap, side="right")]
            x = next((int(x) for x in fit[::-1] if index.count[x] > used[int(x)]), 0)
            if not x:
                break
            combo.append(x)
            used[x] += 1
            gap -= x
        n = index.times(tuple(combo))
        for x in combo:
            index.count[x] -= n
        out.append((tuple(combo), n))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each slot of each pattern: which ranks of its length it takes, from which sequence on, at which offset."""
    rank: Counter = Counter()
    rows, base = [], 0
    for combo, n in patterns:
        offset = 0
        for x in combo:
            rows.append((x, rank[x], base, offset))
            rank[x] += n
            offset += x
        base += n
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 4).T))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    spark = docs.sparkSession
    rows = written(pieces(docs, path, capacity, end), "pieces")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts(spark))))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.groupBy("length").agg(F.sum("_n").alias("n"), F.collect_list(F.struct("_salt", "_n")).alias("by"))
    counts = written(counts, "lengths")  # a row for each length, an entry for each salt
    histogram = {r["length"]: r["n"] for r in counts.select("length", "n").collect()}
    place = slots(plan(histogram, capacity))
    before = counts.select("length", F.explode(F.transform("by", lambda x: F.struct(x["_salt"].alias("_salt"), F.aggregate("by", F.lit(0).cast("long"), lambda s, y: s + F.when(y["_salt"] < x["_salt"], y["_n"]).otherwise(0)).alias("_before")))).alias("b")).select("length", "b._salt", "b._before")
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "_salt"]).select(*rows.columns, (F.col("_rank") + F.col("_before")).alias("_rank"))

    names = rows.columns

    def run(batches):
        starts = np.searchsorted(place["length"], np.arange(capacity + 2))
        for batch in batches:
            length = column(batch, "length").to_numpy(zero_copy_only=False)
            rank = column(batch, "_rank").to_numpy(zero_copy_only=False)
            at = np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length):
                own = length == x
                at[own] = starts[x] + np.searchsorted(place["rank"][starts[x] : starts[x + 1]], rank[own], side="right") - 1
            seq = place["sequence"][at] + rank - place["rank"][at]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(seq), pa.array(place["offset"][at])], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return ranked.transform(mapped, run, f"{kinds}, sequence_id long, offset long")
