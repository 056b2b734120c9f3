"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors become integers floor(scale * x).  For each resolution, a vector is cut into equal segments and each segment is
kept as its mean and deviation.  The squared distance of two vectors is at least the sum over segments of
length * ((difference of means)**2 + (difference of deviations)**2); since <q, x> = (|q|**2 + |x|**2 - d**2) / 2, a lower
bound of the distance is an upper bound of the score.  Bounds are evaluated coarse to fine against the k-th best score
that a query has so far; only survivors get their exact integer score, so the result is exact.

Queries are taken in bounded groups (``GROUP_BYTES`` of vectors, ``GROUP_QUERIES`` of them), each of which is sent to all
workers and meets all rows in blocks of up to ``CELLS`` pairs, which bounds a task's memory whatever the number of queries;
a task keeps k rows for a query, and the k best of all tasks are ranked in the end, ties to the smaller id.  Exact search
of more queries takes more groups, and each reads all rows.

Rules for odd rows: vectors that are null, empty or hold a null or non-finite component take no part; vectors of another
length than a query's are no candidates of it; repeated rows each count, with the smaller id first and else in any order;
a row is no candidate of a query with its own id; null ids take no part; a score beyond the range of 64-bit integers is
given as the nearest of them; further columns don't matter, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import column
from .runtime import prepare, written

SCALE, EVERY, K = 1024, 100, 10
RESOLUTIONS = (1, 4, 16)
GROUP_BYTES = 16 << 20
GROUP_QUERIES = 16_384
CELLS = 1 << 21


def usable(vector: str = "embedding"):
    """Whether a vector takes part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(vectors.astype(np.float64) * scale)


class Sketch:
    """Means and deviations of the segments of some vectors at each resolution."""

    def __init__(self, x: np.ndarray):
        self.norm = np.einsum("ij,ij->i", x, x)
        self.levels = []
        for n in RESOLUTIONS:
            if n <= x.shape[1]:
                edge = np.linspace(0, x.shape[1], n + 1).astype(int)
                size = np.diff(edge)
                mean = np.add.reduceat(x, edge[:-1], axis=1) / size
                var = np.add.reduceat(x * x, edge[:-1], axis=1) / size - mean * mean
                self.levels.append((mean * np.sqrt(size), np.sqrt(np.maximum(var, 0)) * np.sqrt(size)))

    def most(self, i: np.ndarray, other: Sketch, j: np.ndarray, level: int) -> np.ndarray:
        """Upper bounds of the scores of own rows i with other's rows j (a hair is added for rounding)."""
        (m, s), (a, b) = self.levels[level], other.levels[level]
        bound = np.einsum("ij,ij->i", m[i], a[j]) + np.einsum("ij,ij->i", s[i], b[j])
        return bound + 1e-9 * (self.norm[i] + other.norm[j]) + 1

    def coarse(self, other: Sketch) -> np.ndarray:
        (m, s), (a, b) = self.levels[0], other.levels[0]
        return m @ a.T + s @ b.T + 1e-9 * (self.norm[:, None] + other.norm[None, :]) + 1


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of equal rows: in doubles where all sums are below 2**53, else in 64-bit integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    if top < 2**62:
        return np.einsum("ij,ij->i", q.astype(np.int64), x.astype(np.int64))
    exact = (sum(int(a) * int(b) for a, b in zip(u, v)) for u, v in zip(q.tolist(), x.tolist()))
    return np.array([max(-(2**63), min(2**63 - 1, n)) for n in exact], dtype=np.int64)


class Best:
    """For each query the k best (score, id) so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k, self.sketch = ids, q, k, Sketch(q)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bar = np.full(len(q), -np.inf)
        self.compact()

    def offer(self, ids: np.ndarray, x: np.ndarray) -> None:
        sketch = Sketch(x)
        qi, xi = np.nonzero(self.sketch.coarse(sketch) >= self.bar[:, None])
        for level in range(1, len(self.sketch.levels)):
            keep = self.sketch.most(qi, sketch, xi, level) >= self.bar[qi]
            qi, xi = qi[keep], xi[keep]
        own = self.ids[qi] == ids[xi]
        qi, xi = qi[~own], xi[~own]
        score = np.concatenate([_exact(self.q[qi[i : i + 50_000]], x[xi[i : i + 50_000]]) for i in range(0, len(qi), 50_000)] + [np.zeros(0, np.int64)])
        keep = score >= self.bar[qi]
        self.rows.append((qi[keep], ids[xi[keep]], score[keep]))
        self.compact()

    def compact(self) -> None:
        q, v, s = (np.concatenate([r[i] for r in self.rows] + [np.zeros(0, np.int64)]) for i in range(3))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        first = np.searchsorted(q, q)
        rank = np.arange(len(q)) - first
        keep = rank < self.k
        self.rows = [(q[keep], v[keep], s[keep])]
        last = rank == self.k - 1
        self.bar[q[last]] = s[last]


def _matrix(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows by their length: (places, components)."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.values.to_numpy(zero_copy_only=False)
    starts = vectors.offsets.to_numpy()[:-1]
    return {int(n): (np.flatnonzero(sizes == n), flat[(starts[sizes == n][:, None] + np.arange(n))]) for n in np.unique(sizes)}


def search(rows: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, its k best other rows."""
    spark = prepare(rows.sparkSession)
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable())
    queries = written(good.where(F.col("vec_id") % every == 0).withColumn("_n", F.size("embedding")), "queries")
    sizes = queries.agg(F.count(F.lit(1)), F.max("_n")).first()
    groups = max(1, -(-sizes[0] * (sizes[1] or 1) * 8 // GROUP_BYTES), -(-sizes[0] // GROUP_QUERIES))
    found = []
    for g in range(groups):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).select("vec_id", "embedding").toArrow().combine_chunks()
        ids = own.column("vec_id").to_numpy()
        chunks = own.column("embedding").combine_chunks() if len(ids) else None
        held = {n: (ids[at], integers(x, scale)) for n, (at, x) in _matrix(chunks).items()} if len(ids) else {}
        shared = spark.sparkContext.broadcast(held)

        def run(batches, shared=shared):
            best = {n: Best(i, q, k) for n, (i, q) in shared.value.items()}
            for batch in batches:
                ids = column(batch, "vec_id").to_numpy()
                for n, (at, x) in _matrix(column(batch, "embedding")).items():
                    step = max(1, CELLS // max(len(best[n].ids), 1)) if n in best else 1
                    for i in range(0, len(at) if n in best else 0, step):
                        best[n].offer(ids[at[i : i + step]], integers(x[i : i + step], scale))
            for b in best.values():
                q, v, s = b.rows[0]
                yield pa.RecordBatch.from_arrays([pa.array(b.ids[q]), pa.array(q), pa.array(v), pa.array(s)], names=["query_id", "copy", "vec_id", "score"])

        found.append(good.mapInArrow(run, "query_id long, copy long, vec_id long, score long"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
