"""A whole search as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..operators import search as S


def search(chunks: DataFrame, query: str, k: int, as_of, project: str | None = None, include=(), exclude=(), summarized: DataFrame | None = None, vectors: DataFrame | None = None, vector: list[float] | None = None, mode: str = "keyword") -> DataFrame:
    """Retrieve 2k, then: project, boosts, tags, de-duplication, summaries, the k best, snippets."""
    word = S.keyword_search(chunks, query, 2 * k) if mode != "semantic" else None
    near = S.vector_search(vectors, vector, 2 * k).withColumnRenamed("relevance", "score") if mode != "keyword" else None
    hits = word if near is None else near if word is None else S.fuse(near, word, 2 * k).select("id", "score")
    # At most 2k rows: a broadcast of fixed size against the scan.
    rows = chunks.join(F.broadcast(hits), "id")
    if project is not None:
        rows = rows.where(F.col("project_id") == project)
    rows = S.dedup(S.tag_filter(S.boosted(rows, as_of), include, exclude))
    rows = S.summary_boost(rows, summarized) if summarized is not None else rows.withColumn("has_summary", F.lit(False))
    return S.ranked(rows, k).select("id", "project_id", snippet(F.col("content")).alias("content"), "score", "has_summary")
