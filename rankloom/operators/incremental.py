"""Snapshots and changes: what to index anew, what to drop, what to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (new, modified, touched, same, deleted) of two snapshots (path, mtime, content_hash)."""
    o = old.select("path", F.col("mtime").alias("_om"), F.col("content_hash").alias("_oh"))
    both = o.join(new.select("path", "mtime", "content_hash"), "path", "full_outer")
    what = (
        F.when(F.col("_oh").isNull(), "new").when(F.col("content_hash").isNull(), "deleted").when(F.col("_om") == F.col("mtime"), "same")
        .when(F.col("_oh") != F.col("content_hash"), "modified").otherwise("touched")
    )
    return both.select("path", what.alias("change"))


def apply_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The next snapshot, with the columns of old: what was derived from a file (chunk_ids and the like) stays while its
    content does, under the new time, and is null where the file is new or modified; deleted files go."""
    derived = [c for c in old.columns if c not in ("path", "mtime", "content_hash")]
    kept = old.select(F.col("path").alias("_path"), F.col("content_hash").alias("_hash"), *derived)
    same = (F.col("path") == F.col("_path")) & F.col("content_hash").eqNullSafe(F.col("_hash"))
    return new.select("path", "mtime", "content_hash").join(kept, same, "left").select(*old.columns)


def orphans(stored: DataFrame, index: DataFrame) -> DataFrame:
    """Stored chunk ids that no file of the index (path, chunk_ids) names."""
    return stored.join(index.select(F.explode("chunk_ids").alias("id")).distinct(), "id", "left_anti")


def chunks_of(files: DataFrame, index: DataFrame) -> DataFrame:
    """The ids of the chunks of some files: what goes when the files go."""
    return index.join(files.select("path"), "path", "left_semi").select("path", F.explode("chunk_ids").alias("id"))


def stored_memory(rows: DataFrame, codebase: str) -> DataFrame:
    """Defaults of new memories: known types only, decisions and lessons pinned and tagged, the codebase as a tag."""
    known = F.when(F.col("memory_type").isin("code", "conversation", "decision", "lesson"), F.col("memory_type")).otherwise("conversation")
    lasting = F.col("memory_type").isin("decision", "lesson")
    role = F.when(F.lower("role").isin("user", "assistant", "system", "tool"), F.lower("role")).otherwise("user")
    tags = F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.when(lasting, F.array(F.col("memory_type"))).otherwise(F.array().cast("array<string>")), F.array(F.lit(f"codebase:{codebase}"))))
    return rows.withColumns({"memory_type": known, "role": role, "pin": F.coalesce("pin", F.lit(False)) | lasting, "tags": tags})


def prune(memories: DataFrame, project: str | None, cutoff: Column, honour_pin: bool = False) -> DataFrame:
    """All rows with ``keep``: indexed code, decisions and lessons, other projects, and what is newer than the cutoff."""
    keep = (F.col("source") == "codebase_indexing") | F.col("memory_type").isin("decision", "lesson") | F.coalesce(F.col("created_at") > cutoff, F.lit(False))
    keep = keep | (F.col("project_id") != project) if project is not None else keep
    keep = keep | F.col("pin") if honour_pin else keep
    return memories.withColumn("keep", keep)


def prune_counts(marked: DataFrame) -> DataFrame:
    return marked.agg(F.sum(F.when(F.col("keep"), 0).otherwise(1)).alias("pruned"), F.sum(F.when(F.col("keep"), 1).otherwise(0)).alias("kept"), F.count(F.lit(1)).alias("total"))


def needs_summary(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """Files (path, content_hash) without a summary of that content."""
    return files.join(summaries.select("path", F.col("content_hash").alias("_h")), "path", "left").where(F.col("_h").isNull() | (F.col("_h") != F.col("content_hash"))).drop("_h")


def summary_queue(files: DataFrame, done: DataFrame, scores: DataFrame, skip: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Files still to be summarised, the most central first; skip: patterns with * and ?."""
    rows = files.join(done.select("file_id"), "file_id", "left_anti").join(scores, "file_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    for pattern in skip:
        rows = rows.where(~F.col("path").rlike(glob(pattern)))
    rows = rows.select("file_id", "path", "score").orderBy(F.desc("score"), F.desc("path"))
    return rows.limit(limit) if limit else rows


def glob(pattern: str) -> str:
    """A pattern with * and ? as a regular expression for the whole text."""
    import re

    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_n", best).where("_n = 1").drop("_n")


def delete_first(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows (store, id, ...) without the ids in gone: an id goes from the first store, by name, that has it, and stays in others."""
    first = rows.join(gone.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("store").alias("store"))
    return rows.join(first, ["id", "store"], "left_anti")


SUMMARY_SOURCE = "llm_summarization"


def invalidate(summaries: DataFrame, chunks: DataFrame, codebases: DataFrame, version: str) -> DataFrame:
    """codebase, summaries_cleared, chunks_removed and the schema version that codebases have after losing all summaries:
    rows of summaries (codebase), and rows of chunks (codebase, source) that summaries were stored as."""
    lost = lambda rows, name: rows.groupBy("codebase").agg(F.count(F.lit(1)).alias(name))
    out = codebases.select("codebase").join(lost(summaries, "summaries_cleared"), "codebase", "left")
    out = out.join(lost(chunks.where(F.col("source") == SUMMARY_SOURCE), "chunks_removed"), "codebase", "left")
    return out.fillna(0).withColumn("schema_version", F.lit(version))


def without_summaries(chunks: DataFrame, codebases: DataFrame) -> DataFrame:
    """The chunks that stay when the summaries of some codebases are invalidated."""
    gone = codebases.select("codebase").distinct().withColumn("source", F.lit(SUMMARY_SOURCE))
    return chunks.join(gone, ["codebase", "source"], "left_anti").select(*chunks.columns)
