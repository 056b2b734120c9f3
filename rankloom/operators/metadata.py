"""The relational side: files, codebases and summaries; pages, counts, statistics, upserts and deletes.

Nothing is updated in place: an upsert or delete is a new snapshot, which a job writes beside the old one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def file_page(files: DataFrame, bases: DataFrame, summaries: DataFrame, limit: int, offset: int = 0, codebase: str | None = None, language: str | None = None, has_summary: bool | None = None, search: str | None = None) -> DataFrame:
    """Files with codebase and summary, newest summary first."""
    rows = files.join(bases, "codebase_id").join(summaries, "file_id", "left")
    for c, v in (("codebase", codebase), ("language", language)):
        rows = rows.where(F.col(c) == v) if v is not None else rows
    if has_summary is not None:
        rows = rows.where(F.col("pattern").isNotNull() if has_summary else F.col("pattern").isNull())
    if search:
        rows = rows.where(F.contains(F.lower("path"), F.lit(search.lower())))
    return page(rows.select("file_id", "path", "codebase", "language", "pattern", "status", F.col("pattern").isNotNull().alias("has_summary")), [F.desc("has_summary"), F.asc("path")], limit, offset)


def with_summary(files: DataFrame, summaries: DataFrame, wanted: bool = True) -> DataFrame:
    return files.join(summaries.select("file_id"), "file_id", "left_semi" if wanted else "left_anti")


def summary_page(files, bases, summaries, limit: int, offset: int = 0, **equal: str) -> DataFrame:
    rows = files.join(bases, "codebase_id").join(summaries, "file_id")
    for c, v in equal.items():
        rows = rows.where(F.col(c) == v)
    return page(rows.select("file_id", "path", "codebase", "pattern", "domain", "status", "summary_type"), [F.asc("path")], limit, offset)


def counts_by(summaries: DataFrame, c: str) -> DataFrame:
    return summaries.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def codebase_stats(files, bases, summaries) -> DataFrame:
    """A row for each codebase: files, summarised files, and summaries by type and status."""
    # One summary for a file at most: counts replace distinct counts, and partial sums do the rest before the shuffle.
    is_ = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).alias
    per_file = files.join(summaries, "file_id", "left").groupBy("codebase_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count("pattern").alias("summarized_files"),
        is_(F.col("summary_type") == "llm")("llm_summaries"),
        is_(F.col("summary_type") == "simple")("simple_summaries"),
        is_(F.col("status") == "F")("approved"),
        is_(F.col("status") == "P")("pending"),
        is_(F.col("status") == "O")("open"),
    )
    return bases.join(per_file, "codebase_id", "left").fillna(0).drop("codebase_id")


def totals(stats: DataFrame) -> DataFrame:
    return stats.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in stats.columns if c != "codebase"))


def summary_statistics(summaries: DataFrame) -> DataFrame:
    """kind, value, n: counts by pattern, domain, status and type from one pass."""
    kinds = ("pattern", "domain", "status", "summary_type")
    each = summaries.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds))).alias("x")).select("x.*")
    return each.where("value IS NOT NULL").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with the same key; a key that new repeats keeps its last row in order of all columns."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new"), *(F.desc(c) for c in old.columns)))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", last).where("_n = 1").drop("_n", "_new")


def delete_where(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def keep_listed(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return rows.join(listed.select(key).distinct(), key, "left_semi")


def set_status(summaries: DataFrame, ids: list[int], status: str) -> DataFrame:
    return summaries.withColumn("status", F.when(F.col("file_id").isin(*ids), status).otherwise(F.col("status")))


def validation_queue(summaries: DataFrame, status: str | None = None, pattern: str | None = None, limit: int = 10) -> DataFrame:
    """Summaries to review, oldest first, with the number reviewed before any filter."""
    n = summaries.agg(F.coalesce(F.sum(F.when(F.col("status") == "F", 1)), F.lit(0)).alias("n")).first()["n"]
    rows = summaries
    for c, v in (("status", status), ("pattern", pattern)):
        rows = rows.where(F.col(c) == v) if v is not None else rows
    return page(rows.select("file_id", "pattern", "status", F.lit(n).cast("long").alias("reviewed_count")), [F.asc("file_id")], min(max(limit, 1), 50))


def memory_page(memories: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    rows = memories.where(F.col("memory_type").isin("conversation", "decision", "lesson") & (F.col("source") != "llm_summarization"))
    preview = F.substring(F.coalesce(F.col("content"), F.lit("")), 1, 200)
    return page(rows.select("id", "memory_type", "created_at", preview.alias("preview")), [F.desc("created_at"), F.desc("id")], limit, offset)


def status_rollup(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """A row for each codebase: share of summarised files and a status by precedence."""
    r = files.join(summaries.select("file_id", "status"), "file_id", "left").groupBy("codebase_id").agg(F.count(F.lit(1)).alias("n_files"), F.count("status").alias("n_done"), F.max((F.col("status") == "P").cast("int")).alias("_p"))
    status = F.when(F.col("_p") == 1, "indexing").when(F.col("n_done") == F.col("n_files"), "completed").when(F.col("n_done") == 0, "not_started").otherwise("partial")
    return r.select("codebase_id", "n_files", "n_done", (F.col("n_done") / F.col("n_files")).alias("progress"), status.alias("status"))


def codebase_list(files: DataFrame, bases: DataFrame, most: int = 100) -> DataFrame:
    """codebase, n_files and the first paths; a group's list never holds more than ``most``."""
    first = F.row_number().over(Window.partitionBy("codebase_id").orderBy("path"))
    some = files.withColumn("_n", first).where(F.col("_n") <= most).groupBy("codebase_id").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return files.groupBy("codebase_id").agg(F.count(F.lit(1)).alias("n_files")).join(some, "codebase_id").join(bases, "codebase_id").select("codebase", "n_files", "paths")


PREVIEW = 300


def summary_listing(summaries: DataFrame, texts: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of summaries by path with preview and content, and the total.  Only the page's rows meet the texts
    (file_id, content): it has ``limit`` rows, which is what is broadcast."""
    rows = summaries.select("file_id", "path", "pattern", "domain", "summarized_at")
    wanted = F.broadcast(page(rows, [F.asc("path"), F.asc("file_id")], limit, offset))
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))
    content = F.coalesce("content", F.lit(""))
    preview = F.when(F.length(content) > PREVIEW, F.concat(F.substring(content, 1, PREVIEW), F.lit("..."))).otherwise(content)
    found = texts.select("file_id", "content").join(wanted, "file_id", "right")
    return found.join(total).select("path", "pattern", "domain", "summarized_at", preview.alias("content_preview"), content.alias("content"), "total", (F.lit(offset + limit) < F.col("total")).alias("has_more"))


def file_details(index: DataFrame, chunks: DataFrame, summaries: DataFrame, paths: DataFrame) -> DataFrame:
    """A row for each chunk of the files in paths (path, with either separator): the file's entry (mtime, content_hash,
    number of chunks found), the chunk, and the file's summary.  A file without chunks has one row with a null id."""
    plain = F.translate("path", "\\", "/")
    files = index.withColumn("_p", plain).join(paths.select(plain.alias("_p")).distinct(), "_p", "left_semi")
    own = files.select("_p", F.explode_outer("chunk_ids").alias("id")).join(chunks.select("id", "content", "tags").withColumn("_in", F.lit(1)), "id", "left")
    own = own.select("_p", F.when(F.col("_in") == 1, F.col("id")).alias("id"), "content", "tags")
    n = own.groupBy("_p").agg(F.count("id").alias("chunk_count"))
    rows = own.where("id IS NOT NULL").join(files.drop("chunk_ids").join(n, "_p"), "_p", "right")
    notes = summaries.select(plain.alias("_p"), "pattern", "domain")
    return rows.join(notes, "_p", "left").select("path", "mtime", "content_hash", "chunk_count", "id", "content", "tags", "pattern", "domain")


def counts_after(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counts (codebase, indexed, summarized) with signed changes of the same columns added; new codebases start at 0."""
    return counts.select("codebase", "indexed", "summarized").unionByName(deltas.select("codebase", "indexed", "summarized")).groupBy("codebase").agg(F.sum("indexed").alias("indexed"), F.sum("summarized").alias("summarized"))


def queue_progress(jobs: DataFrame, rate_limit: float = 0.0) -> DataFrame:
    """One row for jobs (state: queued, completed, failed or skipped; seconds): what is left, progress in percent and the time
    to go, which is the mean of completed ones and the pause between two, for each queued one."""
    is_ = lambda s: F.count_if(F.col("state") == s)
    mean = F.coalesce(F.avg(F.when(F.col("state") == "completed", F.col("seconds"))), F.lit(0.0))
    out = jobs.agg(is_("queued").alias("files_queued"), is_("failed").alias("files_failed"), F.count_if(F.col("state") != "queued").alias("files_processed"), F.count("state").alias("files_total"), mean.alias("avg_seconds"))
    percent = F.when(F.col("files_total") > 0, F.col("files_processed") / F.col("files_total") * 100).otherwise(0.0)
    return out.select("*", percent.alias("progress_percentage"), ((F.col("avg_seconds") + rate_limit) * F.col("files_queued")).alias("seconds_remaining"))


def full_summary(stored: DataFrame) -> DataFrame:
    """Whole summaries of stored ones (path, document, pattern, domain, model, content_hash, validation_status): a JSON
    object gives its own fields; other text is an old document, which is the purpose, with the rest from the metadata.
    Hash and status always come from the metadata; a missing status is unreviewed."""
    v = F.try_parse_json("document")
    json = v.isNotNull() & F.startswith(F.ltrim("document"), F.lit("{"))
    field = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    pick = lambda name, old: F.when(json, field(name)).otherwise(old)
    return stored.select(
        "path", pick("purpose", F.col("document")).alias("purpose"), pick("pattern", F.col("pattern")).alias("pattern"), pick("domain", F.col("domain")).alias("domain"),
        pick("model_used", F.col("model")).alias("model_used"), field("how_it_works").alias("how_it_works"), F.coalesce("content_hash", F.lit("")).alias("content_hash"),
        F.coalesce("validation_status", F.lit("unreviewed")).alias("validation_status"),
    )


def validate(stored: DataFrame, reviews: DataFrame) -> DataFrame:
    """Stored summaries with the status of the latest review (path, status, reviewed_at); without one a row stays as it is."""
    last = reviews.groupBy("path").agg(F.max_by("status", F.struct("reviewed_at", "status")).alias("_s"))
    return stored.join(last, "path", "left").withColumn("validation_status", F.coalesce("_s", "validation_status")).drop("_s")


def refreshed(view: DataFrame) -> DataFrame:
    """A materialised view made anew: written as a table of its own, which readers then use."""
    return cut(view)
