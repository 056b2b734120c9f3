"""The engine's tables as views of the given ones: chunks, files, memories, codebases, summaries, edges.

A chunk is a document with tags; its typed columns (domain, memory_type, created_at) are derived once, so that scalar
filters reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOMAINS = ("class", "function", "imports", "test", "private", "accessor", "none")
MEMORY_TYPES = ("code", "conversation", "decision", "lesson")
AS_OF = "2024-02-01 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], key):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, project_id, content, tags, domain, memory_type, created_at, source."""
    d = load(spark, sf_dir, "documents")
    domain = _pick(DOMAINS, F.col("doc_id"))
    tags = F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("file:"), "source", F.lit("/"), F.col("doc_id").cast("string")), F.concat(F.lit("domain:"), domain))
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("project_id"),
        F.col("text").alias("content"),
        tags.alias("tags"),
        domain.alias("domain"),
        F.col("lang").alias("language"),
        _pick(MEMORY_TYPES, F.floor(F.col("doc_id") / 7)).alias("memory_type"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 720 * 3600).alias("created_at"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
    )


CHUNKS_SQL = f"""
SELECT doc_id AS id, source AS project_id, text AS content, lang AS language, source || '/' || doc_id AS path,
       ['lang:' || lang, 'file:' || source || '/' || doc_id, 'domain:' || [{', '.join(f"'{d}'" for d in DOMAINS)}][(doc_id % {len(DOMAINS)} + 1)::INT]] AS tags,
       [{', '.join(f"'{d}'" for d in DOMAINS)}][(doc_id % {len(DOMAINS)} + 1)::INT] AS domain,
       [{', '.join(f"'{d}'" for d in MEMORY_TYPES)}][((doc_id // 7) % {len(MEMORY_TYPES)} + 1)::INT] AS memory_type,
       1704067200 + doc_id % 720 * 3600 AS created_s
FROM documents
"""


def codebases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("codebase_id"), F.col("n_name").alias("codebase"))


def indexed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), F.col("c_nationkey").alias("codebase_id"), F.col("c_name").alias("path"), F.col("c_mktsegment").alias("language"), F.col("c_acctbal").alias("size"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer stands for a file's summary."""
    o = load(spark, sf_dir, "orders")
    last = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    kept = o.withColumn("_n", last).where("_n = 1")
    return kept.select(F.col("o_custkey").alias("file_id"), F.col("o_orderpriority").alias("pattern"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("summarized_at"), F.when(F.col("o_totalprice") < 50000, "simple").otherwise("llm").alias("summary_type"), F.date_format("o_orderdate", "yyyy").alias("domain"))


METADATA_SQL = """
codebases AS (SELECT n_nationkey AS codebase_id, n_name AS codebase FROM nation),
files AS (SELECT c_custkey AS file_id, c_nationkey AS codebase_id, c_name AS path, c_mktsegment AS language, c_acctbal AS size FROM customer),
summaries AS (SELECT o_custkey AS file_id, o_orderpriority AS pattern, o_orderstatus AS status, o_orderdate AS summarized_at,
                     CASE WHEN o_totalprice < 50000 THEN 'simple' ELSE 'llm' END AS summary_type, strftime(o_orderdate, '%Y') AS domain
              FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1)
"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct directed edges without loops: supplier to 1 + part modulo the number of suppliers."""
    n = load(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")).first()["n"]
    e = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % n + 1).alias("dst"))
    return e.where("src != dst").distinct()


EDGES_SQL = "edges AS (SELECT DISTINCT l_suppkey AS src, l_partkey % (SELECT count(*) FROM supplier) + 1 AS dst FROM lineitem WHERE l_suppkey <> l_partkey % (SELECT count(*) FROM supplier) + 1)"


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, MEMORY_TYPES)), (F.col("user_id") % 4 + 1).cast("int"))
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("project"), (F.col("user_id") % 5).cast("string")).alias("project_id"), kind.alias("memory_type"), F.when(F.col("event_id") % 3 == 0, "codebase_indexing").otherwise("chat").alias("source"), F.col("ts").alias("created_at"), (F.col("event_id") % 11 == 0).alias("pin"), F.col("props").alias("content"))


MEMORIES_SQL = """
memories AS (SELECT event_id AS id, 'project' || (user_id % 5) AS project_id, ['code','conversation','decision','lesson'][(user_id % 4 + 1)::INT] AS memory_type,
             CASE WHEN event_id % 3 = 0 THEN 'codebase_indexing' ELSE 'chat' END AS source, ts AS created_at, event_id % 11 = 0 AS pin, props AS content FROM events)
"""
