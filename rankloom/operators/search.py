"""Ranked retrieval: BM25+ keyword search, exact vector search, rank fusion, boosts, filters, de-duplication, top-k.

Keyword search needs no index: the query's terms are few, so each text keeps only its matches, statistics are one row of
partial sums, and the ranking is a top-k without a shuffle of texts.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

K1, B, DELTA = 1.5, 0.75, 1.0
RRF_K, RRF_MISSING, WEIGHT = 60, 100, 0.5
#: Boosts by kind of chunk and of memory.
DOMAIN_BOOSTS = {"class": 1.2, "function": 1.1, "imports": 0.9, "test": 0.7, "private": 0.8, "accessor": 1.0}
MEMORY_BOOSTS = {"code": 1.1, "decision": 1.3, "lesson": 1.2, "conversation": 1.0}
RECENCY = (0.8, 1.5, 30.0)
SUMMARY_BOOST = 1.15


# -- keyword ------------------------------------------------------------------------------------------------------------
def postings(chunks: DataFrame) -> DataFrame:
    """project_id, id, term, tf, dl: the index as a table, partitioned by term when written."""
    t = chunks.select("project_id", "id", T.tokens(F.coalesce("content", F.lit(""))).alias("t"))
    return t.select("project_id", "id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("project_id", "id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def index_stats(chunks: DataFrame) -> DataFrame:
    """project_id, documents, tokens, avgdl of each codebase's index."""
    n = F.size(T.tokens(F.coalesce("content", F.lit(""))))
    return chunks.groupBy("project_id").agg(F.count(F.lit(1)).alias("documents"), F.sum(n).alias("tokens"), F.avg(n).alias("avgdl"))


# Spark counts a lambda's parameters, defaults too; what a lambda needs besides is bound by a function around it.
def _equals(value: str):
    return lambda x: x == value


def _starts(prefix: str):
    return lambda x: x.startswith(prefix)


def _has_value(prefix: str, part: str):
    return lambda t: t.startswith(prefix) & F.contains(F.substring(t, len(prefix) + 1, 1 << 30), F.lit(part))


def _term_columns(chunks: DataFrame, terms: list[str], *keep: str) -> DataFrame:
    t = chunks.select(*keep, T.tokens(F.coalesce("content", F.lit(""))).alias("_t"))
    counted = F.struct(F.size("_t").alias("_dl"), *(F.size(F.filter("_t", _equals(term))).alias(f"_tf{i}") for i, term in enumerate(terms)))
    # A filter on a score isn't pushed below explode(), where it would tokenise the text anew for each term.
    return t.select(*keep, F.explode(F.array(counted)).alias("_c")).select(*keep, "_c.*")


def _stats(terms: list[str]) -> list[Column]:
    return [F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avg"), *(F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(terms)))]


def _bm25(counts: Counter, terms: list[str], value) -> Column:
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("_dl") / value("_avg"))
    parts = [
        F.lit(float(counts[t])) * F.when(value(f"_df{i}") > 0, F.log((value("_n") + F.lit(1.0)) / value(f"_df{i}")) * (F.lit(DELTA) + F.col(f"_tf{i}") * F.lit(K1 + 1) / (norm + F.col(f"_tf{i}")))).otherwise(F.lit(0.0))
        for i, t in enumerate(terms)
    ]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def ranked(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    return df.orderBy(F.desc(score), F.desc("id")).limit(k)


def keyword_search(chunks: DataFrame, query: str, k: int = 10) -> DataFrame:
    """id, score of the k best by BM25+; ties to the larger id.  Texts without a match keep the formula's lower bound."""
    counts = Counter(T.query_tokens(query))
    terms = sorted(counts)
    rows = _term_columns(chunks, terms, "id")
    stats = rows.agg(*_stats(terms)).first().asDict()
    scored = rows.select("id", _bm25(counts, terms, lambda c: F.lit(float(stats[c] or 0))).alias("score"))
    return ranked(scored.where("score != 0"), k)


def keyword_search_all(chunks: DataFrame, query: str, k: int = 10) -> DataFrame:
    """project_id, id, score: the k best of each codebase by its own statistics, then the k best of all."""
    counts = Counter(T.query_tokens(query))
    terms = sorted(counts)
    rows = _term_columns(chunks, terms, "project_id", "id")
    scored = rows.join(rows.groupBy("project_id").agg(*_stats(terms)), "project_id").select("project_id", "id", _bm25(counts, terms, F.col).alias("score")).where("score != 0")
    best = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("score"), F.desc("id")))
    return ranked(scored.withColumn("_n", best).where(F.col("_n") <= k).drop("_n"), k)


def keyword_sql(query: str, k: int, source: str, by: bool = False) -> str:
    counts = Counter(T.query_tokens(query))
    terms = ", ".join(f"('{t}', {c})" for t, c in sorted(counts.items()))
    on, part = ("USING (project_id)", "project_id, ") if by else ("ON true", "")
    cut = "row_number() OVER (PARTITION BY project_id ORDER BY score DESC, id DESC)" if by else "1"
    return f"""
WITH c AS ({source}), t AS (SELECT project_id, id, {T.TOKENS_SQL.format("content")} AS t FROM c), q(term, times) AS (VALUES {terms}),
m AS (SELECT project_id, id, len(t)::DOUBLE AS dl, term, times, len(list_filter(t, lambda x: x = term))::DOUBLE AS tf FROM t, q),
s AS (SELECT {part} count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM t {'GROUP BY project_id' if by else ''}),
f AS (SELECT {part} term, sum(CASE WHEN tf > 0 THEN 1 ELSE 0 END)::DOUBLE AS df FROM m GROUP BY {part} term),
r AS (SELECT m.project_id, m.id, sum(CASE WHEN df > 0 THEN times * ln((n + 1) / df) * ({DELTA} + tf * {K1 + 1} / ({K1} * ({1 - B} + {B} * dl / avgdl) + tf)) ELSE 0 END) AS score
      FROM m JOIN s {on} JOIN f ON f.term = m.term {'AND f.project_id = m.project_id' if by else ''} GROUP BY m.project_id, m.id),
p AS (SELECT *, {cut} AS w FROM r WHERE score <> 0)
SELECT {part} id, round(score, 6) AS score FROM p WHERE w <= {k} ORDER BY p.score DESC, id DESC LIMIT {k}
"""


# -- vectors ------------------------------------------------------------------------------------------------------------
def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def vector_search(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """id, relevance: 1 - d / 2 of the cosine distance d, within [0, 1]; exact, a top-k without a shuffle."""
    q = F.array(*(F.lit(float(x)) for x in query))
    relevance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - (F.lit(1.0) - cosine(F.col("embedding"), q)) / 2))
    return ranked(vectors.select("id", relevance.alias("relevance")), k, "relevance")


def max_cosine(vector: Column, others: list[Column]) -> Column:
    """(largest cosine + 1) / 2; 0 without others."""
    return (F.array_max(F.array(*(cosine(vector, o) for o in others))) + 1) / 2 if others else F.lit(0.0)


def hash_embedding(content: Column, size: int = 64) -> Column:
    """A vector without a model: token counts in hashed places with hashed signs; blank texts give zeros."""
    t = T.tokens(F.coalesce(content, F.lit("")))
    signed = F.transform(t, lambda x: F.struct(F.pmod(F.xxhash64(x), F.lit(size)).alias("i"), F.when(F.pmod(F.hash(x), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    zeros = F.array_repeat(F.lit(0.0), size)
    place = lambda acc, x: F.transform(acc, lambda v, i: F.when(i == x["i"], v + x["s"]).otherwise(v))
    return F.aggregate(signed, zeros, place)


def rebuilt(chunks: DataFrame, size: int = 64) -> DataFrame:
    """The vector store made anew from chunks (id, project_id, content, tags): one row for each id, with its embedding."""
    one = chunks.select("id", "project_id", "content", "tags").dropDuplicates(["id"])
    return one.select("id", "project_id", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ",").alias("tags"), "content", hash_embedding(F.col("content"), size).alias("embedding"))


# -- fusion -------------------------------------------------------------------------------------------------------------
def fuse(semantic: DataFrame, keyword: DataFrame, k: int, weight: float = WEIGHT) -> DataFrame:
    """Reciprocal-rank fusion of (id, score) lists of up to a few times k rows: id, score, and both ranks (-1: absent)."""
    rank = lambda df, name, other: df.select("id", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("id"))).alias(name), F.lit(None).cast("int").alias(other))
    names = ("semantic_rank", "keyword_rank")
    rows = rank(semantic, *names).unionByName(rank(keyword, *names[::-1])).groupBy("id").agg(*(F.max(n).alias(n) for n in names))
    # The lists are short, so that one task may hold them; their lengths are the last ranks.
    whole = Window.partitionBy()
    missing = {n: F.coalesce(F.max(n).over(whole), F.lit(0)) + RRF_MISSING for n in names}
    one = lambda n, x: F.lit(x) / (F.lit(RRF_K) + F.coalesce(F.col(n), missing[n]))
    both = rows.select("id", *(F.coalesce(n, F.lit(-1)).alias(f"_{n}") for n in names), (one(names[0], weight) + one(names[1], 1 - weight)).alias("_s"))
    return ranked(both.select("id", *(F.col(f"_{n}").alias(n) for n in names), (F.col("_s") / F.max("_s").over(whole)).alias("score")), k)


# -- boosts and filters ---------------------------------------------------------------------------------------------------
def _lookup(c: Column, table: dict[str, float]) -> Column:
    out = F.when(F.lit(False), F.lit(1.0))
    for key, value in table.items():
        out = out.when(c == key, F.lit(float(value)))
    return out.otherwise(F.lit(1.0))


def domain_boost(domain: Column, override: dict[str, float] | None = None) -> Column:
    return _lookup(domain, DOMAIN_BOOSTS | (override or {}))


def memory_boost(kind: Column) -> Column:
    return _lookup(kind, MEMORY_BOOSTS)


def recency_boost(created: Column, as_of: Column, least: float = RECENCY[0], most: float = RECENCY[1], days: float = RECENCY[2]) -> Column:
    age = (as_of.cast("timestamp").cast("double") - created.cast("timestamp").cast("double")) / 86400
    return F.coalesce(F.lit(least) + F.lit(most - least) * F.exp(-age / days), F.lit(1.0))


def boosted(df: DataFrame, as_of: Column, override: dict[str, float] | None = None) -> DataFrame:
    return df.withColumn("score", F.col("score") * domain_boost(F.col("domain"), override) * memory_boost(F.col("memory_type")) * recency_boost(F.col("created_at"), as_of))


def tag_match(tags: Column, pattern: str) -> Column:
    """Whether a tag equals the pattern, or starts with it where it ends in *."""
    return F.exists(tags, lambda t: t.startswith(pattern[:-1])) if pattern.endswith("*") else F.array_contains(tags, pattern)


def tag_filter(df: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Any of include (if given), none of exclude."""
    any_of = lambda ps: reduce(lambda a, b: a | b, (tag_match(F.col("tags"), p) for p in ps))
    df = df.where(any_of(include)) if include else df
    return df.where(~any_of(exclude)) if exclude else df


def heuristic_filter(df: DataFrame, languages=(), classes=(), functions=(), annotations=(), has_annotations=None, has_docstrings=None, min_classes=0, min_functions=0) -> DataFrame:
    """Filters over prefixed tags: any value within a kind, all kinds together; counts missing from the tags are 0."""
    tags = F.col("tags")
    for prefix, values in (("lang", languages), ("class", classes), ("function", functions), ("annotation", annotations)):
        if values:
            df = df.where(F.arrays_overlap(tags, F.array(*(F.lit(f"{prefix}:{v}") for v in values))))
    for flag, wanted in (("has_annotations", has_annotations), ("has_docstrings", has_docstrings)):
        if wanted is not None:
            df = df.where(F.array_contains(tags, f"{flag}:true") == F.lit(wanted))
    for name, least in (("class_count", min_classes), ("function_count", min_functions)):
        if least:
            n = F.get(F.filter(tags, _starts(f"{name}:")), F.lit(0))
            df = df.where(F.coalesce(F.substring_index(n, ":", -1).try_cast("int"), F.lit(0)) >= least)
    return df


def signal_filter(df: DataFrame, **wanted: str) -> DataFrame:
    """calls=, reads=, writes=, subscript=, param=: a part of the value of such a tag."""
    for prefix, part in wanted.items():
        df = df.where(F.exists("tags", _has_value(f"{prefix}:", part)))
    return df


def dedup(df: DataFrame) -> DataFrame:
    """The best row of those whose first 200 characters agree but for case and outer white space."""
    first = F.row_number().over(Window.partitionBy(T.dedup_key(F.col("content"))).orderBy(F.desc("score"), F.desc("id")))
    return df.withColumn("_n", first).where("_n = 1").drop("_n")


def summary_boost(df: DataFrame, summarized: DataFrame) -> DataFrame:
    """Rows with a summary (by id) get a boost, and say so in has_summary."""
    flag = summarized.select("id", F.lit(True).alias("has_summary")).distinct()
    out = df.join(flag, "id", "left").withColumn("has_summary", F.coalesce("has_summary", F.lit(False)))
    return out.withColumn("score", F.when(F.col("has_summary"), F.col("score") * SUMMARY_BOOST).otherwise(F.col("score")))


def context_line(df: DataFrame) -> DataFrame:
    """One row that says what a result list is about: languages, codebases, up to five first path parts."""
    part = lambda c: F.array_sort(F.collect_set(c))
    areas = F.slice(part(F.substring_index("path", "/", 1)), 1, 5)
    return df.agg(F.concat_ws(" | ", *(F.array_join(x, ", ") for x in (part(F.col("language")), part(F.col("project_id")), areas))).alias("context"))
