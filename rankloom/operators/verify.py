"""Evidence for claims: which signals of which chunks speak for it, how strongly, and what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import key_terms, strip

#: Kinds of signals, by tag prefix and by line of a chunk's signal section.
SIGNALS = (("calls", "Calls", "call"), ("reads", "Reads", "attribute_read"), ("writes", "Writes", "attribute_write"), ("subscript", "Subscripts", "subscript_access"), ("param", "Parameters used", "parameter_usage"))
SECTION = "[Implementation Signals]"


def _agree(signal: Column, term: Column) -> Column:
    s, t = F.lower(signal), F.lower(term)
    return (s != "") & (t != "") & (F.contains(s, t) | F.contains(t, s))


def matches(signal: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: _agree(signal, t))


def relevance(signal: Column, terms: Column) -> Column:
    """0 without a match; else .5, .4 more if a term equals it, .1 for each further term up to .3, .05 for a long one."""
    hits = F.filter(terms, lambda t: _agree(signal, t))
    score = (
        F.lit(0.5)
        + F.when(F.exists(terms, lambda t: F.lower(t) == F.lower(signal)), 0.4).otherwise(0.0)
        + F.least((F.size(hits) - 1) * F.lit(0.1), F.lit(0.3))
        + F.when(F.exists(hits, lambda t: F.length(t) >= 4), 0.05).otherwise(0.0)
    )
    return F.when(F.size(hits) > 0, F.least(score, F.lit(1.0))).otherwise(F.lit(0.0))


def _starts(prefix: str):
    return lambda t: t.startswith(prefix)


def _signal(kind: str, at: int):
    return lambda t: F.struct(F.lit(kind).alias("type"), F.substring(t, at, 1 << 30).alias("detail"))


def signals(chunks: DataFrame) -> DataFrame:
    """id, type, detail: the signals in tags, and in the first line of each kind of the content's section."""
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    by_tag = [F.transform(F.filter(tags, _starts(f"{p}:")), _signal(kind, len(p) + 2)) for p, _, kind in SIGNALS]
    content = F.when(F.contains("content", F.lit(SECTION)), F.col("content")).otherwise("")
    values = lambda name: F.filter(F.transform(F.split(F.regexp_extract(content, rf"(?m){name}:\s*(.+)$", 1), ","), strip), lambda v: v != "")
    by_line = [F.transform(values(name), _signal(kind, 1)) for _, name, kind in SIGNALS]
    return chunks.select("id", F.explode(F.concat(*by_tag, *by_line)).alias("s")).select("id", "s.type", "s.detail")


def evidence(chunks: DataFrame, claim: str) -> DataFrame:
    """type, detail, relevance: each pair once with its best relevance; order by (relevance, detail) falling."""
    rows = signals(chunks).withColumn("relevance", relevance(F.col("detail"), key_terms(F.lit(claim)))).where("relevance > 0")
    return rows.groupBy("type", "detail").agg(F.max("relevance").alias("relevance"))


def verdict(found: DataFrame) -> DataFrame:
    """One row: status and confidence; the average of best and mean evidence, a tenth more, at most 1."""
    a = found.agg(F.count(F.lit(1)).alias("n"), F.max("relevance").alias("m"), F.avg("relevance").alias("v"))
    return a.select(F.when(F.col("n") > 0, "supported").otherwise("not_supported").alias("status"), F.when(F.col("n") > 0, F.least((F.col("m") + F.col("v")) / 2 + 0.1, F.lit(1.0))).otherwise(0.7).alias("confidence"), F.col("n").alias("n_evidence"))


def top_evidence(found: DataFrame, k: int = 10) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("relevance"), F.desc("detail"), "type"))).where(F.col("rank") <= k)
