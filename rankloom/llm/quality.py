"""Quality rules: a threshold table compiled into one projection of built-in functions.

A document fails the base rules if it has under ``MIN_WORDS`` words or if more than half of its words stand in repeated
three-word windows.  The table below adds rules on ratios; each has an expression over the counted columns, a lower and an
upper bound, and the verdict is their conjunction.  Nothing here runs Python on the executors, nothing is shuffled.

Rules for odd rows: a null text has no words and fails (as an empty one does); a ratio with a zero denominator passes no
judgement; repeated rows each get the same verdict; further columns of the input don't matter, whatever their names (the
input's columns travel as one struct).
Windows are compared by a 64-bit hash of their three words within one text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
REPEAT_PERCENT = 50

#: Frequent function words of the languages that the rules know.
STOP_WORDS = (
    "the of and to in is that for it as with was on are be this by an at from "
    "der die das und ist nicht ein eine zu den mit von auf im des sich dem auch "
    "le la les et est un une que qui dans pour pas sur du au ce il elle en par "
    "el los las es por con del se su lo como al"
).split()

#: (rule, numerator, denominator, least, most): the document stays if least <= numerator / denominator <= most.
THRESHOLDS = (
    ("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    ("symbol_ratio", "n_symbols", "n_words", None, 0.3),
    ("repeated_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
    ("stop_word_kinds", "n_stop_words", "one", 2.0, None),
    ("bar_ratio", "n_bars", "n_words", None, 0.2),
    ("capital_ratio", "n_capitals", "word_chars", None, 0.4),
    ("exclamation_ratio", "n_exclamations", "n_words", None, 0.5),
)

WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def _repeats(placed: str) -> Column:
    """How many words stand in a window that occurs twice or more; ``placed`` has the windows' (hash, place) in order.

    Equal neighbours give the places, and each covered word counts once."""
    same = lambda k, j: F.coalesce(F.get(placed, k)["h"] == F.get(placed, j)["h"], F.lit(False))
    at = F.filter(F.transform(placed, lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["i"])), lambda i: i.isNotNull())
    return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """keep columns and: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words, n_bars,
    n_capitals, n_exclamations."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, WHITE + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    count = lambda what: F.regexp_count(text, F.lit(what)).cast("long")
    counted = docs.select(*keep, words.alias("_w"), lines.alias("_l"), *(count(r).alias(n) for n, r in (("n_symbols", r"[#*$%&|<>]"), ("n_bars", r"\|"), ("n_capitals", "[A-Z]"), ("n_exclamations", "!!"))))
    windows = F.transform(F.slice(F.col("_w"), 3, F.greatest(F.size("_w"), F.lit(0))), lambda w, i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), w))
    hashed = counted.select(
        *keep, "n_symbols", "n_bars", "n_capitals", "n_exclamations",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_intersect(F.transform(F.array_distinct("_w"), F.lower), F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop_words"),
        windows.alias("_h"),
    )
    # Most texts repeat nothing, which a hash set tells; only the others are sorted.
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    placed = hashed.withColumn("_s", F.when(some, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_h")
    repeats = F.when(F.col("_s").isNull(), 0).otherwise(_repeats("_s")).cast("long")
    names = [c for c in placed.columns if c != "_s"]
    # The counts go through explode(), below which no filter on them is pushed: pushed down, it would be made of
    # expressions that evaluate the sorted windows anew for each window.
    return placed.select(F.explode(F.array(F.struct(*names, repeats.alias("n_repeat_words")))).alias("_m")).select("_m.*")


def verdict(thresholds=THRESHOLDS) -> Column:
    """The table as one boolean expression over the counted columns."""

    def rule(_, numerator, denominator, least, most):
        below = F.lit(1) if denominator == "one" else F.col(denominator)
        ratio = F.col(numerator) / F.when(below != 0, below)
        bounds = [ratio >= least] * (least is not None) + [ratio <= most] * (most is not None)
        return F.coalesce(reduce(lambda a, b: a & b, bounds), F.lit(True))

    return reduce(lambda a, b: a & b, (rule(*t) for t in thresholds))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    out = measures(docs, "doc_id").withColumn("base_failed", base_failed())
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return out.select(*names, (~F.col("base_failed") & verdict(thresholds)).alias("kept"))


def keep_good(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The documents that the rules keep, with their columns as they were."""
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), F.col("text"))
    return measures(row, "_row").where(~base_failed() & verdict(thresholds)).select("_row.*")


_RULE_SQL = " AND ".join(
    "coalesce(" + " AND ".join([f"{a}::DOUBLE / nullif({'1' if b == 'one' else b}, 0) >= {lo}"] * (lo is not None) + [f"{a}::DOUBLE / nullif({'1' if b == 'one' else b}, 0) <= {hi}"] * (hi is not None)) + ", true)"
    for _, a, b, lo, hi in THRESHOLDS
)

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT k, unnest(list_transform(range(1, len(w) - 1), lambda i: struct_pack(i := i, g := w[i:i+2]))) AS x FROM w WHERE len(w) > 2),
r AS (SELECT k, x.i AS i FROM (SELECT k, x, count(*) OVER (PARTITION BY k, x.g) AS n FROM g) WHERE n > 1),
c AS (SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY k),
m AS (SELECT w.k, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(regexp_extract_all(t, '[|]'))::BIGINT AS n_bars, len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals,
             len(regexp_extract_all(t, '!!'))::BIGINT AS n_exclamations,
             len(list_intersect(list_distinct(list_transform(w, lambda x: lower(x))), [{', '.join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}]))::BIGINT AS n_stop_words
      FROM w LEFT JOIN c USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_RULE_SQL} AS kept
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m)
"""
