"""Columns over text: the code-aware tokenizer, query modes, claims, names of modules and languages, digests."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """All white space at both ends (Spark's trim removes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Lower-case alphanumeric tokens of two characters or more; camelCase and snake_case fall into their parts."""
    split = F.translate(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "_", " ")
    return F.regexp_extract_all(F.lower(split), F.lit("[a-z0-9]{2,}"), F.lit(0))


TOKENS_SQL = "list_filter(regexp_extract_all(lower(replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ')), '[a-z0-9]+'), lambda x: length(x) >= 2)"


def query_tokens(query: str) -> list[str]:
    """The same for a query string, which lives on the driver."""
    apart = re.sub("([a-z])([A-Z])", r"\1 \2", query).replace("_", " ").lower()
    return re.findall("[a-z0-9]{2,}", re.sub("[^a-z0-9]", " ", apart))


#: Words that decide on the mode of a query.
CODE_WORDS = "def class import from if else elif for while try except finally with as return yield lambda self cls super and or not in is async await global nonlocal".split()
CONCEPT_WORDS = ("how", "what", "why", "when", "where", "which", "explain", "describe", "pattern", "approach", "related to", "similar to", "like")
QUESTION_WORDS = ("how", "what", "why", "when", "where", "which", "like")


def search_mode(q: Column) -> Column:
    """keyword, semantic or hybrid: exact names ask for keywords, questions for meaning, the rest for both."""
    low = F.lower(q)
    dotted = q.contains(".") & ~q.endswith(".")
    named = q.rlike("[a-z][A-Z]") | q.rlike("[a-z]_[a-z]") | dotted
    concept = F.lit(False)
    for w in CONCEPT_WORDS:
        concept = concept | low.contains(w)
    capitals = (F.length(q) > 1) & (F.upper(q) == q) & (low != q)
    short = (F.length(q) <= 5) & q.rlike("(?U)^\\p{L}+$") & ~q.isin(*QUESTION_WORDS)
    keyword = q.rlike("[\"']") | q.rlike("(?U)__\\w+__") | low.isin(*CODE_WORDS) | capitals | (short & ~concept) | (named & ~concept)
    return F.when(keyword, "keyword").when(concept & ~named, "semantic").otherwise("hybrid")


def _mode_sql() -> str:
    quoted = lambda ws: ", ".join(f"'{w}'" for w in ws)
    concept = "(" + " OR ".join(f"contains(lower(q), '{w}')" for w in CONCEPT_WORDS) + ")"
    named = "(regexp_matches(q, '[a-z][A-Z]') OR regexp_matches(q, '[a-z]_[a-z]') OR (contains(q, '.') AND NOT ends_with(q, '.')))"
    capitals = "(length(q) > 1 AND upper(q) = q AND lower(q) <> q)"
    short = f"(length(q) <= 5 AND regexp_matches(q, '^\\p{{L}}+$') AND q NOT IN ({quoted(QUESTION_WORDS)}))"
    keyword = f"regexp_matches(q, '[\"'']') OR regexp_matches(q, '__\\w+__') OR lower(q) IN ({quoted(CODE_WORDS)}) OR {capitals} OR ({short} AND NOT {concept}) OR ({named} AND NOT {concept})"
    return f"CASE WHEN {keyword} THEN 'keyword' WHEN {concept} AND NOT {named} THEN 'semantic' ELSE 'hybrid' END"


MODE_SQL = _mode_sql()

#: The forms of a claim, from the most specific on; the name comes first, then what is claimed of it.
_NAME = r"([\w_]+(?:\.[\w_]+)*)"
CLAIM_FORMS = (
    rf"verify {_NAME} uses? (.+)",
    rf"does {_NAME} use (.+)",
    rf"is {_NAME} using (.+)",
    rf"does {_NAME} call (.+)",
    rf"does {_NAME} access (.+)",
    rf"does {_NAME} have (.+)",
    rf"find if {_NAME} uses? (.+)",
    rf"check if {_NAME} (.+)",
    rf"confirm {_NAME} (.+)",
)

#: Words that carry no claim.
CLAIM_STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall can "
    "need dare ought used to for of in on at by with from as into through during before after above below between under "
    "again further then once here there when where why how all each few more most other some such no nor not only own same "
    "so than too very just also now if or and but because until while that this these those what which who whom any both "
    "either window relative"
).split()


def claim(q: Column) -> Column:
    """struct(subject, claim) of a question for evidence, or null."""
    flat = strip(F.regexp_replace(q, r"(?U)\s+", " "))
    found = F.lit(None).cast("struct<subject:string,claim:string>")
    for form in reversed(CLAIM_FORMS):
        whole = "(?iU)^" + form
        found = F.when(flat.rlike(whole), F.struct(F.regexp_extract(flat, whole, 1).alias("subject"), F.regexp_extract(flat, whole, 2).alias("claim"))).otherwise(found)
    return found


def is_claim(q: Column) -> Column:
    return F.coalesce(strip(F.lower(q)).rlike("^(verify|does|is|check if|confirm|find if) "), F.lit(False))


def key_terms(c: Column) -> Column:
    """What a claim is about: parts without punctuation, stop words and most single letters."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"(?U)[\s,;:\-()\[\]{}]+"), lambda t: F.regexp_replace(t, "^[.,!?\"'`]+|[.,!?\"'`]+$", ""))
    stop = F.array(*map(F.lit, CLAIM_STOP_WORDS))
    return F.filter(parts, lambda t: (t != "") & ((F.length(t) > 1) | F.lower(t).isin("x", "y", "n", "i", "j", "k")) & ~F.array_contains(stop, F.lower(t)))


TERMS_SQL = (
    "list_filter(list_transform(regexp_split_to_array({0}, '[\\s,;:\\-()\\[\\]{{}}]+'), lambda t: regexp_replace(t, '^[.,!?\"''`]+|[.,!?\"''`]+$', '', 'g')), "
    "lambda t: t <> '' AND (length(t) > 1 OR lower(t) IN ('x','y','n','i','j','k')) AND lower(t) NOT IN (" + ", ".join(f"'{w}'" for w in CLAIM_STOP_WORDS) + "))"
)

#: Languages by the ends of file names.
LANGUAGES = {
    "python": ".py .pyi .pyw", "java": ".java", "kotlin": ".kt .kts", "go": ".go", "ruby": ".rb .rake", "c": ".c", "csharp": ".cs",
    "swift": ".swift", "objc": ".h .m .mm", "typescript": ".ts .tsx", "javascript": ".js .jsx .mjs",
}


def language(path: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, ends in LANGUAGES.items():
        out = out.when(F.lower(path).rlike("(" + "|".join(re.escape(e) for e in ends.split()) + ")$"), name)
    return out


def module_name(path: Column) -> Column:
    """src/pkg/mod.py as pkg.mod."""
    dotted = F.regexp_replace(F.regexp_replace(path, r"\.[^./\\]+$", ""), r"[/\\]", ".")
    return F.regexp_replace(F.regexp_replace(dotted, r"^\.+", ""), r"^(src|lib|app|source)\.", "")


def is_test_file(path: Column) -> Column:
    name = F.lower(F.regexp_replace(path, r"\\", "/"))
    return name.rlike(r"(^|/)tests?/|(^|/)__tests__/|(^|/)spec/|(^|/)test_[^/]*$|(^|/)[^/]*_test\.[^/.]+$|(^|/)[^/]*\.(test|spec)\.[^/.]+$|(^|/)[^/]*tests?\.(java|kt|cs|swift)$|(^|/)[^/]*_spec\.rb$")


def snippet(c: Column, most: int = 500) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def dedup_key(c: Column) -> Column:
    return F.lower(strip(F.substring(c, 1, 200)))
