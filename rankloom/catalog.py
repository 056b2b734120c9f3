"""The registered queries of the engine and the SQL that gives the same rows.

Each name stands for operators of the engine applied to whole tables; limits appear only where they are the feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables as TB
from .functions import text as T
from .operators import chunking as CH
from .operators import code as CD
from .operators import graph as G
from .operators import incremental as I
from .operators import metadata as M
from .operators import search as S
from .operators import verify as V
from .plans.search import search
from .sources import files as FS
from .streaming import watch as W

QUERY = "the thing and other tion password"
SQL: dict[str, str] = {}
QUERIES: dict[str, object] = {}
R6 = lambda c: F.round(c, 6)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.keyword_search(TB.chunks(spark, sf_dir), QUERY, 10)


def _docs(spark, sf):
    return TB.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def _vectors(spark, sf):
    return TB.load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _first_vector(spark, sf):
    return [float(x) for x in _vectors(spark, sf).where("id = 0").first()["embedding"]]


# -- text and retrieval ---------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id AS id, len({T.TOKENS_SQL.format('text')})::BIGINT AS n_tokens, array_to_string({T.TOKENS_SQL.format('text')}, ' ') AS tokens FROM documents")
def v1_tokenizer(spark, sf):
    t = _docs(spark, sf).select("id", T.tokens(F.col("content")).alias("t"))
    return t.select("id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query(f"WITH c AS ({TB.CHUNKS_SQL}), t AS (SELECT project_id, id, {T.TOKENS_SQL.format('content')} AS t FROM c), e AS (SELECT project_id, id, len(t)::BIGINT AS dl, unnest(t) AS term FROM t) SELECT project_id, id, dl, term, count(*) AS tf FROM e GROUP BY ALL")
def v2_postings(spark, sf):
    return S.postings(TB.chunks(spark, sf)).withColumn("dl", F.col("dl").cast("long"))


@query(f"WITH c AS ({TB.CHUNKS_SQL}), t AS (SELECT project_id, len({T.TOKENS_SQL.format('content')}) AS n FROM c) SELECT project_id, count(*) AS documents, sum(n)::BIGINT AS tokens, round(avg(n), 6) AS avgdl FROM t GROUP BY project_id")
def v2_index_stats(spark, sf):
    return S.index_stats(TB.chunks(spark, sf)).withColumn("avgdl", R6("avgdl"))


@query(S.keyword_sql(QUERY, 10, TB.CHUNKS_SQL))
def v3_keyword_search(spark, sf):
    return S.keyword_search(TB.chunks(spark, sf), QUERY, 10).withColumn("score", R6("score"))


@query(S.keyword_sql(QUERY, 10, TB.CHUNKS_SQL, by=True))
def v4_keyword_all_codebases(spark, sf):
    return S.keyword_search_all(TB.chunks(spark, sf), QUERY, 10).withColumn("score", R6("score"))


_REL = "greatest(0, least(1, 1 - (1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) / 2))"


@query(f"SELECT e.vec_id AS id, round({_REL}, 6) AS relevance FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {_REL} DESC, id DESC LIMIT 10")
def v5_vector_search(spark, sf):
    return S.vector_search(_vectors(spark, sf), _first_vector(spark, sf), 10).withColumn("relevance", R6("relevance"))


@query("SELECT e.vec_id AS id, round((max(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) + 1) / 2, 6) AS relevance FROM embeddings e, embeddings q WHERE q.vec_id < 3 GROUP BY e.vec_id")
def v6_max_cosine(spark, sf):
    v = _vectors(spark, sf)
    some = [F.array(*(F.lit(float(x)) for x in r["embedding"])) for r in v.where("id < 3").orderBy("id").collect()]
    return v.select("id", R6(S.max_cosine(F.col("embedding"), some)).alias("relevance"))


@query()
def v7_hash_embedding(spark, sf):
    return _docs(spark, sf).select("id", S.hash_embedding(F.col("content")).alias("embedding"))


@query(f"WITH c AS ({TB.CHUNKS_SQL}) SELECT id, project_id, array_to_string(tags, ',') AS tags, content, 64 AS n FROM c")
def v8_rebuild(spark, sf):
    c = TB.chunks(spark, sf)
    return S.rebuilt(c.unionByName(c)).select("id", "project_id", "tags", "content", F.size("embedding").alias("n"))


_KW = S.keyword_sql(QUERY, 20, TB.CHUNKS_SQL)


@query(f"""
WITH w AS (SELECT id, row_number() OVER (ORDER BY score DESC, id DESC) AS r FROM ({_KW})),
s0 AS (SELECT e.vec_id AS id, {_REL} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, id DESC LIMIT 20),
s AS (SELECT id, row_number() OVER (ORDER BY score DESC, id DESC) AS r FROM s0),
f AS (SELECT coalesce(s.id, w.id) AS id, coalesce(s.r, -1)::INT AS semantic_rank, coalesce(w.r, -1)::INT AS keyword_rank,
             0.5::DOUBLE / (60 + coalesce(s.r, (SELECT count(*) FROM s) + 100)) + 0.5::DOUBLE / (60 + coalesce(w.r, (SELECT count(*) FROM w) + 100)) AS x FROM s FULL JOIN w ON s.id = w.id)
SELECT id, semantic_rank, keyword_rank, round(x / (SELECT max(x) FROM f), 6) AS score FROM f ORDER BY x DESC, id DESC LIMIT 10
""")
def v9_rank_fusion(spark, sf):
    near = S.vector_search(_vectors(spark, sf), _first_vector(spark, sf), 20).withColumnRenamed("relevance", "score")
    word = S.keyword_search(TB.chunks(spark, sf), QUERY, 20).withColumn("score", R6("score"))
    return S.fuse(near, word, 10).withColumn("score", R6("score"))


_ASKED = "(SELECT item_id AS id, substr(text, 1, 4 + (item_id % 9)::INT * 3) AS q FROM benchmark UNION ALL SELECT item_id + 1000, 'how does ' || substr(text, 1, 12) FROM benchmark UNION ALL SELECT item_id + 2000, 'load_' || lower(substr(text, 1, 3)) || '.run' FROM benchmark)"


@query(f"SELECT id, q, {T.MODE_SQL} AS mode FROM {_ASKED}")
def v10_search_mode(spark, sf):
    b = TB.load(spark, sf, "benchmark")
    first = b.select(F.col("item_id").alias("id"), F.expr("substring(text, 1, 4 + cast(item_id % 9 as int) * 3)").alias("q"))
    second = b.select((F.col("item_id") + 1000).alias("id"), F.concat(F.lit("how does "), F.substring("text", 1, 12)).alias("q"))
    third = b.select((F.col("item_id") + 2000).alias("id"), F.concat(F.lit("load_"), F.lower(F.substring("text", 1, 3)), F.lit(".run")).alias("q"))
    return first.unionByName(second).unionByName(third).withColumn("mode", T.search_mode(F.col("q")))


_CASE = lambda c, t: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in t.items()) + " ELSE 1.0::DOUBLE END"
_BOOST = f"({_CASE('domain', S.DOMAIN_BOOSTS)}) * ({_CASE('memory_type', S.MEMORY_BOOSTS)}) * (0.8::DOUBLE + 0.7::DOUBLE * exp(-((1706745600 - created_s) / 86400.0::DOUBLE) / 30))"


@query(f"WITH c AS ({TB.CHUNKS_SQL}) SELECT id, round({_BOOST}, 6) AS score FROM c")
def f2_f5_boosts(spark, sf):
    rows = TB.chunks(spark, sf).withColumn("score", F.lit(1.0))
    return S.boosted(rows, F.lit(TB.AS_OF)).select("id", R6("score").alias("score"))


@query(f"WITH c AS ({TB.CHUNKS_SQL}) SELECT id, project_id FROM c WHERE project_id = 'src3'")
def f1_project_filter(spark, sf):
    return TB.chunks(spark, sf).where("project_id = 'src3'").select("id", "project_id")


@query(f"WITH c AS ({TB.CHUNKS_SQL}) SELECT id FROM c WHERE (list_contains(tags, 'domain:class') OR len(list_filter(tags, lambda t: starts_with(t, 'lang:f'))) > 0) AND NOT list_contains(tags, 'lang:de')")
def f6_tag_filter(spark, sf):
    return S.tag_filter(TB.chunks(spark, sf), ["domain:class", "lang:f*"], ["lang:de"]).select("id")


@query("SELECT doc_id AS id FROM documents WHERE lang IN ('en', 'es') AND doc_id % 4 = 0 AND doc_id % 10 >= 5")
def f7_heuristic_filter(spark, sf):
    tags = F.concat("tags", F.when(F.col("id") % 4 == 0, F.array(F.lit("has_docstrings:true"))).otherwise(F.array().cast("array<string>")), F.array(F.concat(F.lit("function_count:"), (F.col("id") % 10).cast("string"))))
    return S.heuristic_filter(TB.chunks(spark, sf).withColumn("tags", tags), languages=["en", "es"], has_docstrings=True, min_functions=5).select("id")


@query("SELECT doc_id AS id FROM documents WHERE contains(coalesce(list_last(list_filter(string_split(lang || '_run_' || source, '.'), lambda x: true)), ''), 'run_src1')")
def f8_signal_filter(spark, sf):
    d = TB.chunks(spark, sf)
    return S.signal_filter(d.withColumn("tags", F.array(F.concat(F.lit("calls:"), "language", F.lit("_run_"), "project_id"))), calls="run_src1").select("id")


@query("SELECT id FROM (SELECT doc_id AS id, row_number() OVER (PARTITION BY lower(regexp_replace(substr(text, 1, 200), '^\\s+|\\s+$', '', 'g')) ORDER BY doc_id % 100 DESC, doc_id DESC) AS n FROM documents) WHERE n = 1")
def f9_dedup(spark, sf):
    return S.dedup(_docs(spark, sf).withColumn("score", F.col("id") % 100)).select("id")


@query("SELECT d.doc_id AS id, round(CASE WHEN s.doc_id IS NULL THEN 1.0 ELSE 1.15 END::DOUBLE, 6) AS score, s.doc_id IS NOT NULL AS has_summary FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) s ON d.doc_id = s.doc_id")
def f10_summary_boost(spark, sf):
    done = TB.load(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return S.summary_boost(_docs(spark, sf).select("id").withColumn("score", F.lit(1.0)), done)


@query("SELECT doc_id AS id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS content FROM documents")
def f11_snippet(spark, sf):
    return _docs(spark, sf).select("id", T.snippet(F.col("content")).alias("content"))


@query("SELECT array_to_string(list_sort(list(DISTINCT lang)), ', ') || ' | ' || array_to_string(list_sort(list(DISTINCT source)), ', ') || ' | ' || array_to_string(list_sort(list(DISTINCT source))[1:5], ', ') AS context FROM documents")
def f13_context_line(spark, sf):
    return S.context_line(TB.chunks(spark, sf))


_KW20 = S.keyword_sql(QUERY, 20, TB.CHUNKS_SQL).replace("round(score, 6) AS score", "score AS score")


@query(f"""
WITH c AS ({TB.CHUNKS_SQL}), h AS ({_KW20}),
b AS (SELECT c.*, h.score * {_BOOST} AS score FROM c JOIN h USING (id)),
d AS (SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(substr(content, 1, 200), '^\\s+|\\s+$', '', 'g')) ORDER BY score DESC, id DESC) AS n FROM b WHERE NOT list_contains(tags, 'domain:test')),
s AS (SELECT d.id, project_id, content, CASE WHEN l.doc_id IS NULL THEN score ELSE score * 1.15::DOUBLE END AS score, l.doc_id IS NOT NULL AS has_summary FROM d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.id WHERE n = 1)
SELECT id, project_id, CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || '...' ELSE content END AS content, round(s.score, 6) AS score, has_summary FROM s ORDER BY s.score DESC, id DESC LIMIT 10
""")
def f14_full_search(spark, sf):
    done = TB.load(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return search(TB.chunks(spark, sf), QUERY, 10, F.lit(TB.AS_OF), exclude=["domain:test"], summarized=done).withColumn("score", R6("score"))


# -- claims -----------------------------------------------------------------------------------------------------------------
_CLAIMED = "(SELECT doc_id AS id, ['verify ', 'does ', 'is ', 'check if ', 'find if ', 'tell me '][(doc_id % 6 + 1)::INT] || 'load_' || lang || '.run' || [' uses ', ' use ', ' using ', ' calls ', ' uses ', ' has '][(doc_id % 6 + 1)::INT] || regexp_replace(text, '\\s+', ' ', 'g') AS q FROM documents)"


def _claims(spark, sf):
    d = TB.load(spark, sf, "documents")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % 6 + 1).cast("int"))
    q = F.concat(pick("verify ", "does ", "is ", "check if ", "find if ", "tell me "), F.lit("load_"), "lang", F.lit(".run"), pick(" uses ", " use ", " using ", " calls ", " uses ", " has "), F.regexp_replace("text", r"\s+", " "))
    return d.select(F.col("doc_id").alias("id"), q.alias("q"))


@query(f"""SELECT id, regexp_extract(q, f, 1) AS subject, regexp_extract(q, f, 2) AS claim FROM
(SELECT id, trim(q) AS q, CASE id % 6 WHEN 0 THEN 'verify ([\\w.]+) uses? (.+)' WHEN 1 THEN 'does ([\\w.]+) use (.+)' WHEN 2 THEN 'is ([\\w.]+) using (.+)' WHEN 3 THEN 'check if ([\\w.]+) (.+)' WHEN 4 THEN 'find if ([\\w.]+) uses? (.+)' END AS f FROM {_CLAIMED}) WHERE f IS NOT NULL AND regexp_matches(q, f)""")
def e1_claims(spark, sf):
    return _claims(spark, sf).select("id", T.claim(F.col("q")).alias("c")).where("c IS NOT NULL").select("id", "c.subject", "c.claim")


@query(f"SELECT doc_id AS id, array_to_string({T.TERMS_SQL.format('text')}, ' ') AS terms FROM documents")
def e2_key_terms(spark, sf):
    return _docs(spark, sf).select("id", F.array_join(T.key_terms(F.col("content")), " ").alias("terms"))


@query(f"SELECT id, regexp_matches(lower(q), '^(verify|does|is|check if|confirm|find if) ') AS is_claim FROM {_CLAIMED}")
def e3_is_claim(spark, sf):
    return _claims(spark, sf).select("id", T.is_claim(F.col("q")).alias("is_claim"))


_TERMS = ["load", "runner", "src1"]
_SIG = "SELECT doc_id AS id, 'call' AS type, 'run_' || source AS detail FROM documents UNION ALL SELECT doc_id, 'attribute_read', lang || '_load' FROM documents"
_HITS = "list_filter(['load', 'runner', 'src1'], lambda t: contains(lower(detail), t) OR contains(t, lower(detail)))"


def _signal_chunks(spark, sf):
    c = TB.chunks(spark, sf)
    return c.select("id", F.array(F.concat(F.lit("calls:run_"), "project_id"), F.col("language")).alias("tags"), F.concat(F.lit(V.SECTION + "\nReads: "), "language", F.lit("_load, ")).alias("content"))


@query(f"SELECT id, type, detail FROM ({_SIG})")
def e6_signals(spark, sf):
    return V.signals(_signal_chunks(spark, sf))


_EVIDENCE = f"SELECT DISTINCT type, detail, CASE WHEN len(h) = 0 THEN 0 ELSE least(1.0, 0.5 + CASE WHEN list_contains(['load', 'runner', 'src1'], lower(detail)) THEN 0.4 ELSE 0 END + least(0.1 * (len(h) - 1), 0.3) + CASE WHEN len(list_filter(h, lambda t: length(t) >= 4)) > 0 THEN 0.05 ELSE 0 END) END::DOUBLE AS relevance FROM (SELECT type, detail, {_HITS} AS h FROM ({_SIG}))"


@query(f"SELECT type, detail, round(relevance, 6) AS relevance FROM ({_EVIDENCE}) WHERE relevance > 0")
def e4_e7_evidence(spark, sf):
    return V.evidence(_signal_chunks(spark, sf), " ".join(_TERMS)).withColumn("relevance", R6("relevance"))


@query(f"SELECT 'supported' AS status, round(least(1.0::DOUBLE, (max(relevance) + avg(relevance)) / 2 + 0.1::DOUBLE), 6) AS confidence, count(*) AS n_evidence FROM ({_EVIDENCE}) WHERE relevance > 0")
def e8_verdict(spark, sf):
    return V.verdict(V.evidence(_signal_chunks(spark, sf), " ".join(_TERMS))).withColumn("confidence", R6("confidence"))


# -- chunkers -----------------------------------------------------------------------------------------------------------------
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query(f"""
WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
g AS (SELECT id, i, x, sum(CASE WHEN i = 1 OR regexp_matches({_STRIP.format('x')}, '^(def |class |function |export )') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS c FROM l),
a AS (SELECT id, c, min(i)::INT AS start_line, string_agg(x, chr(10) ORDER BY i) AS chunk FROM g GROUP BY id, c)
SELECT id, (c - 1)::INT AS pos, start_line, chunk FROM a WHERE {_STRIP.format('chunk')} <> ''
""")
def k4_line_prefix(spark, sf):
    return CH.line_prefix(_docs(spark, sf))


@query(f"SELECT id, (i - 1)::INT AS pos, (2 * i - 1)::INT AS start_line, x AS chunk FROM (SELECT doc_id AS id, {_STRIP.format('unnest(string_split(text, chr(10) || chr(10)))')} AS x, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM documents) WHERE x <> ''")
def k5_paragraphs(spark, sf):
    return CH.paragraphs(_docs(spark, sf))


_SENT = f"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"


@query(f"SELECT doc_id AS id, (generate_subscripts({_SENT}, 1) - 1)::INT AS pos, unnest({_SENT}) || '.' AS chunk FROM documents")
def k6_sentences(spark, sf):
    return CH.sentences(_docs(spark, sf))


_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"


@query(f"SELECT id, (i // 512)::INT AS pos, array_to_string(w[i + 1:i + 512], ' ') AS chunk FROM (SELECT doc_id AS id, {_WORDS} AS w, unnest(range(0, len({_WORDS}), 512)) AS i FROM documents)")
def k7_token_windows(spark, sf):
    return CH.token_windows(_docs(spark, sf))


@query(f"SELECT id, pos FROM (SELECT doc_id AS id, (generate_subscripts({_SENT}, 1) - 1)::INT AS pos, unnest({_SENT}) || '.' AS chunk FROM documents) WHERE length(chunk) >= 50")
def k9_long_enough(spark, sf):
    return CH.long_enough(CH.sentences(_docs(spark, sf))).select("id", "pos")


@query(f"""
WITH m AS (SELECT conv_id, turn, role, {_STRIP.format("regexp_replace(text, chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS x FROM conversations WHERE role IN ('user', 'assistant')),
k AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM m WHERE length(x) >= 2),
t AS (SELECT *, sum(CASE WHEN role = 'user' AND coalesce(p, '') <> 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM k),
g AS (SELECT conv_id, n::BIGINT AS turn_no, string_agg(x, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'user') AS u, string_agg(x, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'assistant') AS a FROM t WHERE n > 0 GROUP BY conv_id, n)
SELECT conv_id, turn_no, '[User]: ' || u || coalesce(chr(10) || chr(10) || '[Claude]: ' || a, '') AS chunk FROM g
""")
def k8_turns(spark, sf):
    return CH.turns(TB.load(spark, sf, "conversations"))


# -- extraction -----------------------------------------------------------------------------------------------------------------
def _sources(spark, sf):
    """Python sources made of the documents' ids: enough to exercise parser and graph over a whole table."""
    n = F.col("doc_id")
    body = F.concat(F.lit("import os\nfrom src.util import load_"), (n % 5).cast("string"), F.lit("\n\nLIMIT = 10\n\nclass Job"), n.cast("string"), F.lit("(object):\n    \"\"\"Runs.\"\"\"\n    def run(self, items):\n        for x in items:\n            self.total = self.step(x) + self.cache[x]\n        return load_"), (n % 5).cast("string"), F.lit("(items)\n\n    def step(self, x):\n        return x if x else 0\n\ndef get_"), n.cast("string"), F.lit("(path):\n    return os.path.join(path, 'a')\n"))
    return TB.load(spark, sf, "documents").select(n.alias("id"), F.concat("source", F.lit("/mod"), n.cast("string"), F.lit(".py")).alias("path"), body.alias("content"))


@query("SELECT doc_id AS id, unnest(['imports', 'class', 'accessor']) AS domain, unnest([NULL, 'Job' || doc_id, 'get_' || doc_id]) AS name FROM documents")
def k3_python_chunks(spark, sf):
    return CD.python_chunks(_sources(spark, sf)).select("id", "domain", "name")


@query("SELECT doc_id AS id, unnest(['Job' || doc_id, 'run', 'step', 'get_' || doc_id]) AS name, unnest(['class', 'method', 'method', 'function']) AS kind, unnest([NULL, 'Job' || doc_id, 'Job' || doc_id, NULL]) AS owner FROM documents")
def x2_definitions(spark, sf):
    return CD.definitions(_sources(spark, sf)).select("id", "name", "kind", "owner")


@query("SELECT doc_id AS id, unnest(['run', 'step', 'get_' || doc_id]) AS name, unnest(['calls:step,calls:load_' || (doc_id % 5) || ',reads:cache,writes:total,subscript:cache,param:items', 'param:x', 'calls:join,param:path']) AS tags FROM documents")
def x5_x6_signal_tags(spark, sf):
    return CD.signal_tags(CD.signals(_sources(spark, sf))).select("id", "name", F.array_join("tags", ",").alias("tags"))


@query("SELECT doc_id AS id, count(*)::INT AS n, 1::INT AS n_enriched FROM (SELECT doc_id, unnest([1, 2]) FROM documents) GROUP BY doc_id")
def k10_enrich(spark, sf):
    src = _sources(spark, sf)
    rows = CD.enrich(CD.python_chunks(src).where("domain IN ('class', 'imports')"), CD.signals(src))
    return rows.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum(F.col("has_signals").cast("int")).cast("int").alias("n_enriched"))


@query("SELECT doc_id AS id, ['python','java','go','c','csharp','ruby',NULL][(doc_id % 7 + 1)::INT] AS language FROM documents")
def x1_language(spark, sf):
    ends = F.element_at(F.array(*map(F.lit, (".py", ".java", ".go", ".c", ".cs", ".rb", ".txt"))), (F.col("doc_id") % 7 + 1).cast("int"))
    return TB.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.language(F.concat("source", ends)).alias("language"))


_IMPORTS = (("python", "from a.b import c", "a.b", "from_import"), ("python", "import os, sys", "os", "import"), ("java", "import a.b.C;", "a.b.C", "import"), ("go", 'import "net/http"', "net/http", "import"), ("c", "#include <stdio.h>", "stdio.h", "include"), ("csharp", "using System.IO;", "System.IO", "using"), ("ruby", "require 'json'", "json", "require"))


@query("SELECT doc_id AS id, [" + ", ".join(f"'{m}'" for _, _, m, _ in _IMPORTS) + "][(doc_id % 7 + 1)::INT] AS module, [" + ", ".join(f"'{k}'" for *_, k in _IMPORTS) + "][(doc_id % 7 + 1)::INT] AS type FROM documents")
def x3_imports(spark, sf):
    pick = lambda k: F.element_at(F.array(*(F.lit(r[k]) for r in _IMPORTS)), (F.col("doc_id") % 7 + 1).cast("int"))
    return TB.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), CD.parse_import(pick(1), pick(0)).alias("i")).select("id", "i.module", "i.type")


_ENTITIES = (("function_definition", "test_x", "test"), ("import_statement", "os", "imports"), ("interface_declaration", "Doer", "interface"), ("function_definition", "_hidden", "private"), ("function_definition", "getName", "accessor"), ("assignment", "MAX_SIZE", "constant"), ("class_definition", "Job", "class"), ("function_definition", "run", "function"))


@query("SELECT doc_id AS id, [" + ", ".join(f"'{d}'" for *_, d in _ENTITIES) + "][(doc_id % 8 + 1)::INT] AS domain FROM documents")
def x7_domain(spark, sf):
    pick = lambda k: F.element_at(F.array(*(F.lit(r[k]) for r in _ENTITIES)), (F.col("doc_id") % 8 + 1).cast("int"))
    none = F.array().cast("array<string>")
    return TB.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), CD.domain(pick(0), pick(1), F.lit("src/a.py"), F.lit("python"), none, none).alias("domain"))


@query("SELECT doc_id AS id, ['test','web','data','service','utility','config',NULL][(doc_id % 7 + 1)::INT] AS domain FROM documents")
def x8_inferred_domain(spark, sf):
    mark = F.element_at(F.array(*map(F.lit, ("JUnit", "RestController", "Entity", "Bean", "x", "x", "x"))), (F.col("doc_id") % 7 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, ("a", "a", "a", "a", "StringUtil", "AppConfig", "Plain"))), (F.col("doc_id") % 7 + 1).cast("int"))
    return TB.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), CD.inferred_domain(F.array(mark), F.array(name)).alias("domain"))


@query("SELECT doc_id AS id, doc_id % 3 = 0 AS is_test FROM documents")
def x9_test_file(spark, sf):
    path = F.element_at(F.array(F.lit("src/test_a.py"), F.lit("src/main.py"), F.lit("lib/code.go")), (F.col("doc_id") % 3 + 1).cast("int"))
    return TB.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.is_test_file(path).alias("is_test"))


@query("SELECT doc_id AS id, ['barrel_reexport','constants_only','empty_module','generated_code',NULL][(doc_id % 5 + 1)::INT] AS reason FROM documents")
def x10_simple_files(spark, sf):
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % 5 + 1).cast("int"))
    path, text = pick("a/__init__.py", "a/b.py", "a/c.py", "a/d.py", "a/e.py"), pick("x = 1", "A = 1\nB = 2\nC = 3\nD = 4", "", "# DO NOT EDIT\n", "def f():\n    pass")
    return TB.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), CD.simple_reason(path, F.lit("python"), text, F.when(F.col("doc_id") % 5 == 4, 1).otherwise(0), F.lit(0), F.lit(0)).alias("reason"))


@query("SELECT doc_id AS id, lang AS pattern, source AS purpose, NULL::VARCHAR AS domain, 'a;b' AS exports FROM documents")
def x12_summary_parser(spark, sf):
    text = F.concat(F.lit("Purpose: "), "source", F.lit("\nPattern: "), "lang", F.lit("\nDomain: none\nKey Exports: a, b"))
    p = TB.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), CD.parse_summary(text).alias("p"))
    return p.select("id", "p.pattern", "p.purpose", "p.domain", F.array_join("p.exports", ";").alias("exports"))


@query("SELECT doc_id AS id, 'Purpose: __init__.py re-exports names of its package' || chr(10) || 'Pattern: barrel_reexport' AS summary FROM documents")
def x11_template_summary(spark, sf):
    return TB.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), CD.template_summary(F.concat("source", F.lit("/__init__.py")), F.lit("python"), F.lit("barrel_reexport")).alias("summary"))


@query("SELECT doc_id AS id, sha256(text) AS content_hash FROM documents")
def x13_content_hash(spark, sf):
    return _docs(spark, sf).select("id", T.content_hash(F.col("content")).alias("content_hash"))


@query("SELECT doc_id AS id, source || '.mod' || doc_id AS module FROM documents")
def x14_module_name(spark, sf):
    return TB.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.module_name(F.concat(F.lit("src/"), "source", F.lit("/mod"), F.col("doc_id").cast("string"), F.lit(".py"))).alias("module"))


@query("SELECT doc_id AS id, source AS project FROM documents")
def x15_project_name(spark, sf):
    return TB.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), FS.project_name(F.concat(F.lit("C:\\work\\"), "source", F.lit("\\"))).alias("project"))


# -- files -------------------------------------------------------------------------------------------------------------------
@query("SELECT page_id AS id FROM pages WHERE page_id % 3 <> 0 AND page_id % 2 = 0")
def s2_s3_wanted_files(spark, sf):
    n = F.col("page_id")
    path = F.concat(F.when(n % 3 == 0, "app/node_modules/").otherwise("app/src/"), n.cast("string"), F.when(n % 2 == 0, ".py").otherwise(".exe"))
    return TB.load(spark, sf, "pages").withColumn("p", path).where(FS.wanted(F.col("p")) & ~FS.ignored(F.col("p"))).select(n.alias("id"))


@query("SELECT page_id AS id, CASE WHEN length(html) > 50000 THEN substr(html, 1, 50000) || chr(10) || '... (truncated)' ELSE html END AS content FROM pages")
def s12_shown_content(spark, sf):
    return TB.load(spark, sf, "pages").select(F.col("page_id").alias("id"), FS.shown(F.col("html")).alias("content"))


def _folder(spark):
    return G.fresh_folder(spark)


@query("SELECT doc_id AS id, text AS content FROM documents WHERE doc_id // 5 % 3 <> 1")
def s5_s9_store(spark, sf):
    """Two appends to a store; every third file goes, with its chunks."""
    at, d = _folder(spark), _docs(spark, sf)
    store = FS.Store(spark, f"{at}/a")
    store.add(d.where("id % 2 = 0"))
    store.add(d.where("id % 2 = 1"))
    index = d.groupBy(F.floor(F.col("id") / 5).alias("path")).agg(F.collect_list("id").alias("chunk_ids"))
    return store.delete(I.chunks_of(index.where("path % 3 = 1"), index), f"{at}/b").rows()


@query("SELECT role, text FROM conversations WHERE role IN ('user', 'assistant')")
def s4_conversation_logs(spark, sf):
    """The conversations written as JSON lines and read as logs; other roles aren't messages."""
    at = _folder(spark)
    line = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    TB.load(spark, sf, "conversations").select(line.alias("value")).write.text(at)
    return FS.conversations(spark, at).select("role", "text")


# -- relational ----------------------------------------------------------------------------------------------------------------
def _meta(spark, sf):
    return TB.indexed_files(spark, sf), TB.codebases(spark, sf), TB.summaries(spark, sf)


_WITH = f"WITH {TB.METADATA_SQL}"


@query(f"{_WITH} SELECT file_id, path, codebase FROM files JOIN codebases USING (codebase_id)")
def r1_file_join(spark, sf):
    f, b, _ = _meta(spark, sf)
    return f.join(b, "codebase_id").select("file_id", "path", "codebase")


@query(f"{_WITH} SELECT file_id, path, codebase, language, pattern, status, pattern IS NOT NULL AS has_summary FROM files JOIN codebases USING (codebase_id) LEFT JOIN summaries USING (file_id) WHERE language = 'BUILDING' ORDER BY has_summary DESC, path LIMIT 50 OFFSET 10")
def r2_file_page(spark, sf):
    return M.file_page(*_meta(spark, sf), 50, 10, language="BUILDING")


@query(f"{_WITH} SELECT file_id, path FROM files WHERE file_id NOT IN (SELECT file_id FROM summaries WHERE status = 'F')")
def r3_without_summary(spark, sf):
    """Files without an approved summary."""
    f, _, s = _meta(spark, sf)
    return M.with_summary(f, s.where("status = 'F'"), False).select("file_id", "path")


@query(f"{_WITH} SELECT file_id, path FROM files WHERE file_id IN (SELECT file_id FROM summaries WHERE status = 'F')")
def r3_with_summary(spark, sf):
    f, _, s = _meta(spark, sf)
    return M.with_summary(f, s.where("status = 'F'")).select("file_id", "path")


@query(f"{_WITH} SELECT file_id, path, codebase, pattern, domain, s.status, summary_type FROM files JOIN codebases USING (codebase_id) JOIN summaries s USING (file_id) WHERE pattern = '1-URGENT' AND s.status = 'O' ORDER BY path LIMIT 40")
def r4_summary_page(spark, sf):
    return M.summary_page(*_meta(spark, sf), 40, pattern="1-URGENT", status="O")


@query(f"{_WITH} SELECT file_id, path, codebase, pattern, domain, s.status, summary_type FROM files JOIN codebases USING (codebase_id) JOIN summaries s USING (file_id) WHERE path = 'Customer#000000007' ORDER BY path LIMIT 1")
def r5_one_summary(spark, sf):
    return M.summary_page(*_meta(spark, sf), 1, path="Customer#000000007")


@query(f"{_WITH} SELECT pattern AS value, count(*) AS n FROM summaries WHERE pattern IS NOT NULL GROUP BY pattern")
def r6_counts_by_pattern(spark, sf):
    return M.counts_by(TB.summaries(spark, sf), "pattern")


_STATS = """SELECT codebase, count(DISTINCT f.file_id) AS total_files, count(s.file_id) AS summarized_files,
 count(CASE WHEN summary_type = 'llm' THEN 1 END) AS llm_summaries, count(CASE WHEN summary_type = 'simple' THEN 1 END) AS simple_summaries,
 count(CASE WHEN status = 'F' THEN 1 END) AS approved, count(CASE WHEN status = 'P' THEN 1 END) AS pending, count(CASE WHEN status = 'O' THEN 1 END) AS open
 FROM codebases LEFT JOIN files f USING (codebase_id) LEFT JOIN summaries s USING (file_id) GROUP BY codebase"""


@query(f"{_WITH} {_STATS}")
def r7_codebase_stats(spark, sf):
    return M.codebase_stats(*_meta(spark, sf))


@query(f"{_WITH} SELECT sum(total_files)::BIGINT AS total_files, sum(summarized_files)::BIGINT AS summarized_files, sum(llm_summaries)::BIGINT AS llm_summaries, sum(simple_summaries)::BIGINT AS simple_summaries, sum(approved)::BIGINT AS approved, sum(pending)::BIGINT AS pending, sum(open)::BIGINT AS open FROM ({_STATS})")
def r8_totals(spark, sf):
    return M.totals(M.codebase_stats(*_meta(spark, sf)))


@query(f"{_WITH} {_STATS}")
def r9_refreshed_view(spark, sf):
    return M.refreshed(M.codebase_stats(*_meta(spark, sf)))


@query("SELECT n_name AS codebase FROM nation ORDER BY n_name")
def r10_codebases(spark, sf):
    return TB.codebases(spark, sf).select("codebase").orderBy("codebase")


@query(f"{_WITH} SELECT file_id, CASE WHEN file_id IN (1, 2, 4, 7) THEN 'approved' ELSE status END AS status FROM summaries")
def r11_set_status(spark, sf):
    return M.set_status(TB.summaries(spark, sf), [1, 2, 4, 7], "approved").select("file_id", "status")


@query(f"{_WITH} SELECT file_id, path FROM files WHERE codebase_id NOT IN (SELECT codebase_id FROM codebases WHERE codebase < 'F')")
def r12_delete_using(spark, sf):
    f, b, _ = _meta(spark, sf)
    return M.delete_where(f, b.where("codebase < 'F'"), "codebase_id").select("file_id", "path")


@query(f"{_WITH} SELECT coalesce(n.file_id, o.file_id) AS file_id, coalesce(n.path, o.path) AS path FROM files o FULL JOIN (SELECT file_id + 100 AS file_id, 'new' || file_id AS path FROM files WHERE file_id % 2 = 0) n ON n.file_id = o.file_id")
def s6_s7_upsert(spark, sf):
    f = TB.indexed_files(spark, sf).select("file_id", "path")
    new = f.where("file_id % 2 = 0").select((F.col("file_id") + 100).alias("file_id"), F.concat(F.lit("new"), F.col("file_id").cast("string")).alias("path"))
    return M.upsert(f, new, "file_id")


@query(f"{_WITH} SELECT file_id, path, codebase FROM files JOIN codebases USING (codebase_id)")
def s15_migrate(spark, sf):
    at = _folder(spark)
    f, b, _ = _meta(spark, sf)
    FS.migrate({"files": f, "codebases": b}, at)
    read = spark.read.parquet
    return read(f"{at}/files").join(read(f"{at}/codebases"), "codebase_id").select("file_id", "path", "codebase")


@query(f"{_WITH} SELECT file_id, path FROM files WHERE file_id IN (3, 5, 8)")
def s8_get_by_ids(spark, sf):
    return TB.indexed_files(spark, sf).where(F.col("file_id").isin(3, 5, 8)).select("file_id", "path")


# -- listings -------------------------------------------------------------------------------------------------------------------
@query(f"{_WITH} SELECT file_id, path FROM files ORDER BY path LIMIT 25 OFFSET 25")
def l1_files(spark, sf):
    return M.page(TB.indexed_files(spark, sf).select("file_id", "path"), [F.asc("path")], 25, 25)


@query(f"{_WITH} SELECT file_id, path, codebase, language, pattern, status, true AS has_summary FROM files JOIN codebases USING (codebase_id) JOIN summaries USING (file_id) WHERE contains(lower(path), '00001') ORDER BY path LIMIT 30")
def l2_files_filtered(spark, sf):
    return M.file_page(*_meta(spark, sf), 30, has_summary=True, search="00001")


@query(f"WITH {TB.MEMORIES_SQL} SELECT id, memory_type, created_at, substr(coalesce(content, ''), 1, 200) AS preview FROM memories WHERE memory_type <> 'code' ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 5")
def l4_memories(spark, sf):
    return M.memory_page(TB.memories(spark, sf), 20, 5)


@query(f"{_WITH} SELECT kind, value, n FROM (SELECT 'pattern' AS kind, pattern AS value, count(*) AS n FROM summaries GROUP BY pattern UNION ALL SELECT 'domain', domain, count(*) FROM summaries GROUP BY domain UNION ALL SELECT 'status', status, count(*) FROM summaries GROUP BY status UNION ALL SELECT 'summary_type', summary_type, count(*) FROM summaries GROUP BY summary_type)")
def l6_summary_statistics(spark, sf):
    return M.summary_statistics(TB.summaries(spark, sf))


@query(f"{_WITH} SELECT file_id, pattern, status, (SELECT count(*) FROM summaries WHERE status = 'F') AS reviewed_count FROM summaries WHERE status = 'P' ORDER BY file_id LIMIT 10")
def l7_validation_queue(spark, sf):
    return M.validation_queue(TB.summaries(spark, sf), status="P")


@query(f"{_WITH} SELECT codebase_id, count(*) AS n_files, count(status) AS n_done, count(status) / count(*)::DOUBLE AS progress, CASE WHEN count(CASE WHEN status = 'P' THEN 1 END) > 0 THEN 'indexing' WHEN count(status) = count(*) THEN 'completed' WHEN count(status) = 0 THEN 'not_started' ELSE 'partial' END AS status FROM files LEFT JOIN summaries USING (file_id) GROUP BY codebase_id")
def l8_status(spark, sf):
    return M.status_rollup(*(_meta(spark, sf)[i] for i in (0, 2)))


def _index(spark, sf):
    """path, mtime, content_hash, chunk_ids: up to nine documents of a source are a file; an id that no chunk has is among them."""
    c = TB.chunks(spark, sf).withColumn("path", F.concat("project_id", F.lit("/"), F.floor(F.col("id") / 9).cast("string")))
    ids = F.concat(F.array_sort(F.collect_list("id")), F.array(F.lit(-1).cast("long")))
    return c.groupBy("path").agg(F.max("id").cast("double").alias("mtime"), F.count(F.lit(1)).cast("string").alias("content_hash"), ids.alias("chunk_ids"), F.min("language").alias("pattern"), F.min("domain").alias("domain"))


_NINE = f"c AS ({TB.CHUNKS_SQL}), x AS (SELECT project_id || '/' || id // 9 AS path, max(id)::DOUBLE AS mtime, count(*)::VARCHAR AS content_hash, count(*) AS chunk_count, min(language) AS pattern, min(domain) AS domain FROM c GROUP BY 1)"


@query(f"WITH {_NINE} SELECT x.path, mtime, content_hash, chunk_count, id, content, CASE WHEN chunk_count % 2 = 0 THEN x.pattern END AS pattern FROM x JOIN c ON c.project_id || '/' || c.id // 9 = x.path")
def l3_file_details(spark, sf):
    """Every file, asked for with backslashes; those with an even number of chunks have a summary."""
    index = _index(spark, sf)
    paths = index.select(F.translate("path", "/", "\\").alias("path"))
    rows = M.file_details(index.drop("pattern", "domain"), TB.chunks(spark, sf), index.where("content_hash % 2 = 0"), paths)
    return rows.select("path", "mtime", "content_hash", "chunk_count", "id", "content", "pattern")


@query(f"{_WITH} SELECT path, pattern, domain, summarized_at, CASE WHEN length(coalesce(text, '')) > 300 THEN substr(text, 1, 300) || '...' ELSE coalesce(text, '') END AS content_preview, coalesce(text, '') AS content, (SELECT count(*) FROM summaries) AS total, 45 < (SELECT count(*) FROM summaries) AS has_more FROM summaries JOIN files USING (file_id) LEFT JOIN documents ON doc_id = file_id ORDER BY path LIMIT 30 OFFSET 15")
def l5_summary_listing(spark, sf):
    f, _, s = _meta(spark, sf)
    texts = TB.load(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))
    return M.summary_listing(s.join(f.select("file_id", "path"), "file_id"), texts, 30, 15)


@query(f"{_WITH} SELECT codebase, count(f.file_id) + coalesce(sum(CASE WHEN file_id % 3 = 0 THEN 1 WHEN file_id % 3 = 1 THEN -1 END), 0)::BIGINT AS indexed, count(s.file_id) - count(CASE WHEN file_id % 3 = 1 THEN s.file_id END) AS summarized FROM files f JOIN codebases USING (codebase_id) LEFT JOIN summaries s USING (file_id) GROUP BY codebase")
def l9_counts(spark, sf):
    """Every third file is added once more, another third is removed with its summary."""
    f, b, s = _meta(spark, sf)
    rows = f.join(b, "codebase_id").join(s.select("file_id", "pattern"), "file_id", "left")
    change = F.when(F.col("file_id") % 3 == 0, 1).when(F.col("file_id") % 3 == 1, -1)
    deltas = rows.select("codebase", F.coalesce(change, F.lit(0)).cast("long").alias("indexed"), F.when((change == -1) & F.col("pattern").isNotNull(), -1).otherwise(0).cast("long").alias("summarized"))
    counts = rows.groupBy("codebase").agg(F.count(F.lit(1)).alias("indexed"), F.count("pattern").alias("summarized"))
    return M.counts_after(counts, deltas)


@query("WITH j AS (SELECT CASE user_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'skipped' END AS state, value AS seconds FROM events), r AS (SELECT count(*) FILTER (state = 'queued') AS files_queued, count(*) FILTER (state = 'failed') AS files_failed, count(*) FILTER (state <> 'queued') AS files_processed, count(*) AS files_total, avg(seconds) FILTER (state = 'completed') AS a FROM j) SELECT files_queued, files_failed, files_processed, files_total, round(a, 6) AS avg_seconds, round(files_processed / files_total * 100.0, 6) AS progress_percentage, round((a + 0.5) * files_queued, 4) AS seconds_remaining FROM r")
def l9_queue_progress(spark, sf):
    state = F.element_at(F.array(*map(F.lit, ("queued", "completed", "failed", "skipped"))), (F.col("user_id") % 4 + 1).cast("int"))
    rows = M.queue_progress(TB.load(spark, sf, "events").select(state.alias("state"), F.col("value").alias("seconds")), 0.5)
    return rows.withColumns({"avg_seconds": R6("avg_seconds"), "progress_percentage": R6("progress_percentage"), "seconds_remaining": F.round("seconds_remaining", 4)})


def _stored(spark, sf):
    """Stored summaries: every third document is plain text of old, the others are JSON objects."""
    e, n = TB.load(spark, sf, "events"), F.col("event_id")
    json = F.concat(F.lit('{"purpose": "does '), "event_type", F.lit('", "pattern": "p'), (n % 5).cast("string"), F.lit('"}'))
    return e.select(F.concat(F.lit("f"), n.cast("string")).alias("path"), F.when(n % 3 == 0, F.concat(F.lit("handles "), "event_type")).otherwise(json).alias("document"), F.lit("old").alias("pattern"), F.lit("d").alias("domain"), F.lit("m").alias("model"), n.cast("string").alias("content_hash"), F.when(n % 4 == 0, "approved").alias("validation_status"))


@query("SELECT 'f' || event_id AS path, CASE WHEN event_id % 3 = 0 THEN 'handles ' ELSE 'does ' END || event_type AS purpose, CASE WHEN event_id % 3 = 0 THEN 'old' ELSE 'p' || event_id % 5 END AS pattern, CASE WHEN event_id % 3 = 0 THEN 'd' END AS domain, CASE WHEN event_id % 3 = 0 THEN 'm' END AS model_used, NULL::VARCHAR AS how_it_works, event_id::VARCHAR AS content_hash, CASE WHEN event_id % 4 = 0 THEN 'approved' ELSE 'unreviewed' END AS validation_status FROM events")
def l10_full_summary(spark, sf):
    return M.full_summary(_stored(spark, sf))


@query("SELECT 'f' || event_id AS path, CASE WHEN event_id % 2 = 0 THEN 'rejected' WHEN event_id % 7 = 0 THEN 'needs_review' WHEN event_id % 4 = 0 THEN 'approved' END AS validation_status FROM events")
def l10_validate(spark, sf):
    """Reviews of every seventh, and later ones of every second, stored summary."""
    s = _stored(spark, sf)
    n = F.col("content_hash").cast("long")
    reviews = s.where(n % 7 == 0).select("path", F.lit("needs_review").alias("status"), F.lit(1).alias("reviewed_at")).unionByName(s.where(n % 2 == 0).select("path", F.lit("rejected").alias("status"), F.lit(2).alias("reviewed_at")))
    return M.validate(s, reviews).select("path", "validation_status")


@query(f"{_WITH} SELECT codebase, count(*) AS n_files, array_to_string(list_sort(list(path))[1:100], ',') AS paths FROM files JOIN codebases USING (codebase_id) GROUP BY codebase")
def l11_codebase_list(spark, sf):
    f, b, _ = _meta(spark, sf)
    return M.codebase_list(f, b).withColumn("paths", F.array_join("paths", ","))


# -- graphs ---------------------------------------------------------------------------------------------------------------------
_E = f"WITH RECURSIVE {TB.EDGES_SQL}"


@query(f"{_E} SELECT src, dst FROM edges")
def g2_g9_edges(spark, sf):
    return G.build(TB.edges(spark, sf))


@query(f"{_E}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT node, (SELECT count(*) FROM edges WHERE dst = node) AS degree FROM n")
def g4_in_degree(spark, sf):
    return G.in_degree(TB.edges(spark, sf))


@query()
def g3_pagerank(spark, sf):
    return G.pagerank(TB.edges(spark, sf))


@query()
def g4_g5_centrality(spark, sf):
    return G.centrality(TB.edges(spark, sf))


_WALK = "w AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.dst, depth + 1 FROM w JOIN edges e ON e.src = w.node WHERE depth < {0})"


@query(f"{_E}, {_WALK.format(2)} SELECT node, min(depth)::INT AS depth FROM w WHERE node <> 1 GROUP BY node")
def g13_reach(spark, sf):
    return G.reach(TB.edges(spark, sf), spark.range(1).select(F.lit(1).cast("long").alias("node")), 2)


@query(f"{_E}, {_WALK.replace('e.dst', 'e.src').replace('e.src = w', 'e.dst = w').format(1)} SELECT node, min(depth)::INT AS depth FROM w WHERE node <> 1 GROUP BY node")
def g10_callers(spark, sf):
    return G.reach(G.reversed_(TB.edges(spark, sf)), spark.range(1).select(F.lit(1).cast("long").alias("node")), 1)


#: Paths of up to three nodes, which the test graphs have between all nodes that are connected at all.
_PATHS = "w AS (SELECT 1::BIGINT AS node, [1::BIGINT] AS p UNION ALL SELECT e.dst, list_append(p, e.dst) FROM w JOIN edges e ON e.src = w.node WHERE NOT list_contains(p, e.dst) AND len(p) < 3)"
_FIRST = f"{_E}, {_PATHS} SELECT array_to_string(p, ',') AS path FROM w WHERE node = 16 ORDER BY len(p), p LIMIT 1"


@query(_FIRST)
def g11_shortest_path(spark, sf):
    return G.shortest_path(TB.edges(spark, sf), 1, 16).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query(_FIRST)
def g12_call_chain(spark, sf):
    return G.call_chain(TB.edges(spark, sf), 1, 16).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query(f"{_E}, w AS (SELECT src AS a, [src, dst] AS p FROM edges WHERE src < dst UNION ALL SELECT a, list_append(p, t.dst) FROM w JOIN edges t ON t.src = p[-1] WHERE t.dst > a AND NOT list_contains(p, t.dst) AND len(p) < 3) SELECT array_to_string(p, ',') AS cycle FROM w JOIN edges t ON t.src = p[-1] AND t.dst = a")
def g16_cycles(spark, sf):
    return G.cycles(TB.edges(spark, sf), 3).select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ",").alias("cycle"))


@query(f"{_E}, r AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON e.src = r.dst) SELECT count(*) > 0 AS has_cycle FROM r WHERE src = dst")
def g16_has_cycle(spark, sf):
    return spark.createDataFrame([(G.has_cycle(TB.edges(spark, sf)),)], "has_cycle boolean")


@query(f"{_E}, {_WALK.format(4)} SELECT max(d)::INT AS call_depth FROM (SELECT min(depth) AS d FROM w GROUP BY node)")
def g15_call_depth(spark, sf):
    return G.call_depth(TB.edges(spark, sf), 1)


@query("SELECT s_name AS name FROM supplier WHERE regexp_matches(lower(s_name), '^supplier.*0.7$') ORDER BY name")
def g14_name_search(spark, sf):
    return G.find(TB.load(spark, sf, "supplier").select(F.col("s_name").alias("name")), "supplier*0?7")


@query(f"{_E} SELECT (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS n_nodes, count(*) AS n_edges, count(DISTINCT dst) AS with_callers, count(DISTINCT src) AS with_callees FROM edges")
def g6_g17_stats(spark, sf):
    return G.stats(TB.edges(spark, sf))


@query(f"{_E} SELECT node, count(*) FILTER (k = 0) AS n_callers, count(*) FILTER (k = 1) AS n_callees FROM (SELECT dst AS node, 0 AS k FROM edges UNION ALL SELECT src, 1 FROM edges) GROUP BY node")
def g19_relations(spark, sf):
    return G.relations(TB.edges(spark, sf))


@query(f"{_E} SELECT '{{\"id\":' || src || ',\"links\":[' || string_agg(dst::VARCHAR, ',' ORDER BY dst) || ']}}' AS json FROM edges GROUP BY src")
def s11_g18_export(spark, sf):
    return G.export_json(TB.edges(spark, sf))


@query("WITH c AS (SELECT l_orderkey AS path, 'C' || l_linenumber AS class, l_linenumber * 10 AS first, l_linenumber * 10 + 8 AS last FROM lineitem), m AS (SELECT DISTINCT o_orderkey AS path, 'm' AS name, (o_orderkey % 37)::INT AS line FROM orders) SELECT m.path, name, line, min_by(class, first) FILTER (line BETWEEN first AND last) AS class FROM m LEFT JOIN c ON m.path = c.path GROUP BY m.path, name, line")
def g8_containment(spark, sf):
    c = TB.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.concat(F.lit("C"), F.col("l_linenumber").cast("string")).alias("class"), (F.col("l_linenumber") * 10).alias("first"), (F.col("l_linenumber") * 10 + 8).alias("last"))
    m = TB.load(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.lit("m").alias("name"), (F.col("o_orderkey") % 37).cast("int").alias("line")).distinct()
    return G.contain(m, c)


@query("WITH f AS (SELECT 'f' || s_suppkey AS path, 'pkg.mod' || s_suppkey AS module FROM supplier) SELECT DISTINCT 'f' || l_suppkey AS src, f.path AS dst FROM lineitem JOIN f ON f.module = 'pkg.mod' || (l_partkey % 200) WHERE 'f' || l_suppkey <> f.path")
def g1_import_resolution(spark, sf):
    s = TB.load(spark, sf, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("path"), F.concat(F.lit("pkg.mod"), F.col("s_suppkey").cast("string")).alias("module"), F.col("s_suppkey").alias("pos"))
    i = TB.load(spark, sf, "lineitem").select(F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("pkg.mod"), (F.col("l_partkey") % 200).cast("string")).alias("module"))
    return G.resolve_imports(s, i)


@query("SELECT 'Job' || doc_id || '.run' AS src, unnest(['Job' || doc_id || '.step', 'load_' || (doc_id % 5)]) AS dst FROM documents UNION ALL SELECT 'get_' || doc_id, 'os.path.join' FROM documents")
def g7_call_graph(spark, sf):
    src = _sources(spark, sf)
    return CD.call_edges(CD.signals(src), CD.definitions(src))


# -- incremental -----------------------------------------------------------------------------------------------------------------
_SNAP = "o AS (SELECT path, file_id % 10 AS m, file_id % 7 AS h FROM files WHERE file_id % 5 <> 0), n AS (SELECT path, CASE WHEN file_id % 3 = 0 THEN file_id % 10 + 1 ELSE file_id % 10 END AS m, CASE WHEN file_id % 6 = 0 THEN -1 ELSE file_id % 7 END AS h FROM files WHERE file_id % 4 <> 0)"


def _snapshots(spark, sf):
    f, n = TB.indexed_files(spark, sf), F.col("file_id")
    old = f.where("file_id % 5 != 0").select("path", (n % 10).cast("double").alias("mtime"), (n % 7).cast("string").alias("content_hash"))
    new = f.where("file_id % 4 != 0").select("path", F.when(n % 3 == 0, n % 10 + 1).otherwise(n % 10).cast("double").alias("mtime"), F.when(n % 6 == 0, F.lit("-1")).otherwise((n % 7).cast("string")).alias("content_hash"))
    return old, new


@query(f"{_WITH}, {_SNAP} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.m = n.m THEN 'same' WHEN o.h <> n.h THEN 'modified' ELSE 'touched' END AS change FROM o FULL JOIN n ON o.path = n.path")
def i1_i2_changes(spark, sf):
    return I.changes(*_snapshots(spark, sf))


@query(f"{_WITH}, {_SNAP} SELECT n.path FROM n LEFT JOIN o ON o.path = n.path WHERE o.path IS NULL OR o.h <> n.h")
def i9_needs_summary(spark, sf):
    old, new = _snapshots(spark, sf)
    return I.needs_summary(new, old).select("path")


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 2")
def i3_orphans(spark, sf):
    d = _docs(spark, sf)
    index = d.where("id % 3 != 2").groupBy(F.floor(F.col("id") / 9).alias("path")).agg(F.collect_list("id").alias("chunk_ids"))
    return I.orphans(d.select("id"), index)


@query("SELECT event_id AS id, CASE WHEN event_type IN ('code','conversation','decision','lesson') THEN event_type ELSE 'conversation' END AS memory_type, 'user' AS role, event_id % 2 = 0 AS pin, 'a,codebase:x' AS tags FROM events")
def i4_store_memory(spark, sf):
    e = TB.load(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("memory_type"), F.lit("nobody").alias("role"), F.array(F.lit("a")).alias("tags"), (F.col("event_id") % 2 == 0).alias("pin"))
    return I.stored_memory(e, "x").withColumn("tags", F.array_join("tags", ","))


_KEEP = "source = 'codebase_indexing' OR memory_type IN ('decision', 'lesson') OR coalesce(created_at > TIMESTAMP '2024-01-20', false) OR project_id <> 'project1'"


@query(f"WITH {TB.MEMORIES_SQL} SELECT count(*) FILTER (NOT ({_KEEP})) AS pruned, count(*) FILTER ({_KEEP}) AS kept, count(*) AS total FROM memories")
def i5_prune(spark, sf):
    return I.prune_counts(I.prune(TB.memories(spark, sf), "project1", F.lit("2024-01-20").cast("timestamp_ntz")))


@query(f"{_WITH} SELECT file_id, path, coalesce(s_acctbal, 0)::DOUBLE AS score FROM files LEFT JOIN supplier ON s_suppkey = file_id WHERE file_id NOT IN (SELECT file_id FROM summaries WHERE status = 'F') AND path NOT LIKE '%5'")
def i8_summary_queue(spark, sf):
    f, _, s = _meta(spark, sf)
    scores = TB.load(spark, sf, "supplier").select(F.col("s_suppkey").alias("file_id"), F.col("s_acctbal").alias("score"))
    return I.summary_queue(f, s.where("status = 'F'"), scores, ("*5",))


@query("WITH r AS (SELECT 'store' || (user_id % 3) AS store, event_id // 4 AS id FROM events), g AS (SELECT id, min(store) AS store FROM r WHERE id % 2 = 0 GROUP BY id) SELECT store, id FROM r ANTI JOIN g USING (id, store)")
def i6_delete_across_stores(spark, sf):
    rows = TB.load(spark, sf, "events").select(F.concat(F.lit("store"), (F.col("user_id") % 3).cast("string")).alias("store"), F.floor(F.col("event_id") / 4).alias("id"))
    return I.delete_first(rows, rows.where("id % 2 = 0")).select("store", "id")


def _summary_chunks(spark, sf):
    f, b, s = _meta(spark, sf)
    named = f.join(b, "codebase_id")
    return named.join(s.select("file_id"), "file_id"), named.select("codebase", "file_id", F.when(F.col("file_id") % 3 == 0, I.SUMMARY_SOURCE).otherwise("code").alias("source")), b


@query(f"{_WITH} SELECT codebase, count(s.file_id) AS summaries_cleared, count(CASE WHEN file_id % 3 = 0 THEN 1 END) AS chunks_removed, '2' AS schema_version FROM codebases LEFT JOIN files USING (codebase_id) LEFT JOIN summaries s USING (file_id) GROUP BY codebase")
def i10_invalidate(spark, sf):
    return I.invalidate(*_summary_chunks(spark, sf), "2")


@query(f"{_WITH} SELECT file_id FROM files JOIN codebases USING (codebase_id) WHERE file_id % 3 <> 0 OR codebase >= 'F'")
def i10_chunks_left(spark, sf):
    _, chunks, b = _summary_chunks(spark, sf)
    return I.without_summaries(chunks, b.where("codebase < 'F'")).select("file_id")


@query(f"{_WITH}, {_SNAP} SELECT n.path, n.m::DOUBLE AS mtime, CASE WHEN o.h = n.h THEN 'c' || o.h END AS derived FROM n LEFT JOIN o ON o.path = n.path")
def i2_next_snapshot(spark, sf):
    old, new = _snapshots(spark, sf)
    return I.apply_changes(old.withColumn("derived", F.concat(F.lit("c"), "content_hash")), new).select("path", "mtime", "derived")


@query("WITH v AS (SELECT 'f' || (user_id % 50) AS path, epoch(ts)::DOUBLE AS mtime, event_id::VARCHAR AS content_hash FROM events) SELECT path, mtime, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mtime DESC, content_hash DESC) AS n FROM v) WHERE n = 1")
def i7_watch_fold(spark, sf):
    v = TB.load(spark, sf, "events").select(F.concat(F.lit("f"), (F.col("user_id") % 50).cast("string")).alias("path"), F.col("ts").cast("timestamp").cast("double").alias("mtime"), F.col("event_id").cast("string").alias("content_hash"))
    return W.apply_batch(v.where("content_hash < '5'"), v.where("content_hash >= '5'"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def x_event_windows(spark, sf):
    """An extra: event-time windows, the same code as on a stream."""
    return W.event_counts(TB.load(spark, sf, "events"))
