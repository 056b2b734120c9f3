"""Units with known answers, and every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from rankloom import catalog
from rankloom.functions import text as T
from rankloom.operators import chunking as CH
from rankloom.operators import code as CD
from rankloom.operators import graph as G
from rankloom.operators import incremental as I
from rankloom.operators import metadata as M
from rankloom.operators import search as S
from rankloom.operators import verify as V
from rankloom.sources import files as FS
from rankloom.streaming import watch as W

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(frame, cols):
    return sorted(frame[cols].astype(object).where(frame[cols].notna(), None).astype(str).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_against_sql(spark, duck, name):
    a, b = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert plain(a, sorted(a.columns)) == plain(b, sorted(a.columns))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "question, subject, claim",
    [
        ("verify load_orders uses csv.reader", "load_orders", "csv.reader"),
        ("does RateLimiter use  a token bucket", "RateLimiter", "a token bucket"),
        ("is Mailer using retries", "Mailer", "retries"),
        ("does close_account call audit", "close_account", "audit"),
        ("find if worker.loop uses threads", "worker.loop", "threads"),
        ("check if close_account accesses ledger", "close_account", "accesses ledger"),
    ],
)
def test_claims(spark, question, subject, claim):
    got = one(spark, T.claim(F.lit(question)))
    assert (got.subject, got.claim) == (subject, claim)


def test_no_claim(spark):
    assert one(spark, T.claim(F.lit("where are invoices printed"))) is None


def test_key_terms(spark):
    assert one(spark, T.key_terms(F.lit("the cell_offset for TileGrid lookup"))) == ["cell_offset", "TileGrid", "lookup"]
    assert one(spark, T.key_terms(F.lit("the a an"))) == []


def test_relevance(spark):
    score = lambda s, *t: one(spark, V.relevance(F.lit(s), F.array(*map(F.lit, t))))
    assert score("ledger", "ledger") == pytest.approx(0.95)
    assert score("self._ledger", "ledger") == pytest.approx(0.55)
    assert score("book.ledger[row_no]", "ledger", "row_no") == pytest.approx(0.65)
    assert score("close_account", "reopen") == 0


def test_boosts(spark):
    rows = spark.createDataFrame([(1, "class", "code", "2024-01-31"), (2, "test", "code", "2023-12-03"), (3, None, "decision", None)], "id int, domain string, memory_type string, created_at string").withColumn("score", F.lit(1.0))
    got = {r.id: r.score for r in S.boosted(rows, F.lit("2024-02-01")).collect()}
    assert got[1] == pytest.approx(1.2 * 1.1 * (0.8 + 0.7 * math.exp(-1 / 30)))
    assert got[2] == pytest.approx(0.7 * 1.1 * (0.8 + 0.7 * math.exp(-2)))
    assert got[3] == pytest.approx(1.3)


def test_tags(spark):
    tags = F.array(F.lit("domain:class"), F.lit("ext:.py"), F.lit("file:test.py"))
    for pattern, wanted in (("domain:class", True), ("domain:*", True), ("module:*", False), ("domain:function", False)):
        assert one(spark, S.tag_match(tags, pattern)) is wanted


def test_change_detection(spark):
    old = spark.createDataFrame([("a", 1.0, "x"), ("b", 1.0, "x"), ("c", 1.0, "x"), ("d", 1.0, "x")], "path string, mtime double, content_hash string")
    new = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y"), ("c", 2.0, "x"), ("e", 1.0, "x")], "path string, mtime double, content_hash string")
    assert dict(map(tuple, I.changes(old, new).collect())) == {"a": "same", "b": "modified", "c": "touched", "d": "deleted", "e": "new"}


def test_ignored(spark):
    paths = ["tool/go.py", "tool/__pycache__/q", "r/.git/s", "web/node_modules/t/u.js", "venv/v.py", "w.pyc"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.p for r in rows.where(~FS.ignored(F.col("p"))).collect()] == ["tool/go.py"]


def test_scan_and_chunks(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("import os\nimport sys\nimport json  # more\n\n\ndef get_x(p):\n    return os.path.join(p)\n")
    (tmp_path / "b.exe").write_text("no")
    rows = FS.scan(spark, FS.Config(path=str(tmp_path))).withColumn("id", F.lit(1).cast("long"))
    assert [r.path for r in rows.collect()] == ["src/a.py"]
    assert [(r.domain, r.name) for r in CH.dispatch(rows).orderBy("pos").collect()] == [("imports", None), ("accessor", "get_x")]


def test_jsonl(spark, tmp_path):
    log = tmp_path / "abc-1.jsonl"
    log.write_text('{"type":"user","cwd":"/home/x/proj","message":{"role":"user","content":"hello"}}\nnot json\n{"type":"progress"}\n{"type":"user","isMeta":true,"message":{"content":"x"}}\n{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":"hi"},{"type":"tool_use","name":"Read","input":{}},{"type":"tool_result"}]}}\n')
    rows = FS.conversations(spark, str(log))
    assert [(r.conv_id, r.role, r.text) for r in rows.orderBy("turn").collect()] == [("abc-1", "user", "hello"), ("abc-1", "assistant", "hi\n[Tool: Read]\n[Tool result]")]
    assert CH.turns(rows).first()["chunk"] == "[User]: hello\n\n[Claude]: hi\n[Tool: Read]\n[Tool result]"


def edges(spark, text):
    return spark.createDataFrame([tuple(x) for x in text.split()], "src string, dst string")


def test_paths(spark):
    e = edges(spark, "AB BC CD")
    assert G.shortest_path(e, "A", "D").first()["path"] == list("ABCD")
    assert G.shortest_path(e, "D", "A").count() == 0
    assert G.shortest_path(e, "A", "A").first()["path"] == ["A"]
    assert G.call_chain(e, "A", "D", 2).count() == 0 and G.call_chain(e, "A", "D", 3).count() == 1


def test_long_path(spark):
    """A path of more than 64 steps beside shortcuts that lead nowhere; none the other way."""
    e = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(i, i - 1) for i in range(1, 40)] + [(i, 100 + i) for i in range(70)], "src int, dst int").coalesce(1)
    assert G.shortest_path(e, 0, 70).first()["path"] == list(range(71))
    assert G.shortest_path(e, 60, 0).count() == 0


def test_chain_of_default_depth(spark):
    e = edges(spark, " ".join("ABCDEFGHIJKL"[i : i + 2] for i in range(11)))
    assert G.call_chain(e, "A", "K").first()["path"] == list("ABCDEFGHIJK")
    assert G.call_chain(e, "A", "L").count() == 0


def test_cycles(spark):
    assert not G.has_cycle(edges(spark, "AB BC AC"))
    assert G.has_cycle(edges(spark, "AB BA"))
    assert [r.cycle for r in G.cycles(edges(spark, "AB BC CA"), 3).collect()] == [list("ABC")]


def test_pagerank(spark):
    got = {r.node: r["rank"] for r in G.pagerank(edges(spark, "AB BC CA DA")).collect()}
    assert sum(got.values()) == pytest.approx(1, abs=1e-4)
    assert got["D"] == pytest.approx(0.15 / 4, abs=1e-4) and got["A"] > got["C"]


def test_watch(spark, tmp_path):
    schema = "path string, mtime double, content_hash string"
    for k, rows in enumerate([[("a", 1.0, "x"), ("b", 1.0, "x")], [("a", 2.0, "y")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    q = W.watch(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], schema).schema, str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "0")).collect()
    assert sorted((r.path, r.content_hash) for r in got) == [("a", "y"), ("b", "x")]


def test_store(spark, tmp_path):
    s = FS.Store(spark, str(tmp_path / "a"))
    s.add(spark.range(5))
    s.add(spark.range(5, 8))
    t = s.delete(spark.range(2), str(tmp_path / "b"))
    assert (s.rows().count(), t.rows().count(), t.get([1, 4]).count(), t.clear(str(tmp_path / "c")).rows().count()) == (8, 6, 1, 0)


def test_enriched_chunks(spark):
    src = spark.createDataFrame([(1, "def run(self, a):\n    return self.go(a)[0]\n")], "id long, content string")
    row = CD.enrich(CD.python_chunks(src), CD.signals(src)).first()
    assert row.has_signals and "[Implementation Signals]\nCalls: go" in row.chunk


def test_file_details(spark):
    index = spark.createDataFrame([("a/b.py", 1.0, "h", [1, 2, 9]), ("c\\d.py", 2.0, "i", []), ("e", 3.0, "j", None)], "path string, mtime double, content_hash string, chunk_ids array<long>")
    chunks = spark.createDataFrame([(1, "x", ["t"]), (2, None, None), (3, "z", [])], "id long, content string, tags array<string>")
    notes = spark.createDataFrame([("a\\b.py", "p", "d")], "path string, pattern string, domain string")
    paths = spark.createDataFrame([("a\\b.py",), ("a/b.py",), ("c/d.py",), ("f",)], "path string")
    got = sorted(((r.path, r.chunk_count, r.id, r.pattern) for r in M.file_details(index, chunks, notes, paths).collect()), key=str)
    assert got == [("a/b.py", 2, 1, "p"), ("a/b.py", 2, 2, "p"), ("c\\d.py", 0, None, None)]


def test_stored_summaries(spark):
    rows = [("a", '{"purpose": "new", "pattern": "q"}', "p", None), ("b", "{broken", "p", "approved"), ("c", None, "p", None), ("d", "", "p", None)]
    stored = spark.createDataFrame([(p, d, x, "dom", "m", None, v) for p, d, x, v in rows], "path string, document string, pattern string, domain string, model string, content_hash string, validation_status string")
    got = {r.path: (r.purpose, r.pattern, r.validation_status) for r in M.full_summary(stored).collect()}
    assert got == {"a": ("new", "q", "unreviewed"), "b": ("{broken", "p", "approved"), "c": (None, "p", "unreviewed"), "d": ("", "p", "unreviewed")}
    reviews = spark.createDataFrame([("a", "rejected", 1), ("a", "approved", 2), ("z", "approved", 1)], "path string, status string, reviewed_at int")
    assert {r.path: r.validation_status for r in M.validate(stored, reviews).collect()} == {"a": "approved", "b": "approved", "c": None, "d": None}


def test_progress_without_jobs(spark):
    row = M.queue_progress(spark.createDataFrame([], "state string, seconds double"), 2.0).first()
    assert (row.files_queued, row.files_total, row.progress_percentage, row.seconds_remaining) == (0, 0, 0.0, 0.0)


def test_delete_across_stores(spark):
    rows = spark.createDataFrame([("x", 1), ("y", 1), ("y", 2), ("z", 3)], "store string, id int")
    gone = spark.createDataFrame([(1,), (1,), (2,), (7,)], "id int")
    assert sorted((r.store, r.id) for r in I.delete_first(rows, gone).collect()) == [("y", 1), ("z", 3)]


def test_next_snapshot(spark):
    old = spark.createDataFrame([("a", 1.0, "x", [1]), ("b", 1.0, "x", [2]), ("c", 1.0, None, [3]), ("d", 1.0, "x", [4])], "path string, mtime double, content_hash string, chunk_ids array<int>")
    new = spark.createDataFrame([("a", 2.0, "x"), ("b", 2.0, "y"), ("c", 1.0, None), ("e", 1.0, "z")], "path string, mtime double, content_hash string")
    assert {r.path: (r.mtime, r.chunk_ids) for r in I.apply_changes(old, new).collect()} == {"a": (2.0, [1]), "b": (2.0, None), "c": (1.0, [3]), "e": (1.0, None)}


def test_shared_folder_is_named(spark):
    assert G.fresh_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, content string, project_id string")
    assert S.keyword_search(none, "a query", 3).count() == 0
    assert CH.sentences(none).count() == 0 and CH.line_prefix(none).count() == 0
    assert G.pagerank(edges(spark, "AB").limit(0)).count() == 0
