"""Directed graphs as tables of edges (src, dst): centrality, reachability, paths, cycles, statistics.

Walks are frontiers: each round joins the frontier with the edges and drops what was seen, so that a node is expanded
once.  Rounds are cut off by checkpoints in the session's folder, which survive the loss of executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAMPING, ROUNDS = 0.85, 100
#: Rounds after which the nodes seen, a table for each round, are written as one.
GATHER = 16


def fresh_folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names for checkpoints; in local mode one beside the warehouse will do."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/rankloom/table-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows written and read again, which ends their lineage."""
    path = fresh_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops; targets needn't be known."""
    return edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src != dst").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def in_degree(edges: DataFrame) -> DataFrame:
    """node, degree of every node."""
    return nodes(edges).join(edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("degree")), "node", "left").fillna(0, ["degree"])


def pagerank(edges: DataFrame, rounds: int = ROUNDS, tolerance: float = 1e-6) -> DataFrame:
    """node, rank; dangling nodes spread evenly; uniform if it doesn't settle within the rounds."""
    e = cut(edges.join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("out")), "src"))
    every = cut(nodes(edges))
    n = every.count()
    if not n:
        return every.withColumn("rank", F.lit(0.0))
    sources = e.select(F.col("src").alias("node")).distinct()
    rank = cut(every.withColumn("rank", F.lit(1.0 / n)))
    for _ in range(rounds):
        dangling = rank.join(sources, "node", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("d")).first()["d"]
        sent = e.join(rank, e["src"] == rank["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("in"))
        step = rank.join(sent, "node", "left").select("node", F.col("rank").alias("old"), (F.lit((1 - DAMPING) / n + DAMPING * dangling / n) + DAMPING * F.coalesce("in", F.lit(0.0))).alias("rank"))
        step = cut(step)
        moved = step.agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("m")).first()["m"]
        rank = step.select("node", "rank")
        if moved < n * tolerance:
            return rank
    return every.withColumn("rank", F.lit(1.0 / n))


def centrality(edges: DataFrame) -> DataFrame:
    """node, score: .6 PageRank + .4 in-degree, each over its maximum."""
    r, d = pagerank(edges), in_degree(edges)
    top = d.agg(F.max("degree").alias("d")).first()["d"] or 1
    most = r.agg(F.max("rank").alias("r")).first()["r"] or 1.0
    return r.join(d, "node").select("node", (0.6 * F.col("rank") / most + 0.4 * F.col("degree") / top).alias("score"))


def reach(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """node, depth: what start nodes (node) reach, themselves left out, with the least number of steps."""
    seen = cut(start.select("node", F.lit(0).alias("depth")).distinct())
    frontier, d = seen, 0
    while depth is None or d < depth:
        d += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def reversed_(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def shortest_path(edges: DataFrame, a, b, most: int | None = None) -> DataFrame:
    """path: one shortest path from a to b, the smallest of them in order of its nodes; no row if there is none, or none
    of up to ``most`` steps."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    front = spark.range(1).select(F.lit(a).cast(kind).alias("node"), F.array(F.lit(a).cast(kind)).alias("path"))
    seen, rounds = front.select("node"), 0
    while front.limit(1).count():
        found = front.where(F.col("node") == b)
        if found.limit(1).count():
            return found.select("path").orderBy("path").limit(1)
        if rounds == most:
            break
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        front = cut(step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        seen, rounds = seen.unionByName(front.select("node")), rounds + 1
        if rounds % GATHER == 0:
            seen = cut(seen)
    return spark.createDataFrame([], f"path array<{kind}>")


def simple_paths(edges: DataFrame, a, depth: int) -> DataFrame:
    """path: every simple path from a with 1 to depth steps; bounded by depth, not by the graph."""
    kind = edges.schema["src"].dataType.simpleString()
    front = edges.sparkSession.range(1).select(F.array(F.lit(a).cast(kind)).alias("path"))
    out = None
    for _ in range(depth):
        front = front.join(edges, F.element_at(front["path"], -1) == edges["src"]).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        out = front if out is None else out.unionByName(front)
    return out


def call_chain(edges: DataFrame, a, b, depth: int = 10) -> DataFrame:
    """path: a chain of calls from a to b within depth steps, the shortest one (of these the smallest in order of its nodes).

    Any simple path would do; the shortest is found without going through all of them."""
    return shortest_path(edges, a, b, depth)


def has_cycle(edges: DataFrame) -> bool:
    """Peels off nodes that nothing leads to, or that lead nowhere, until none or a cycle is left."""
    left = cut(edges)
    while True:
        n = left.count()
        if not n:
            return False
        left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if left.count() == n:
            return True


def cycles(edges: DataFrame, most: int) -> DataFrame:
    """cycle: each simple cycle of up to most nodes once, with its smallest node first."""
    front = edges.where("src < dst").select(F.array("src", "dst").alias("path"))
    out = None
    for k in range(2, most + 1):
        last, first = F.element_at(front["path"], -1), F.element_at(front["path"], 1)
        closed = front.join(edges, (last == edges["src"]) & (first == edges["dst"])).select(F.col("path").alias("cycle"))
        out = closed if out is None else out.unionByName(closed)
        if k < most:
            front = front.join(edges, (last == edges["src"]) & (edges["dst"] > first)).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
    return out


def call_depth(edges: DataFrame, node) -> DataFrame:
    kind = edges.schema["src"].dataType.simpleString()
    start = edges.sparkSession.range(1).select(F.lit(node).cast(kind).alias("node"))
    return reach(edges, start).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("call_depth"))


def stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, nodes with callers, nodes with callees."""
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("dst").alias("with_callers"), F.count_distinct("src").alias("with_callees"))
    n = nodes(edges).agg(F.count(F.lit(1)).alias("n_nodes")).first()["n_nodes"]
    return e.select(F.lit(n).cast("long").alias("n_nodes"), "n_edges", "with_callers", "with_callees")


def relations(edges: DataFrame) -> DataFrame:
    """node, n_callers, n_callees of every node."""
    both = edges.select(F.col("dst").alias("node"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(edges.select(F.col("src").alias("node"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy("node").agg(F.sum("a").alias("n_callers"), F.sum("b").alias("n_callees"))


def find(names: DataFrame, pattern: str, case: bool = False) -> DataFrame:
    """Names that hold the pattern, or match it whole where it has * or ?."""
    from .incremental import glob

    c, p = (F.col("name"), pattern) if case else (F.lower("name"), pattern.lower())
    return names.where(c.rlike(glob(p)) if set("*?") & set(p) else F.contains(c, F.lit(p))).orderBy("name")


def contain(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """methods (path, name, line) with the class (path, class, first, last) whose lines hold them; the first one by its start."""
    m = methods.join(classes, "path", "left").withColumn("_in", F.col("line").between(F.col("first"), F.col("last")))
    best = F.min(F.when(F.col("_in"), F.struct("first", "class")))
    return m.groupBy("path", "name", "line").agg(best["class"].alias("class"))


def resolve_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """src, dst: imports (src, module) resolved to files (path, module, pos): the same module, else its nearest parent or a
    child, else the file with its last part as stem; of several the first by position."""
    f = files.select(F.col("path").alias("dst"), F.col("module").alias("m"), "pos", F.substring_index("module", ".", -1).alias("stem"))
    i = imports.select("src", "module").distinct()
    parts = F.split("module", r"\.")
    up = i.select("src", "module", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("m"))
    same = i.withColumn("m", F.col("module")).join(f, "m").select("src", "module", "dst", F.lit(0).alias("stage"), "pos")
    parent = up.where("m != module").join(f, "m").select("src", "module", "dst", F.lit(1).alias("stage"), "pos")
    down = f.select("dst", "pos", F.split("m", r"\.").alias("p")).select("dst", "pos", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", F.lit(1), n), "."))).alias("module"), F.array_join("p", ".").alias("full")).where("module != full")
    child = i.join(down, "module").select("src", "module", "dst", F.lit(1).alias("stage"), "pos")
    stem = i.withColumn("stem", F.substring_index("module", ".", -1)).join(f, "stem").select("src", "module", "dst", F.lit(2).alias("stage"), "pos")
    best = same.unionByName(parent).unionByName(child).unionByName(stem).groupBy("src", "module").agg(F.min_by("dst", F.struct("stage", "pos")).alias("dst"))
    return best.where("src != dst").select("src", "dst").distinct()


def export_json(edges: DataFrame) -> DataFrame:
    """One JSON text per node with its targets in order: lines that make up a node-link file."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("links")).select(F.to_json(F.struct("id", "links")).alias("json"))


def export_xml(edges: DataFrame) -> DataFrame:
    """GraphML lines of edges; header and footer are the caller's."""
    return edges.select(F.format_string('<edge source="%s" target="%s"/>', F.col("src").cast("string"), F.col("dst").cast("string")).alias("line"))
