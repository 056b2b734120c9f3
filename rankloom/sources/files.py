"""File-like sources and sinks: source trees, conversation logs, the chunk store, JDBC, configuration."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators.chunking import message_text

#: What is read and what is left out unless the configuration says otherwise.
EXTENSIONS = (".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".kt", ".go", ".rb", ".c", ".h", ".cs", ".swift", ".m", ".md", ".sql", ".sh", ".yaml", ".json", ".jsonl")
IGNORED = ("__pycache__", ".git", "node_modules", "venv", ".idea", "*.pyc")
MOST_CHARS = 50_000


@dataclass
class Config:
    """Settings of one codebase; environment variables RANKLOOM_<NAME> win over the file."""

    name: str = "default"
    path: str = "."
    extensions: list[str] = field(default_factory=lambda: list(EXTENSIONS))
    ignore: list[str] = field(default_factory=lambda: list(IGNORED))
    watch_seconds: float = 5.0

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            values = json.load(f)
        for key in ("name", "path"):
            values[key] = os.environ.get(f"RANKLOOM_{key.upper()}", values.get(key, getattr(cls(), key)))
        return cls(**values)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=1)


def ignored(path: Column, patterns=IGNORED) -> Column:
    """**/x and x: a part of the path; *x: its end; /x: its first part.  Paths are relative."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    out = F.lit(False)
    for p in patterns:
        if p.startswith("**/"):
            out = out | F.array_contains(parts, p[3:])
        elif p.startswith("*"):
            out = out | path.endswith(p[1:])
        elif p.startswith("/"):
            out = out | (F.get(parts, F.lit(0)) == p[1:])
        else:
            out = out | F.array_contains(parts, p)
    return out


def wanted(path: Column, extensions=EXTENSIONS) -> Column:
    out = F.lit(False)
    for e in extensions:
        out = out | path.endswith(e if e.startswith(".") else f".{e}")
    return out


def scan(spark: SparkSession, config: Config) -> DataFrame:
    """path (relative), mtime, content, content_hash of a tree's files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(config.path)
    root = "^.*?" + os.path.abspath(config.path).rstrip("/").replace(".", r"\.") + "/"
    path = F.regexp_replace("path", root, "")
    content = F.decode("content", "UTF-8")
    rows = raw.withColumn("_p", path).where(wanted(F.col("_p"), config.extensions) & ~ignored(F.col("_p"), config.ignore))
    return rows.select(F.col("_p").alias("path"), F.col("modificationTime").cast("double").alias("mtime"), content.alias("content"), content_hash(content).alias("content_hash"))


def shown(content: Column, most: int = MOST_CHARS) -> Column:
    """A file's text for display, cut at a limit that is part of the feature."""
    return F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit("\n... (truncated)"))).otherwise(content)


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, turn, role, text, cwd of JSONL logs; lines that aren't JSON, and meta or progress lines, are skipped."""
    line = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("turn"), "value")
    one = F.from_json("value", "type string, isMeta boolean, cwd string, message struct<role:string,content:string>")
    rows = line.withColumn("j", one).where("j.type IN ('user', 'assistant') AND NOT coalesce(j.isMeta, false)")
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    return rows.select(stem.alias("conv_id"), "turn", F.col("j.type").alias("role"), message_text(F.col("j.message.content")).alias("text"), project_name(F.col("j.cwd")).alias("project"))


def project_name(cwd: Column) -> Column:
    """The last part of a path, whatever its separators."""
    return F.element_at(F.filter(F.split(cwd, r"[/\\]+"), lambda x: x != ""), -1)


class Store:
    """A table of chunks in a folder: appends are files of their own, and get() reads by id; compact() makes a snapshot."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def get(self, ids: list) -> DataFrame:
        return self.rows().where(F.col("id").isin(*ids))

    def replace(self, rows: DataFrame, at: str) -> Store:
        """The rows as the next snapshot, in a folder of its own; the old one stays until its readers are done."""
        rows.write.mode("error").parquet(at)
        return Store(self.spark, at)

    def delete(self, gone: DataFrame, at: str) -> Store:
        return self.replace(self.rows().join(gone.select("id").distinct(), "id", "left_anti"), at)

    def clear(self, at: str) -> Store:
        return self.replace(self.rows().limit(0), at)


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A relational table; retries are Spark's own."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def migrate(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
