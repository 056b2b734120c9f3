"""What the operators need of a session: the shared folder, bounded Arrow batches, written tables."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are cut at so many bytes, since rows can be long.
ARROW_BYTES = str(16 << 20)


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the bytes of an Arrow batch, where Spark has that setting."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def give_back() -> None:
    """Returns to the system what this process has freed and its allocators keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mapped(df: DataFrame, run, kinds) -> DataFrame:
    """mapInArrow, after which a Python worker gives its freed memory back.

    Workers stay for the tasks of later stages, and all that the allocators of each keep is memory of its executor."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, kinds)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; where none is set (tests), one beside the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/rankloom/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again.  It cuts the lineage: whatever executor is lost
    later, the rows are read and not made anew."""
    spark = df.sparkSession
    path = fresh_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(name: str, taken) -> str:
    """A column name that isn't taken."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """Spark's own number of shuffle partitions, which the cluster sizes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with more rows than this is salted; more than MOST_HOT keys never are, so that their table can be broadcast.
HOT, MOST_HOT = 2000, 100_000


class Hot:
    """The keys of some rows that have many of them, and into how many salts each is split.

    A hot key has more than max(HOT, rows / MOST_HOT) rows, so there are at most MOST_HOT such keys: a bounded broadcast.
    ``n`` names a column with the number of rows of each key, where it is known; else the rows are counted."""

    def __init__(self, rows: DataFrame, key: str, n: str | None = None):
        self.key = key
        total = rows.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0] if n else rows.count()
        bar = max(HOT, total // MOST_HOT)
        self.none = total <= bar
        if self.none:
            return
        counts = rows.select(key, F.col(n).alias("_n")) if n else count_by(rows.select(key), key)
        big = counts.where((F.col("_n") > bar) & F.col(key).isNotNull()).select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / bar).cast("int").alias("_salts"))
        self.big = written(big, "hot")
        self.none = not self.big.limit(1).count()

    def _with(self, rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(self.big), F.col(self.key) == F.col("_hot"), "left").drop("_hot")

    def split(self, rows: DataFrame, by: str) -> DataFrame:
        """The many rows of a key, with a ``_salt`` from another column."""
        if self.none:
            return rows.withColumn("_salt", F.lit(0))
        return self._with(rows).withColumn("_salt", F.pmod(F.hash(by), F.coalesce("_salts", F.lit(1)))).drop("_salts")

    def spread(self, rows: DataFrame) -> DataFrame:
        """The one row of a key, once for each of its salts."""
        if self.none:
            return rows.withColumn("_salt", F.lit(0))
        return self._with(rows).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")

    def join(self, many: DataFrame, one: DataFrame, by: str, how: str = "inner") -> DataFrame:
        return self.split(many, by).join(self.spread(one), [self.key, "_salt"], how).drop("_salt")


def count_by(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))


def row_key(doc_id, text):
    """A 64-bit key of a row by its id and text: rows that are equal in both are one document."""
    return F.xxhash64(doc_id, text)
