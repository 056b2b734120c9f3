"""Watching: a stream of file versions keeps a snapshot up to date, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def apply_batch(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """The next snapshot: each path's last version by (mtime, content_hash), without deleted ones (null hash)."""
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("mtime"), F.desc("content_hash")))
    both = snapshot.select("path", "mtime", "content_hash").unionByName(batch.select("path", "mtime", "content_hash"))
    return both.withColumn("_n", last).where("_n = 1").drop("_n")


def watch(spark: SparkSession, source: str, schema, target: str, checkpoint: str, seconds: float = 5.0, once: bool = False):
    """Starts a query that folds versions (path, mtime, content_hash) from new files of a folder into target/<batch>."""
    versions = spark.readStream.schema(schema).parquet(source)

    def step(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        old = s.read.parquet(f"{target}/{number - 1}") if number else s.createDataFrame([], schema)
        # A batch that runs again after a failure writes the same snapshot over its first try.
        apply_batch(old, batch).write.mode("overwrite").parquet(f"{target}/{number}")

    writer = versions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and type; works on a stream (with a watermark) and on a table alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
