"""Structured Streaming forms of the periodic jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.operators.snapshot import upsert


def incremental(spark: SparkSession, path: str, schema, files: int = 10) -> DataFrame:
    """New files of a folder, some at a time; the checkpoint holds the place."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def rolling_counts(events: DataFrame, late: str = "1 hour", size: str = "24 hours", slide: str | None = None) -> DataFrame:
    """Counts by type and window; rows later than ``late`` are dropped."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def once(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def upserting(stream: DataFrame, keys: list[str], order: str, path: str, checkpoint: str, read: Callable[[str], DataFrame | None]) -> StreamingQuery:
    """Fold a stream into a table of one row for each key.

    Each batch writes the generation named by its number, so a batch that is run
    again after a failure replaces what it wrote and applies nothing twice.
    ``read`` gives the table of the generation before, None at first.
    """

    def apply(batch: DataFrame, number: int) -> None:
        values = [c for c in batch.columns if c not in keys]
        latest = batch.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("v")).select(*keys, "v.*")
        old = read(f"{path}/generation={number - 1}") if number else None
        (upsert(old, latest, keys) if old is not None else latest).write.mode("overwrite").parquet(f"{path}/generation={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
