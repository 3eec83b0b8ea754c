"""Sinks: published snapshots and content-addressed evidence."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.snapshot import diff, insert_absent
from gleanery.session import scratch


def publish(df: DataFrame, path: str, generation: int, partition: list[str] | None = None) -> str:
    """Write a generation of a table; readers go on with the last until told of this one."""
    target = f"{path}/generation={generation}"
    df.write.mode("errorifexists").partitionBy(*(partition or [])).parquet(target)
    return target


def plan(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by state of what publishing ``new`` would do; nothing is written."""
    return diff(old, new, keys).groupBy("state").agg(F.count("*").alias("n"))


def stage(known: DataFrame, records: DataFrame, source: str, record: str, payload: list[str]) -> DataFrame:
    """Records by source, id and content hash; those known are not staged again."""
    hashed = records.withColumn("content_hash", F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256))
    return insert_absent(known, hashed, [source, record, "content_hash"])


@contextmanager
def stage_table(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` computed once, as a table and as the view ``name`` while the block runs; dropped after it, also when it fails.

    The rows are written to the shared folder, so a lost executor costs a read.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    try:
        df.write.parquet(path)
        table = spark.read.schema(df.schema).parquet(path)
        table.createOrReplaceTempView(name)
        yield table
    finally:
        spark.catalog.dropTempView(name)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
