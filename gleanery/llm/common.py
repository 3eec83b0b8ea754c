"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.session import table  # noqa: F401

#: ASCII bytes that are not letters or digits become blanks, A-Z become a-z,
#: bytes of other characters stay: ``data.translate(FOLD).split()`` are words.
FOLD = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20
    for b in range(256)
)


def words(data: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text; none for null."""
    return data.translate(FOLD).split() if data else []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir.

    Where that is unset and Spark runs on one machine, as in tests, a temporary
    folder is set once for the session and used from then on. On a cluster it must
    be set: executors don't see the driver's own folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gleanery-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    It cuts the lineage: a lost executor costs a read of this table, not the
    work before it.
    """
    path = f"{shared_dir(df.sparkSession)}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array, rows: int = 512) -> Iterator[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes, nulls as None; copied ``rows`` at once.

    What Arrow holds of batches before is given back to the system: a worker lives
    longer than its task and would keep it.
    """
    pa.default_memory_pool().release_unused()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for start in range(0, len(column), rows):
        yield from column.slice(start, rows).cast(kind).to_pylist()
    pa.default_memory_pool().release_unused()


def slices(batches: Iterator[pa.RecordBatch], text: int, bytes_each: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts (column ``text``) have about ``bytes_each`` bytes, or one row."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(size):
            stop = int(np.searchsorted(size, (size[start - 1] if start else 0) + bytes_each, side="right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def free(columns: list[str], name: str) -> str:
    """``name``, or with underscores before it one that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quantiles(df: DataFrame, key: str, parts: int) -> np.ndarray:
    """Values of a numeric column that cut its rows into about ``parts`` equal parts, ascending.

    A sketch of bounded size; nulls don't count, and without values there are no cuts.
    """
    shares = [i / parts for i in range(1, parts)]
    cuts = df.agg(F.percentile_approx(key, shares, 20 * parts).alias("cuts")).first()["cuts"] if shares else None
    return np.unique(np.array(cuts or [], np.int64))


def part_of(cuts: np.ndarray, key: Column) -> Column:
    """The number of cuts at or below a value: rows of equal values share a part; null is part -1."""

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        found = np.searchsorted(cuts, values.fillna(0).to_numpy(np.int64), side="right")
        return pd.Series(np.where(values.isna(), -1, found).astype(np.int32))

    return place(key)
