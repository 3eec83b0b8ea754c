"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

CANDIDATES = T.StructType([T.StructField("key", T.LongType()), T.StructField("word_place", T.LongType()), T.StructField("vector_place", T.LongType()), T.StructField("score", T.DoubleType())])


class Candidates:
    """Fuses the ranked lists of one request: rows of ``key``, ``branch`` ("words" or "vectors") and ``place``.

    The lists are as long as the branches hand on, 2,000 rows each at most, whatever
    the tables; requests are told apart by PARTITION BY.
    """

    def __init__(self):
        self.places: dict[int, list[int | None]] = {}
        self.limit = 20

    def eval(self, row: T.Row, limit: int) -> None:
        self.limit = limit
        self.places.setdefault(row["key"], [None, None])[row["branch"] == "vectors"] = row["place"]

    def terminate(self) -> Iterator[tuple]:
        part = lambda weight, place: weight / (60 + place) if place is not None else 0.0
        fused = [(key, w, v, round(part(1.0, w) + part(0.55, v), 9)) for key, (w, v) in self.places.items()]
        yield from sorted(fused, key=lambda r: (-r[3], r[0]))[: self.limit]


def register(spark: SparkSession) -> None:
    """Make ``candidates`` known to SQL: SELECT * FROM candidates(TABLE(lists) PARTITION BY (request), 20)."""
    spark.udtf.register("candidates", udtf(Candidates, returnType=CANDIDATES))
