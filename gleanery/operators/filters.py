"""Predicates that requests are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(df: DataFrame, **wanted) -> DataFrame:
    """Keep rows whose columns equal the values, or are among those of a list.

    None means no filter; the predicate is left out, so pushdown sees the rest.
    """
    parts = [F.col(c).isin(v) if isinstance(v, (list, tuple)) else F.col(c) == v for c, v in wanted.items() if v is not None]
    return df.where(reduce(Column.__and__, parts)) if parts else df


def overlaps(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """Whether an interval with open ends where null holds a date."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (end >= at))


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    return max(low, min(high, default if value is None else value))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page in a total order, which a top-k and not a full sort finds."""
    return df.orderBy(*order).limit(limit + offset).offset(offset) if offset else df.orderBy(*order).limit(limit)



def in_locale(names: Column, collation: str = "UNICODE") -> Column:
    """An array of texts in the order of a collation; texts that it holds equal are in binary order."""
    pairs = F.transform(names, lambda w: F.struct(F.collate(w, collation).alias("by"), w.alias("w")))
    return F.transform(F.array_sort(pairs), lambda p: p["w"])


def coordinates(members: dict[str, DataFrame], samples: int) -> DataFrame:
    """``sample``, ``address`` and a member of each dimension, for ``samples`` cells evenly over a cube.

    ``members``: one row each, with the ordered members as an array ``m``. The cells are numbered
    in mixed radix, the last dimension fastest, so a cell is found from its address and
    no product is made.
    """
    rows = None
    for name, df in members.items():
        one = F.broadcast(df.select(F.col("m").alias(name)))
        rows = one if rows is None else rows.crossJoin(one)  # one row each
    total = reduce(Column.__mul__, [F.size(n).cast("long") for n in members])
    cells = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))).alias("sample")).withColumn("address", F.floor(F.col("sample") * total / samples).cast("long"))
    rest, found = F.col("address"), {}
    for name in reversed(members):
        found[name] = F.get(name, F.pmod(rest, F.size(name)).cast("int"))
        rest = F.floor(rest / F.size(name))
    return cells.select("sample", "address", *[found[n].alias(n) for n in members])
