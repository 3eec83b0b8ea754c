"""Serving: envelopes, redaction, facets and one dispatcher for reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def envelope(df: DataFrame, order: list[str]) -> DataFrame:
    """One JSON document with the rows, in order, and their number. For pages, not tables."""
    items = F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order])))
    return df.agg(F.to_json(F.struct(F.count("*").alias("total"), items.alias("items")), {"ignoreNullFields": "false"}).alias("body"))


def redacted(json: Column, allowed: list[str]) -> Column:
    """The allowed keys of a flat JSON object, in the order given."""
    m = F.from_json(json, "map<string,string>")
    keep = F.array(*[F.lit(k) for k in allowed])
    return F.to_json(F.map_from_entries(F.transform(F.filter(keep, lambda k: F.array_contains(F.map_keys(m), k)), lambda k: F.struct(k, F.element_at(m, k)))))


def facets(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(facet, code, n) of several columns."""
    out = None
    for name, (df, column) in tables.items():
        part = df.groupBy(F.col(column).cast("string").alias("code")).agg(F.count("*").alias("n")).select(F.lit(name).alias("facet"), "code", "n")
        out = part if out is None else out.unionByName(part)
    return out


class Reads:
    """Named reads, each open from a rank on."""

    def __init__(self):
        self._reads: dict[str, tuple[int, Callable[..., DataFrame]]] = {}

    def add(self, name: str, rank: int, build: Callable[..., DataFrame]) -> None:
        self._reads[name] = (rank, build)

    def __call__(self, name: str, rank: int, **args) -> DataFrame:
        if name not in self._reads:
            raise KeyError(f"unknown read: {name}")
        least, build = self._reads[name]
        if rank < least:
            raise PermissionError(f"{name} needs rank {least}")
        return build(**args)
