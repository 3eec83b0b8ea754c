"""Pages and metrics that callers ask for: filters, facets, progress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import clamp, page


def anded(parts: list[Column | None]) -> Column:
    """All predicates that are asked for; None is not asked for."""
    return reduce(Column.__and__, [p for p in parts if p is not None], F.lit(True))


def asked(value, predicate) -> Column | None:
    """``predicate(value)``, or None where no value is given."""
    return None if value is None else predicate(value)


def contains_text(text: str | None, *columns: str) -> Column | None:
    """Whether the columns, joined by blanks, hold ``text``, whatever its case."""
    return asked(text, lambda q: F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(q.lower())))


def entity_page(rows: DataFrame, *, equal: dict | None = None, flags: dict | None = None, text: str | None = None, text_columns: tuple[str, ...] = (), least: dict | None = None, sort: str, key: str, descending: bool = False, limit: int | None = None, offset: int = 0, most: int = 200) -> DataFrame:
    """One page of entities and the ``total`` of those that pass.

    ``equal``: column to value or list of values; ``flags``: column to True or
    False; ``least``: column to lower bound. None in any of them is no filter.
    Ties in ``sort`` go to the smaller key, nulls come last.
    """
    parts = [asked(v, lambda v, c=c: F.col(c).isin(list(v)) if isinstance(v, (list, tuple)) else F.col(c) == v) for c, v in (equal or {}).items()]
    parts += [asked(v, lambda v, c=c: F.coalesce(F.col(c), F.lit(False)) == v) for c, v in (flags or {}).items()]
    parts += [asked(v, lambda v, c=c: F.col(c) >= v) for c, v in (least or {}).items()]
    found = rows.where(anded([*parts, contains_text(text, *text_columns)]))
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    top = page(found, [order, F.col(key)], clamp(limit, 50, 1, most), max(0, offset))
    return top.crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))  # one row


def progress(total: int, offset: int, done: int, batch: int, most: int = 500) -> dict:
    """The next offset of a batch protocol, whether more is left, and the share in per cent."""
    batch = clamp(batch, most, 1, most)
    after = min(offset + min(done, batch), total)
    return {"next_offset": after, "has_more": after < total, "percent": min(100, round(100 * after / total)) if total else 100}


def bounded_list(rows: DataFrame, keys: list[str], item: str, most: int = 500) -> DataFrame:
    """Items of each group, joined in order, where there are at most ``most``; else null, and their number.

    Groups are counted first, so no long list is ever collected.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    lists = rows.join(sizes.where(F.col("n") <= most).select(*keys), keys, "left_semi").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.col(item).cast("string"))), ",").alias("items"))
    return sizes.join(lists, keys, "left")


def dependent_facet(rows: DataFrame, parent: str, chosen, child: str, selected=None) -> DataFrame:
    """Codes of ``child`` under the chosen parent, each with its count and whether it is selected.

    A selection that isn't among them is stale and marks none.
    """
    under = rows if chosen is None else rows.where(F.col(parent) == chosen)
    return under.groupBy(F.col(child).alias("code")).agg(F.count("*").alias("n")).withColumn("selected", F.coalesce(F.col("code") == selected, F.lit(False)) if selected is not None else F.lit(False))


def residual(counts: list[Column], total: Column) -> Column:
    """What no count covers, at least 0."""
    return F.greatest(total - reduce(Column.__add__, counts), F.lit(0))
