"""Governed writes: validation, resolution in steps, snapshot apply and projection sync.

Each function returns what a write would leave, with counts or states beside it, so
the same plan serves a dry run and an apply, and a replay changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .snapshot import diff, supersede, upsert


def checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with ``errors``: the names of the rules that a row breaks, in their order."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return rows.withColumn("errors", F.filter(F.array(*broken), lambda x: x.isNotNull()))


def accepted(rows: DataFrame, batch: str | None = None) -> DataFrame:
    """The rows of a checked table whose batch has no broken row: a batch applies whole or not at all.

    ``batch``: the column that tells batches apart (a null is a batch too); by default
    all rows are one. What is joined back is a flag for each batch with a broken row.
    """
    broken = rows.where(F.size("errors") > 0)
    if batch is None:
        return rows.crossJoin(F.broadcast(broken.limit(1).agg(F.count("*").alias("__n")))).where("__n = 0").drop("errors", "__n")  # one row
    bad = broken.select(F.col(batch).alias("__b")).distinct()
    return rows.join(bad, F.col(batch).eqNullSafe(F.col("__b")), "left_anti").drop("errors")


def required(rows: DataFrame, key: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows joined to what they must find, and the keys that are missing there."""
    return rows.join(known, key), rows.join(known.select(key), key, "left_anti").select(key).distinct()


def by_provider(rows: DataFrame, providers: DataFrame, courses: DataFrame) -> DataFrame:
    """``rows`` with provider_id (by provider_code) and course_id (by course_code of that provider), and a state.

    The second step is keyed by the first one's result, so a code that two
    providers use leads to the right course.
    """
    first = rows.join(providers.select("provider_code", "provider_id"), "provider_code", "left")
    found = first.join(courses.select("provider_id", "course_code", "course_id"), ["provider_id", "course_code"], "left")
    state = F.when(F.col("provider_id").isNull(), "provider_missing").when(F.col("course_id").isNull(), "course_missing").otherwise("resolved")
    return found.withColumn("state", state)


def snapshot_plan(current: DataFrame, batch: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Counts by state of what applying ``batch`` over the current rows would do."""
    live = current.where("status = 'current'").select(key, *values)
    return diff(live, batch.select(key, *values), [key]).groupBy("state").agg(F.count("*").alias("n"))


def snapshot_apply(current: DataFrame, batch: DataFrame, key: str, at: str) -> DataFrame:
    """All rows after ``batch`` has superseded the current rows of its keys."""
    return supersede(current, batch, key, at)


def projection_sync(old: DataFrame, new: DataFrame, key: str, generation: int) -> DataFrame:
    """``new`` as the next generation: changed and new rows get its number, others keep
    theirs, vanished rows go. A replay of the same rows keeps every number.

    ``old``: key, content_hash, generation and more.
    """
    before = old.select(F.col(key), F.col("content_hash").alias("__hash"), F.col("generation").alias("__generation"))
    same = F.col("__hash").eqNullSafe(F.col("content_hash"))
    return new.join(before, key, "left").withColumn("generation", F.when(same & F.col("__generation").isNotNull(), F.col("__generation")).otherwise(F.lit(generation))).drop("__hash", "__generation")


def mapping_upsert(old: DataFrame, new: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Mappings after ``new``; verified_at moves only where a value changed."""
    return upsert(old, new, keys, "verified_at", now)


def touched(sources: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Sources after a run: ``results`` (key, ok, at, message) move one of the two times."""
    r = results.select(F.col(key), F.col("ok").alias("__ok"), F.col("at").alias("__at"), F.col("message").alias("__message"))
    ok = F.coalesce(F.col("__ok"), F.lit(False))
    failed = F.coalesce(~F.col("__ok"), F.lit(False))
    out = sources.join(r, key, "left").withColumns({"last_success": F.when(ok, F.col("__at")).otherwise(F.col("last_success")), "last_failure": F.when(failed, F.col("__at")).otherwise(F.col("last_failure")), "message": F.when(failed, F.col("__message")).when(ok, F.lit(None).cast("string")).otherwise(F.col("message"))})
    return out.drop("__ok", "__at", "__message")


def healthy() -> Column:
    """A source whose last success is not before its last failure."""
    return F.col("last_success").isNotNull() & (F.col("last_failure").isNull() | (F.col("last_success") >= F.col("last_failure")))


def merged_metadata(old: DataFrame, new: DataFrame, key: str, column: str = "metadata") -> DataFrame:
    """Get or create by ``key``: maps are merged, entries of ``new`` win."""
    n = new.select(F.col(key), F.col(column).alias("__new"))
    none = F.create_map().cast("map<string,string>")
    both = old.join(n, key, "full_outer")
    a, b = F.coalesce(F.col(column), none), F.coalesce(F.col("__new"), none)
    kept = F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k))
    return both.select(key, F.map_concat(kept, b).alias(column))
