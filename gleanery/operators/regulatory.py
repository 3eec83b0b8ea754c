"""Regulatory facts of courses applied by snapshot: observations and fees, counted, superseded, upserted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import exprs

#: Fee columns of a record, and what a fee is called.
FEES = {"tuition_raw": "tuition", "non_tuition_raw": "non_tuition", "total_raw": "estimated_total_course_cost"}
NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"


def parsed(records: DataFrame) -> DataFrame:
    """Records with clean codes, typed facts and the hash of the facts; of a course's rows that of the largest ``ord``."""
    code = lambda c: F.upper(exprs.clean(F.col(c)))
    rows = records.withColumns({"provider_code": code("provider_code"), "course_code": code("course_code"), "language": exprs.clean(F.col("language"))})
    last = rows.groupBy("provider_code", "course_code").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("provider_code", "course_code")]), "ord").alias("r")).select("provider_code", "course_code", "r.*")
    typed = last.withColumns({"dual": exprs.tri_state(F.col("dual_raw")), "hours": exprs.plain_number(exprs.clean(F.col("hours_raw")))})
    return typed.withColumn("fact_hash", exprs.content_hash("dual", "hours", "language"))


def matched(rows: DataFrame, courses: DataFrame) -> DataFrame:
    """``rows`` with ``course_id`` by provider and course code; null where there is no such course."""
    return rows.join(courses.select("provider_code", "course_code", "course_id"), ["provider_code", "course_code"], "left")


def fee_grid(rows: DataFrame, scheme: str, at: str) -> DataFrame:
    """A row for each matched course and kind of fee, with the amount where the raw value is one, and the fee's key."""
    long = rows.where("course_id is not null").select("course_id", "course_code", *[F.col(c).alias(n) for c, n in FEES.items()]).unpivot(["course_id", "course_code"], list(FEES.values()), "fee_type", "raw")
    plain = F.regexp_replace(exprs.clean(F.col("raw")), "[^0-9.-]", "")
    amount = F.when(F.regexp_like(plain, F.lit(NUMBER)), plain.try_cast("decimal(18,2)"))
    return long.select("course_id", "fee_type", exprs.clean(F.col("raw")).alias("raw"), amount.alias("amount"), F.concat_ws(":", F.lit(scheme), F.lower("course_code"), "fee_type", F.lit(at)).alias("source_fee_key"))


def _state(known: str, differs: Column) -> Column:
    return F.when(F.col(known).isNull(), "created").when(differs, "updated").otherwise("unchanged")


def counted(rows: DataFrame, grid: DataFrame, observed: DataFrame, fees: DataFrame, at: str) -> DataFrame:
    """``kind``, ``outcome``, ``n``: what applying the snapshot ``at`` would do; nothing is written.

    ``observed``: course_id, snapshot_at, content_hash, status. ``fees``: course_id, fee_type,
    source_fee_key, amount, snapshot_at, status.
    """
    now = F.lit(at).cast("date")
    here = rows.where("course_id is not null")
    same = observed.where(F.col("snapshot_at") == now).select("course_id", F.col("content_hash").alias("__h"), F.col("status").alias("__s"))
    facts = here.join(same, "course_id", "left").select(F.lit("fact").alias("kind"), _state("__s", ~F.col("__h").eqNullSafe(F.col("fact_hash")) | (F.col("__s") != "current")).alias("outcome"))
    old = observed.where((F.col("snapshot_at") != now) & (F.col("status") == "current")).join(here.select("course_id"), "course_id", "left_semi").select(F.lit("fact").alias("kind"), F.lit("superseded").alias("outcome"))
    valid = grid.where("amount is not null")
    kept = fees.select("course_id", "source_fee_key", F.col("amount").alias("__a"), F.col("status").alias("__s"))
    fee = valid.join(kept, ["course_id", "source_fee_key"], "left").select(F.lit("fee").alias("kind"), _state("__s", ~F.col("__a").eqNullSafe(F.col("amount")) | (F.col("__s") != "active")).alias("outcome"))
    gone = _outdated(fees, now).join(grid.select("course_id", "fee_type"), ["course_id", "fee_type"], "left_semi").select(F.lit("fee").alias("kind"), F.lit("superseded").alias("outcome"))
    invalid = lambda raw, value: exprs.clean(F.col(raw)).isNotNull() & F.col(value).isNull()
    checks = {"course_missing": F.col("course_id").isNull(), "invalid_boolean": invalid("dual_raw", "dual"), "invalid_number": invalid("hours_raw", "hours")}
    bad = rows.select(F.lit("record").alias("kind"), F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())).alias("outcome"))
    wrong = grid.where("raw is not null and amount is null").select(F.lit("fee").alias("kind"), F.lit("invalid").alias("outcome"))
    out = facts
    for part in (old, fee, gone, bad, wrong):
        out = out.unionByName(part)
    return out.groupBy("kind", "outcome").agg(F.count("*").alias("n"))


def _outdated(fees: DataFrame, now: Column) -> DataFrame:
    return fees.where((F.col("status") == "active") & ~F.col("snapshot_at").eqNullSafe(now))


def observed_after(rows: DataFrame, observed: DataFrame, at: str) -> DataFrame:
    """Observations once the snapshot is applied: those of any other snapshot end, its own are replaced."""
    now = F.lit(at).cast("date")
    fresh = rows.where("course_id is not null").select("course_id", now.alias("snapshot_at"), F.col("fact_hash").alias("content_hash"), F.lit("current").alias("status"), F.lit(None).cast("date").alias("valid_to"))
    old = observed.join(fresh.select("course_id", F.lit(True).alias("__there")), "course_id", "left").where(F.col("__there").isNull() | (F.col("snapshot_at") != now))
    ends = F.col("__there").isNotNull() & (F.col("status") == "current")
    ended = old.withColumns({"valid_to": F.when(ends, now).otherwise(F.col("valid_to")), "status": F.when(ends, "superseded").otherwise(F.col("status"))})
    return ended.select(*fresh.columns).unionByName(fresh)


def fees_after(grid: DataFrame, fees: DataFrame, at: str) -> DataFrame:
    """Fees once the snapshot is applied: an active fee of another snapshot ends where the
    snapshot speaks of that kind of fee, also without a valid amount; valid ones are upserted by key."""
    now = F.lit(at).cast("date")
    fresh = grid.where("amount is not null").select("course_id", "fee_type", "source_fee_key", "amount", now.alias("snapshot_at"), F.lit("active").alias("status"), F.lit(None).cast("date").alias("valid_to"))
    old = fees.join(fresh.select("course_id", "source_fee_key"), ["course_id", "source_fee_key"], "left_anti")
    old = old.join(grid.select("course_id", "fee_type", F.lit(True).alias("__there")), ["course_id", "fee_type"], "left")
    ends = F.col("__there").isNotNull() & (F.col("status") == "active") & ~F.col("snapshot_at").eqNullSafe(now)
    ended = old.withColumns({"valid_to": F.when(ends, now).otherwise(F.col("valid_to")), "status": F.when(ends, "superseded").otherwise(F.col("status"))})
    return ended.select(*fresh.columns).unionByName(fresh)
