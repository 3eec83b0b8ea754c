"""Snapshots: difference, upsert, supersession and digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _on(keys: list[str]) -> Column:
    """Keys are equal; nulls are a value."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    return out


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with state: new, removed, changed or unchanged (nulls equal nulls)."""
    values = [c for c in new.columns if c not in keys]
    o = old.select(*keys, F.struct(*values).alias("v")).alias("o")
    n = new.select(*keys, F.struct(*values).alias("v")).alias("n")
    state = F.when(F.col("o.v").isNull(), "new").when(F.col("n.v").isNull(), "removed").when(F.col("o.v").eqNullSafe(F.col("n.v")), "unchanged").otherwise("changed")
    return o.join(n, _on(keys), "full_outer").select(*[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys], state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], stamp: str | None = None, now: Column | None = None) -> DataFrame:
    """Rows of ``old`` and ``new``, new values winning.

    ``stamp``: a column of ``old`` that becomes ``now`` only where a value changed,
    so a replay changes nothing.
    """
    values = [c for c in new.columns if c not in keys]
    o, n = old.withColumn("__o", F.lit(True)).alias("o"), new.withColumn("__n", F.lit(True)).alias("n")
    there, given = F.col("o.__o").isNotNull(), F.col("n.__n").isNotNull()
    same = F.struct(*[F.col(f"o.{c}") for c in values]).eqNullSafe(F.struct(*[F.col(f"n.{c}") for c in values]))
    out = [F.when(given, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in [*keys, *values]]
    if stamp:
        out.append(F.when(given & ~(there & same), now).otherwise(F.col(f"o.{stamp}")).alias(stamp))
    return o.join(n, _on(keys), "full_outer").select(*out)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))


def supersede(observed: DataFrame, batch: DataFrame, key: str, snapshot: str) -> DataFrame:
    """Current rows of other snapshots end where ``batch`` has their key.

    Rows: key, value columns, snapshot column, valid_to, status. Any other
    snapshot is superseded, a later one too.
    """
    fresh = batch.groupBy(key).agg(F.max(snapshot).alias("__s"))
    ended = F.col("__s").isNotNull() & (F.col("status") == "current") & (F.col(snapshot) != F.col("__s"))
    kept = observed.join(fresh, key, "left").withColumn("valid_to", F.when(ended, F.col("__s")).otherwise(F.col("valid_to"))).withColumn("status", F.when(ended, "superseded").otherwise(F.col("status"))).drop("__s")
    return insert_absent(kept, batch.withColumns({"valid_to": F.lit(None).cast(dict(observed.dtypes)["valid_to"]), "status": F.lit("current")}), [key, snapshot])


def digest(df: DataFrame, columns: list[str], levels: tuple[int, ...] = (6, 3, 0)) -> DataFrame:
    """One hash of a table, whatever the order of its rows.

    Rows are hashed; the hashes that begin with the same 6 digits are joined in order
    and hashed, then those of 3, then all: with 10^12 rows no list has over 60,000.
    """
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)
    out = df.select(row.alias("b"), row.alias("d"), F.lit(1).cast("long").alias("n"))
    for digits in levels:
        lists = out.groupBy(F.substring("b", 1, digits).alias("b")).agg(F.array_sort(F.collect_list(F.struct("b", "d"))).alias("x"), F.sum("n").alias("n"))
        out = lists.select("b", F.sha2(F.array_join(F.transform("x", lambda x: x["d"]), ""), 256).alias("d"), "n")
    return out.select(F.col("d").alias("digest"), F.col("n").alias("n_rows"))
