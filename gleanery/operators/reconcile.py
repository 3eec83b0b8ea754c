"""Identity: latest rows, resolution and unique matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def resolve(incoming: DataFrame, identifiers: DataFrame, stable: DataFrame) -> DataFrame:
    """``incoming`` (code, key, title, ord) with entity_id and outcome.

    Rows without code or title are conflicts. A code is looked up among the
    identifiers (code, id), then its key among stable keys (key, id); else the
    first row of a key creates it and later ones find it. The last title of a key wins.
    No key is sorted in one task: first and last of each are aggregated and joined
    back (``ord`` is unique), and conflicts, which share an empty key, aren't joined.
    """
    bad = F.col("code").isNull() | F.col("title").isNull()
    good, conflicts = incoming.where(~bad), incoming.where(bad)
    ends = good.groupBy("key").agg(F.min("ord").alias("first"), F.max_by("title", "ord").alias("last"))
    rows = good.join(ends, "key").join(identifiers.select("code", F.col("id").alias("by_code")), "code", "left").join(stable.select("key", F.col("id").alias("by_key")), "key", "left")
    known = F.coalesce("by_code", "by_key")
    outcome = F.when(F.col("by_code").isNotNull(), "existing_by_identifier").when(F.col("by_key").isNotNull() | (F.col("ord") > F.col("first")), "existing_by_stable_key").otherwise("created")
    resolved = rows.select("ord", "code", "key", F.col("last").alias("title"), F.coalesce(known.cast("string"), F.md5("key")).alias("entity_id"), outcome.alias("outcome"))
    none = F.lit(None).cast("string")
    return resolved.unionByName(conflicts.select("ord", "code", "key", none.alias("title"), none.alias("entity_id"), F.lit("conflict").alias("outcome")))


def unique_match(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """label with id and state: matched where all its forms lead to one id."""
    hits = labels.join(aliases, "form").groupBy("label").agg(F.countDistinct("id").alias("m"), F.min("id").alias("id"))
    state = F.when(F.col("m").isNull(), "unmatched").when(F.col("m") == 1, "matched").otherwise("ambiguous")
    return labels.select("label").distinct().join(hits, "label", "left").select("label", F.when(F.col("m") == 1, F.col("id")).alias("id"), state.alias("state"))


def by_code(rows: DataFrame, known: DataFrame, form: str) -> DataFrame:
    """One row for each code: its first title, how often it came, the outcome and the id that it has or gets.

    A code (null too) that is not of the ``form`` is a conflict and gets no id. ``known``: code, id.
    """
    codes = rows.groupBy("code").agg(F.min("title").alias("title"), F.count("*").alias("n")).join(known, "code", "left")
    bad = ~F.coalesce(F.regexp_like("code", F.lit(form)), F.lit(False))
    outcome = F.when(bad, "conflict").when(F.col("id").isNotNull(), "existing").otherwise("created")
    made = F.when(~bad, F.coalesce(F.col("id").cast("string"), F.md5(F.concat(F.lit("provider:"), "code"))))
    return codes.select("code", "title", "n", outcome.alias("outcome"), made.alias("provider_id"))
