"""Aggregates that follow a table's changes: each batch adds its rows and takes back what they replace."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.sources.generations import Generations


class MaintainedView:
    """Counts and sums by group of a table that changes by key.

    A batch holds the keys with their groups and values, an order, and whether the row is
    deleted. The latest row of each key is appended to a log of rows; the rows that it
    replaces are looked up for the keys of the batch alone and count with a minus. So a
    batch costs what it touches, and the groups, but no rewrite of the rows; every
    ``compact`` batches the log becomes one folder again. The manifest names the folders
    of a state, so readers see a batch whole or not at all, and one that is run again
    after it was committed is left out.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], groups: list[str], sums: dict[str, str], order: str, deleted: str = "deleted", compact: int = 10):
        self.spark, self.path = spark, path.rstrip("/")
        self.keys, self.groups, self.sums, self.order, self.deleted, self.compact = keys, groups, sums, order, deleted, compact
        self.states = Generations(spark, path, keys[0])

    def _latest(self, rows: DataFrame, by: str) -> DataFrame:
        rest = [*self.groups, *self.sums, self.deleted]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), by).alias("__v"), F.max(by).alias("__n")).select(*self.keys, "__v.*", "__n")

    def _read(self, folders: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{f}") for f in folders])

    def _write(self, df: DataFrame, kind: str) -> str:
        folder = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def _summed(self, rows: DataFrame, sign: str | None = None) -> DataFrame:
        s = F.col(sign) if sign else F.lit(1)
        totals = [F.coalesce(F.sum(s * F.col(c).cast(kind)), F.lit(0)).cast(kind).alias(c) for c, kind in self.sums.items()]
        return rows.groupBy(*self.groups).agg(F.sum(s).cast("long").alias("n"), *totals)

    def apply(self, batch: DataFrame, number: int) -> None:
        """Fold batch ``number`` into the view."""
        began, state = time.time(), self.states.manifest()
        if state and state["batch"] >= number:
            return
        latest = self._latest(batch, self.order).drop("__n").withColumn("__n", F.lit(number).cast("long"))
        folder = self._write(latest, "rows")
        fresh = self._read([folder])
        signed = fresh.where(~F.col(self.deleted)).withColumn("__sign", F.lit(1))
        if state:
            same = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys])
            touched = self._read(state["rows"]).alias("o").join(fresh.select(*self.keys).alias("n"), same, "left_semi")
            signed = signed.unionByName(self._latest(touched, "__n").where(~F.col(self.deleted)).withColumn("__sign", F.lit(-1)))
        delta = self._summed(signed, "__sign")
        if state:
            delta = self.spark.read.parquet(f"{self.path}/{state['groups']}").unionByName(delta)
            delta = delta.groupBy(*self.groups).agg(F.sum("n").cast("long").alias("n"), *[F.sum(c).cast(kind).alias(c) for c, kind in self.sums.items()]).where("n <> 0")
        groups = self._write(delta, "groups")
        folders = [*(state["rows"] if state else []), folder]
        if len(folders) > self.compact:
            folders = [self._write(self._latest(self._read(folders), "__n").where(~F.col(self.deleted)), "rows")]
        now = time.time()
        self.states._commit({"generation": state["generation"] + 1 if state else 1, "batch": number, "rows": folders, "groups": groups, "refreshed_at": now, "seconds": round(now - began, 3)})

    def live(self) -> DataFrame:
        """The aggregates computed anew from the latest rows."""
        state = self.states.manifest()
        return self._summed(self._latest(self._read(state["rows"]), "__n").where(~F.col(self.deleted)))

    def read(self, max_age: float | None = None) -> DataFrame:
        """The aggregates with ``mode``, ``refreshed_at`` and ``seconds`` (what the refresh took).

        Where the view is older than ``max_age`` seconds they are computed live.
        """
        state = self.states.manifest()
        stale = max_age is not None and time.time() - state["refreshed_at"] > max_age
        rows = self.live() if stale else self.spark.read.parquet(f"{self.path}/{state['groups']}")
        return rows.withColumns({"mode": F.lit("live" if stale else "snapshot"), "refreshed_at": F.timestamp_seconds(F.lit(state["refreshed_at"])), "seconds": F.lit(state["seconds"])})

    def following(self, changes: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Keep the view up with a stream of changes: all there are, or on a timer."""
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()
