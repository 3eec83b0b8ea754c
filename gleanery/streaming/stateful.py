"""Streams with states of their own: staged records that wait for processing, merged providers.

Both need a state store with column families: set ``spark.sql.streaming.stateStore.providerClass``
to ``ROCKSDB`` below before the query starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

STAGED = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "record", "content_hash", "status")] + [T.StructField("ms", T.LongType())])
MERGED = T.StructType([T.StructField("code", T.StringType()), T.StructField("name", T.StringType()), T.StructField("cities", T.ArrayType(T.StringType())), T.StructField("campuses", T.ArrayType(T.StringType())), T.StructField("rows", T.LongType())])


class Staging(StatefulProcessor):
    """A record of a source: pending once its content is new, processed once that is told, stale if it is not in time."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kind = T.StructType([T.StructField("content_hash", T.StringType()), T.StructField("status", T.StringType()), T.StructField("due", T.LongType())])
        self.known = handle.getValueState("known", kind)

    def _leave(self, key: tuple, content_hash: str, status: str, ms: int, due: int | None = None) -> Row:
        self.known.update((content_hash, status, due))
        return Row(source=key[0], record=key[1], content_hash=content_hash, status=status, ms=ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: (r["ms"], r["kind"] == "processed", r["content_hash"] or "")):
            content_hash, status, due = self.known.get() if self.known.exists() else (None, None, None)
            if row["kind"] == "staged" and row["content_hash"] != content_hash:
                if due is not None:
                    self.handle.deleteTimer(due)
                due = row["ms"] + self.patience
                self.handle.registerTimer(due)
                yield self._leave(key, row["content_hash"], "pending", row["ms"], due)
            elif row["kind"] == "processed" and row["content_hash"] == content_hash and status != "processed":
                if due is not None:
                    self.handle.deleteTimer(due)
                yield self._leave(key, content_hash, "processed", row["ms"])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        content_hash, status, due = self.known.get() if self.known.exists() else (None, None, None)
        if status == "pending" and due == expiredTimerInfo.getExpiryTimeInMs():
            yield self._leave(key, content_hash, "stale", due)

    def close(self) -> None:
        pass


def staging(events: DataFrame, patience: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """The changes of state of records: ``source``, ``record``, ``content_hash``, ``status``, ``at``.

    ``events``: a stream of ``source``, ``record``, ``kind`` (staged or processed),
    ``content_hash`` and ``at``. Content that is known is not pending again; a record that
    stays pending for ``patience`` of event time becomes stale, and may still be processed;
    events later than ``late`` are dropped. A record holds one row of state.
    """
    timed = events.withWatermark("at", late).select("source", "record", "kind", "content_hash", "at", F.unix_millis("at").alias("ms"))
    out = timed.groupBy("source", "record").transformWithState(Staging(pd.Timedelta(patience) // pd.Timedelta("1ms")), STAGED, "Append", "EventTime")
    return out.select("source", "record", "content_hash", "status", F.timestamp_millis("ms").alias("at"))


class Merging(StatefulProcessor):
    """A provider of many rows: the latest name, and sets of cities and campuses.

    The sets are map states, so a row reads and writes its own entries and not all of them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        one = lambda n, kind=None: T.StructType([T.StructField(n, kind or T.StringType())])
        self.head = handle.getValueState("head", T.StructType([T.StructField("name", T.StringType()), T.StructField("ms", T.LongType()), T.StructField("rows", T.LongType())]))
        self.cities, self.campuses = (handle.getMapState(n, one("value"), one("seen", T.BooleanType())) for n in ("cities", "campuses"))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        name, ms, n = self.head.get() if self.head.exists() else (None, None, 0)
        for row in rows:
            n += 1
            if row["name"] is not None and (ms is None or (row["ms"], row["name"]) > (ms, name)):
                name, ms = row["name"], row["ms"]
            for state, value in ((self.cities, row["city"]), (self.campuses, row["campus"])):
                if value is not None and not state.containsKey((value,)):
                    state.updateValue((value,), (True,))
        self.head.update((name, ms, n))
        yield Row(code=key[0], name=name, cities=sorted(k[0] for k in self.cities.keys()), campuses=sorted(k[0] for k in self.campuses.keys()), rows=n)

    def close(self) -> None:
        pass


def providers(rows: DataFrame) -> DataFrame:
    """One row for each provider that a batch touches, as it is after the batch.

    ``rows``: a stream of ``code``, ``name``, ``city``, ``campus`` and ``at``; rows without a code are left out.
    """
    known = rows.where(F.col("code").isNotNull()).select("code", "name", "city", "campus", F.coalesce(F.unix_millis("at"), F.lit(0)).alias("ms"))
    return known.groupBy("code").transformWithState(Merging(), MERGED, "Update", "None")
