"""Streams with states: staging, merged providers and maintained aggregates."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from gleanery.streaming import stateful
from gleanery.streaming.views import MaintainedView

EVENT = "source string, record string, kind string, content_hash string, at timestamp"
ROW = "code string, name string, city string, campus string, at timestamp"


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1 + hour // 24, hour % 24, minute)


@pytest.fixture
def stream(spark, tmp_path):
    """Adds files of rows; runs a query over what is new, from its checkpoint on, and returns all it has written."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)

    def run(build, schema, *files):
        for rows in files:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            time.sleep(0.02)
        given = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

        def keep(batch, number):
            batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(str(tmp_path / "out"))

        query = build(given).writeStream.outputMode("update" if build is stateful.providers else "append").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(180)
        return spark.read.parquet(str(tmp_path / "out")).collect()

    yield run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_staging_over_a_restart_with_late_rows(stream):
    build = lambda s: stateful.staging(s, "24 hours", "1 hour")
    first = [("s", "a", "staged", "h1", at(0)), ("s", "b", "staged", "h1", at(0)), ("s", "a", "staged", "h1", at(0, 5)), ("s", "c", "processed", "h9", at(0))]
    second = [("s", "a", "processed", "h1", at(1)), ("s", "a", "processed", "h1", at(1, 1)), ("s", "d", "staged", "h1", at(10))]
    got = stream(build, EVENT, first, second)
    key = lambda r: (r["record"], r["status"], r["content_hash"])
    assert sorted(map(key, got)) == [("a", "pending", "h1"), ("a", "processed", "h1"), ("b", "pending", "h1"), ("d", "pending", "h1")]
    # After a restart the states are there; a row before the watermark (9:00) is dropped, b is overdue once time has passed.
    third = [("s", "z", "staged", "late", at(2)), ("s", "a", "staged", "h1", at(11)), ("s", "a", "staged", "h2", at(12))]
    got = stream(build, EVENT, third, [("s", "e", "staged", "h1", at(30))], [("s", "e", "staged", "h1", at(30, 1))], [("s", "b", "processed", "h1", at(31))])
    assert set(map(key, got)) == {("a", "pending", "h1"), ("a", "processed", "h1"), ("b", "pending", "h1"), ("d", "pending", "h1"), ("a", "pending", "h2"), ("b", "stale", "h1"), ("e", "pending", "h1"), ("b", "processed", "h1")}
    assert len(got) == 8 and not [r for r in got if r["record"] == "z"]


def test_providers_merge_over_a_restart(stream):
    first = [("p", "Old", "Rome", None, at(0)), ("p", "New", "Bern", "North", at(2)), ("q", None, None, None, at(0)), (None, "x", "y", "z", at(0))]
    got = {(r["batch"], r["code"]): (r["name"], r["cities"], r["campuses"], r["rows"]) for r in stream(stateful.providers, ROW, first)}
    assert got == {(0, "p"): ("New", ["Bern", "Rome"], ["North"], 2), (0, "q"): (None, [], [], 1)}
    got = {(r["batch"], r["code"]): (r["name"], r["cities"], r["campuses"], r["rows"]) for r in stream(stateful.providers, ROW, [("p", "Older", "Rome", "South", at(1))], [("q", "Q", "Lyon", None, at(1)), ("q", "Q", "Lyon", None, at(1))])}
    assert {k: v for k, v in got.items() if k[0] > 0 and v[3]} == {(1, "p"): ("New", ["Bern", "Rome"], ["North", "South"], 3), (2, "q"): ("Q", ["Lyon"], [], 3)}


CHANGE = "id long, kind string, size long, price decimal(10,2), seq long, deleted boolean"


def test_a_view_equals_a_recompute(spark, tmp_path):
    rng = random.Random(5)
    view = MaintainedView(spark, str(tmp_path / "v"), ["id"], ["kind"], {"size": "bigint", "price": "decimal(20,2)"}, "seq", compact=3)
    rows: dict = {}
    from decimal import Decimal

    for number in range(8):
        batch, seq = [], 0
        for _ in range(rng.randrange(1, 60)):
            seq += 1
            key = rng.choice([None, *range(40)])
            gone = rng.random() < 0.3
            change = (key, rng.choice(["a", "b", None]), rng.randrange(9), Decimal(rng.randrange(900)) / 100, seq, gone)
            batch.append(change)
            rows[key] = None if gone else change
        df = spark.createDataFrame(batch, CHANGE).repartition(3)
        view.apply(df, number)
        view.apply(df, number)  # run again after its commit
        expected: dict = {}
        for r in rows.values():
            if r:
                n, size, price = expected.get(r[1], (0, 0, Decimal(0)))
                expected[r[1]] = (n + 1, size + r[2], price + r[3])
        got = {r["kind"]: (r["n"], r["size"], r["price"]) for r in view.read().collect()}
        assert got == expected == {r["kind"]: (r["n"], r["size"], r["price"]) for r in view.live().collect()}
    assert len(view.states.manifest()["rows"]) <= 3
    assert view.read(3600).first()["mode"] == "snapshot" and view.read(0).first()["mode"] == "live" and view.read().first()["seconds"] > 0


def test_a_view_follows_a_stream(spark, tmp_path):
    view = MaintainedView(spark, str(tmp_path / "v"), ["id"], ["kind"], {"size": "bigint"}, "seq")
    put = lambda rows: spark.createDataFrame(rows, "id long, kind string, size long, seq long, deleted boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    follow = lambda: view.following(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in")), str(tmp_path / "state")).awaitTermination(120)
    put([(1, "a", 5, 1, False), (2, "a", 7, 1, False)])
    follow()
    put([(1, "b", 6, 2, False), (2, "a", 7, 2, True)])
    follow()
    follow()
    assert [(r["kind"], r["n"], r["size"]) for r in view.read().collect()] == [("b", 1, 6)]
