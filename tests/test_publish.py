"""Publication in generations, and gates that stop a write."""

import threading

import pytest
from pyspark.sql import functions as F

from gleanery.operators import apply, gates
from gleanery.sources.generations import Conflict, Generations

SCHEMA = "id long, content_hash string, v string"


@pytest.fixture
def made(spark, tmp_path):
    return (lambda rows: spark.createDataFrame(rows, SCHEMA).repartition(3)), Generations(spark, str(tmp_path / "t"), "id")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_generations_replay_and_deletes(made):
    rows, table = made
    assert table.manifest() is None and table.read() is None
    first = rows([(1, "a", "x"), (2, "b", "y")])
    assert table.sync(first, apply=False) | {"generation": 0, "new": 2, "rows": 2, "applied": 0} == table.sync(first, apply=False) and table.manifest() is None
    assert table.sync(first)["applied"] == 2
    pinned = table.read()
    done = table.sync(rows([(1, "a", "x"), (2, "c", "z"), (3, "d", "w")]))
    assert {k: done[k] for k in ("generation", "new", "changed", "unchanged", "removed", "rows", "applied")} == {"generation": 2, "new": 1, "changed": 1, "unchanged": 1, "removed": 0, "rows": 3, "applied": 2}
    replay = table.sync(rows([(1, "a", "x"), (2, "c", "z"), (3, "d", "w")]))
    assert replay["applied"] == 0 and replay["unchanged"] == 3 and replay["data"] == done["data"] and replay["hash"] == done["hash"] and replay["generation"] == 3
    gone = table.sync(rows([(3, "d", "w")]))
    assert gone["removed"] == 2 and rows_of(table.read()) == [(3, "d", "w", 2)]
    assert rows_of(pinned) == [(1, "a", "x", 1), (2, "b", "y", 1)] and rows_of(table.read(2)) == [(1, "a", "x", 1), (2, "c", "z", 2), (3, "d", "w", 2)]
    assert table.expire(1) == 2 and table.manifest(2) is None and rows_of(table.read()) == [(3, "d", "w", 2)]
    assert table.sync(rows([]))["removed"] == 1 and table.read().count() == 0


def test_a_failed_write_leaves_the_old_generation(made):
    rows, table = made
    table.sync(rows([(1, "a", "x")]))
    for bad in (
        gates.controlled(rows([(9, "d", "w")]), {"rows": (F.count("*"), 2)}),
        gates.expected(rows([(9, "d", "w")]), exact=0),
        gates.expected(rows([(9, "d", "w")]), floor=5),
        gates.sound(apply.checked(rows([(8, "d", "w"), (9, None, "w")]), {"hash": F.col("content_hash").isNotNull()}), "id"),
        gates.found(rows([(8, "d", "w"), (9, "d", "w")]), rows([(8, "x", "x")]).select("id", F.lit(1).alias("scope")), ["id"], "scope"),
    ):
        with pytest.raises(Exception, match="USER_RAISED_EXCEPTION"):
            table.sync(bad)
        assert table.manifest()["generation"] == 1 and rows_of(table.read()) == [(1, "a", "x", 1)]
    # A failure within the write itself, after the counts.
    seen = []

    def broken(*_):
        seen.append(table.plan)
        raise RuntimeError("lost")

    commit, table._commit = table._commit, broken
    with pytest.raises(RuntimeError, match="lost"):
        table.sync(rows([(2, "b", "y")]))
    table._commit = commit
    assert seen and rows_of(table.read()) == [(1, "a", "x", 1)]
    assert table.sync(rows([(2, "b", "y")]))["generation"] == 2 and table.expire(2) == 1  # what the failed one left


def test_of_two_writers_one_commits(made):
    rows, table = made
    table.sync(rows([(1, "a", "x")]))
    other = Generations(table.spark, table.path, "id")
    meet, results = threading.Barrier(2), []

    def write(t, row):
        commit = t._commit
        t._commit = lambda m: (meet.wait(60), commit(m))
        try:
            results.append(t.sync(rows([row]))["generation"])
        except Conflict:
            results.append("conflict")

    writers = [threading.Thread(target=write, args=a) for a in ((table, (1, "b", "y")), (other, (1, "c", "z")))]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(map(str, results)) == ["2", "conflict"] and table.read().count() == 1


def test_gates_hand_on_what_is_sound(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], SCHEMA)
    ok = {"v": F.col("v").isNotNull()}
    assert rows_of(gates.sound(apply.checked(rows, ok), "id").select("id")) == [(1,), (2,)]
    assert rows_of(gates.found(rows, spark.createDataFrame([(1, 7), (2, 8), (3, 9)], "id long, n int"), ["id"], "n").select("id", "n")) == [(1, 7), (2, 8)]
    assert gates.controlled(rows, {"rows": (F.count("*"), 2), "hashes": (F.count("content_hash"), 1)}).count() == 2
    assert gates.expected(rows.limit(0), exact=0).count() == 0 and gates.expected(rows, floor=2).count() == 2
    with pytest.raises(Exception, match="no scope for 2"):
        gates.found(rows, spark.createDataFrame([(1, 7)], "id long, n int"), ["id"], "scope").count()
    with pytest.raises(Exception, match="row id=2 breaks hash"):
        gates.sound(apply.checked(rows, {"hash": F.col("content_hash").isNotNull()}), "id").count()
    with pytest.raises(Exception, match="no n for null"):
        gates.found(spark.createDataFrame([(None,)], "id long"), spark.createDataFrame([(None, 1)], "id long, n int"), ["id"], "n").collect()


def test_batches_apply_whole(spark):
    rows = apply.checked(spark.createDataFrame([(1, 1), (1, -1), (2, 1), (None, 1), (None, 2), (3, -1)], "b long, v int"), {"v": F.col("v") > 0})
    assert sorted(map(str, apply.accepted(rows, "b").collect())) == sorted(map(str, rows.where("b = 2 or b is null").drop("errors").collect()))
    assert apply.accepted(rows).count() == 0 and apply.accepted(rows.where("v > 0")).count() == 4
