"""What the findings of round 4 named."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gleanery import plans
from gleanery.operators import facts, gates
from gleanery.plans import depth
from gleanery.session import table

SF = "/root/testdata/sf0.001"


def plan_of(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


@pytest.mark.parametrize("name", ["change_images", "fact_apply"])
def test_facts_are_made_once_and_read_from_there(spark, name):
    df = plans.queries()[name](spark, SF)
    plan = plan_of(df, "executedPlan")
    assert "lineitem" not in plan and plan.count("FileScan") == 3  # what was, what is kept, what is brought
    con = duckdb.connect()
    for t in ("region", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({plans.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, expected))


def test_a_payload_is_parsed_once(spark):
    tests = spark.createDataFrame([("IELTS",), ("TOEFL",)], "test_code string")
    found = depth.fact_records(lambda name: table(spark, SF, name)).where("state = 'resolved'")
    plan = plan_of(facts.shredded(found, tests))
    assert plan.count("from_json(") == 1 and plan.count("Relation [l_orderkey") == 3
    assert "Inner" not in plan[: plan.index("from_json(")]  # nothing that grows is joined for each fact


def test_images_of_maps_in_another_order_and_of_secrets(spark):
    one = lambda *x: ",".join(f"'{y}'" for y in x)
    maps = {1: (one("a", 1, "b", 2), one("b", 2, "a", 1)), 2: (one("my_Token", 1, "b", 2), one("my_Token", 2, "b", 2)), 3: (one("b", 1, "a", 2, "PASSWORD", 3), None), 4: ("", one("z", 1, "y", 2)), 5: ("", "")}
    rows = lambda i: " union all ".join(f"select {k} k, map({v[i]}) fact" for k, v in maps.items() if v[i] is not None)
    empty = F.create_map().cast("map<string,string>")
    old, new = (spark.sql(rows(i)).withColumn("fact", F.coalesce(F.col("fact").cast("map<string,string>"), empty)) for i in (0, 1))
    got = {r["k"]: (r["change"], r["differ"], r["before"], r["after"]) for r in facts.images(old, new, ["k"]).collect()}
    assert got == {
        1: ("unchanged", [], {"a": "1", "b": "2"}, {"b": "2", "a": "1"}),
        2: ("updated", [], {"b": "2"}, {"b": "2"}),
        3: ("kept", ["a", "b"], {"b": "1", "a": "2"}, None),
        4: ("updated", ["y", "z"], {}, {"z": "1", "y": "2"}),
        5: ("unchanged", [], {}, {}),
    }


def test_rows_that_need_nothing_pass_the_gate(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", None), ("b", "y")], "kind string, code string")
    known = spark.createDataFrame([("x",)], "code string")
    assert gates.found(rows, known, ["code"], "code", F.col("kind") == "a").count() == 3
    for needed in (None, F.col("kind") == "b", F.lit(None).cast("boolean")):
        with pytest.raises(Exception, match="no code for"):
            gates.found(rows, known, ["code"], "code", needed).collect()


def test_facts_applied_where_a_course_has_many_records(spark, tmp_path):
    """All lines of one course and other prices: the greatest record of each key stays, as in the SQL."""
    con = duckdb.connect()
    for t in ("region", "supplier"):
        con.execute(f"COPY (FROM '{SF}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (1::BIGINT AS l_suppkey, 7::BIGINT AS l_partkey) FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    for t in ("region", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    df = plans.queries()["fact_apply"](spark, str(tmp_path))
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({plans.oracle_sql()['fact_apply']})").fetchall()
    assert expected and sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, expected))
