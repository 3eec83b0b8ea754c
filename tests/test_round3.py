"""What the findings of round 3 named."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gleanery import plans
from gleanery.operators import facts, fulltext, scoped
from gleanery.plans import retrieval

SF = "/root/testdata/sf0.001"


def test_facts_of_one_record_id_leave_nothing_to_chance(spark):
    fact = lambda amount: {"course_url": None, "fee_amount": amount, "fee_year": 2024}
    rows = [(1, "9.00"), (7, "5.00"), (7, "30.00"), (7, "4.00"), (2, "99.00")]
    tests = spark.createDataFrame([("IELTS",)], "test_code string")
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        found = spark.createDataFrame([(i, "c", "P1", "resolved", fact(a)) for i, a in rows], f"record_id long, course_id string, course_code string, state string, payload {facts.PAYLOAD}").coalesce(1)
        got = facts.shredded(found, tests).select(facts.shown(F.col("fact")).alias("fact")).collect()
        assert [r["fact"] for r in got] == ["amount=5.00,currency=AUD,year=2024"]


@pytest.fixture
def twice(tmp_path):
    """Lines with one key and other values beside those of the smallest tables."""
    con = duckdb.connect()
    for name in ("region", "supplier"):
        con.execute(f"COPY (FROM '{SF}/{name}.parquet') TO '{tmp_path}/{name}.parquet'")
    con.execute(f"COPY (FROM '{SF}/lineitem.parquet' UNION ALL SELECT * REPLACE (l_extendedprice + (l_partkey % 7) - 3 AS l_extendedprice, 51 - l_quantity AS l_quantity) FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    for name in ("region", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet'")
    return con, str(tmp_path)


@pytest.mark.parametrize("name", ["fact_apply", "change_images"])
def test_facts_equal_sql_where_ids_repeat(spark, twice, name):
    con, path = twice
    df = plans.queries()[name](spark, path)
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({plans.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, expected))


def test_nearest_vectors_are_of_all_languages(spark):
    docs = [(i, f"text {i}", lang, size) for i, (lang, size) in enumerate([("en", 10), ("es", 10), ("de", 3000), ("pt", 10), (None, 10)])]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long"),
        "embeddings": spark.createDataFrame([(i, [1.0, i / 10], 0) for i in range(6)], "vec_id long, embedding array<float>, label int"),
    }
    assert [r["vec_id"] for r in retrieval.vector_topk(tables.__getitem__).orderBy("place").collect()] == [0, 1, 3, 4]


def test_tallies_equal_the_counts_of_reconciled_records(spark):
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    rows = [(i // 2, pick("a b", "A-B", " a b ", "c", "d", None, " "), pick("n", "n", None), pick("x 1", "x-1", "X 1", "y", None), "t", pick(None, "Active", "unknown", "closed"), None, None) for i in range(300)]
    records = spark.createDataFrame(rows, "ord long, provider_code string, provider_name string, course_code string, title string, lifecycle string, reg_scheme string, reg_code string")
    providers = spark.createDataFrame([("A-B", 1), ("c", 2), ("c", 3)], "code string, id long")
    courses = spark.createDataFrame([("C", "y", 5), ("A B", "x 1", 6)], "provider_code string, course_code string, id long")
    for known in (None, courses):
        given = ("CA", "ircc_dli", "local", providers, known)
        for some in (records, records.limit(0), records.where("lifecycle = 'closed'")):
            assert sorted(scoped.tallied(some, *given).collect()) == sorted(scoped.counted(scoped.reconciled(some, *given)).collect())
    plan = plans.queries()["scoped_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2  # lines and suppliers, each read once


def test_locations_are_compared_by_number_in_shares_that_do_not_grow(spark):
    plan = plans.queries()["course_locations"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "keys=[course" in plan and "Campus" not in plan[plan.index("HashAggregate") :].split("HashAggregate", 2)[2]
    assert "REPARTITION_BY_NUM" in plan


def test_postings_are_kept_in_chunks(spark):
    docs = spark.createDataFrame([(i, "alpha beta the alpha", "beta") for i in range(500)], "id long, a string, b string").coalesce(1)
    rows = fulltext.postings(docs, "id", ["a", "b"])
    got = {r["term"]: r for r in rows.collect()}
    assert len(got) == rows.count() == 2 and list(got["beta"]["keys"]) == list(range(500))
    assert got["beta"]["at"][:4] == [2, 6, 2, 6] and list(got["beta"]["field"][:4]) == [0, 1, 0, 1] and set(got["alpha"]["sizes"]) == {2}
    assert sorted((r["term"], r["key"], tuple(r["at"])) for r in fulltext.unpacked(rows).where("key = 7").collect()) == [("alpha", 7, (1, 4)), ("beta", 7, (2, 6))]
