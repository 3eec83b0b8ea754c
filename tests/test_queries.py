"""Every query with SQL equals DuckDB on the smallest tables."""

import duckdb
import pytest

from gleanery import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert norm(tuple(r[c] for c in columns) for r in df.collect()) == norm(expected)


def test_every_query_has_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())
