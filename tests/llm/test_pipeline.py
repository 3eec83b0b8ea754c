"""The five stages on the smallest tables and on edge rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanery.llm import common, queries

SF = "/root/testdata/sf0.001"


def edge_rows(spark):
    rows = [(900, None, None, None, 0), (901, "", "en", "a", 0), (902, "word", None, "a", 4), (None, "no id", "en", None, 5), (903, "same text of a few words", "en", "a", 24), (903, "same text of a few words", "en", "a", 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("x") for c in ("keep", "base", "spans", "uid", "row", "hits", "__tokens")})


def test_run_keeps_only_rows_of_documents(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = common.table(spark, SF, "documents")
    assert out.columns == [*docs.columns, "probability", "copies"]
    ids = [r["doc_id"] for r in out.collect()]
    assert ids and len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert out.where("text is null or text = '' or copies < 1").count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_edge_rows_and_empty_tables(spark, name, stage):
    docs = edge_rows(spark)
    out = stage(spark, docs, SF)
    columns = docs.columns if name != "mixing_to_targets" else [*docs.columns, "probability", "copies"]
    assert out.columns == columns and {r["keep"] for r in out.collect()} <= {"x"}
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_every_stage_takes_effect(spark):
    docs, counts = common.table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.stored(stage(spark, docs, SF), name)
        counts[name] = (before.count(), docs.count())
    assert counts["quality_classifier"][1] < counts["quality_classifier"][0] and counts["minhash_near_dedup"][1] < counts["minhash_near_dedup"][0]
    assert counts["benchmark_decontamination"][1] < counts["benchmark_decontamination"][0] and counts["private_data"][0] == counts["private_data"][1]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[names.index(c)] for c in df.columns) for r in result.fetchall()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError):
        common.shared_dir(Session)
    assert common.free(["A", "_a"], "a") == "__a"
