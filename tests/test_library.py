"""Readers, sinks, snapshots, retrieval modes and streams."""

import json
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from gleanery.functions import exprs
from gleanery.operators import filters, retrieval, serve, snapshot
from gleanery.sources import readers, sinks
from gleanery.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_csv_and_shards(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Course Code,Course  Name!\r\nC1,"a ""quoted"", name"\r\n,\r\nC2,"two\nlines"\r\n', newline="")
    (tmp_path / "b.csv").write_text("Course Code,Course  Name!\nC2,again\n")
    one = readers.csv(spark, str(tmp_path / "a.csv"))
    assert one.columns == ["course_code", "course_name"] and [tuple(r) for r in one.orderBy("course_code").collect()] == [("C1", 'a "quoted", name'), ("C2", "two\nlines")]
    both, conflicts = readers.shards(spark, str(tmp_path / "*.csv"), "course_code")
    assert both.count() == 3 and [tuple(r) for r in conflicts.collect()] == [("C2", 2, ["a.csv", "b.csv"])]


def test_json_zip_and_nested(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"programs": [{"id": 1, "title": "a", "intakes": [{"m": "x"}]}, {"id": 2, "title": "b", "intakes": []}]}))
    items = readers.json_items(spark, str(tmp_path / "x.json"), "struct<id:long,title:string,intakes:array<struct<m:string>>>", "programs")
    rows = readers.nested(items, "intakes").orderBy("id").collect()
    assert [(r["id"], r["place"], r["item"] and r["item"]["m"]) for r in rows] == [(1, 0, "x"), (2, None, None)]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("data/Courses.csv", "x")
        z.writestr("readme.txt", "y")
    assert [(r["member"], bytes(r["content"])) for r in readers.zip_members(spark, str(tmp_path / "z.zip"), "courses").collect()] == [("data/Courses.csv", b"x")]


def test_workbook_and_header(spark, tmp_path):
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>College</t></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{m}"><sheetData><row r="1"><c r="A1"><v>7</v></c></row><row r="3"><c r="A3" t="s"><v>0</v></c><c r="C3" t="inlineStr"><is><t>APS code</t></is></c></row></sheetData></worksheet>')
    rows = readers.xlsx(spark, str(tmp_path / "b.xlsx"))
    assert [(x["sheet"], x["row"], x["cells"]) for x in rows.orderBy("row").collect()] == [("S", 1, ["7"]), ("S", 3, ["College", None, "APS code"])]
    assert readers.header_row(rows, {"aps": 5, "college": 4}).select("row", "score").first() == (3, 9)


def test_html(spark):
    page = '<table><tr><th>Name</th></tr><tr><td> A &amp; B </td><td>x</td></tr></table><div class="card"><h2>T1</h2><i>c1</i></div><div class="card"><h2>T2</h2></div><script>var table = [{"k": 1}];</script>'
    df = spark.createDataFrame([(page,)], "html string")
    out = df.select(readers.html_rows(F.col("html")).alias("t"), readers.html_cards(F.col("html"), '<div class="card">', {"title": "<h2>(.*?)</h2>", "code": "<i>(.*?)</i>"}).alias("c"), readers.script_json(F.col("html"), "table", "array<struct<k:int>>").alias("j")).first()
    assert out["t"] == [["Name"], ["A & B", "x"]] and [tuple(c) for c in out["c"]] == [("T1", "c1"), ("T2", None)] and out["j"][0]["k"] == 1


def test_pages_of_an_api(spark):
    df = spark.range(100).select(F.floor(F.col("id") / 10).alias("page"), (F.col("id") % 10).alias("place"), "id")
    assert sorted(r["id"] for r in readers.paged(df, 10, 15, 20).collect()) == list(range(15, 35))


def test_replay_changes_nothing(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (None, "n", "y")], "k long, v string, w string")
    assert {r["state"]: r["n"] for r in sinks.plan(old, old, ["k"]).collect()} == {"unchanged": 3}
    new = spark.createDataFrame([(1, "a", None), (3, "c", "z")], "k long, v string, w string")
    merged = snapshot.upsert(old, new, ["k"])
    assert merged.count() == 4 and {r["state"] for r in sinks.plan(merged, snapshot.upsert(merged, new, ["k"]), ["k"]).collect()} == {"unchanged"}
    assert snapshot.digest(merged, ["k", "v", "w"]).first() == snapshot.digest(merged.repartition(3), ["k", "v", "w"]).first()
    sinks.publish(merged, str(tmp_path / "t"), 1)
    with pytest.raises(Exception):
        sinks.publish(merged, str(tmp_path / "t"), 1)


def test_one_current_row_for_a_key(spark):
    rows = spark.createDataFrame([(1, "a", "2024-01-01", None, "current"), (2, "b", "2024-03-01", None, "current")], "k long, v string, at string, valid_to string, status string")
    batch = spark.createDataFrame([(1, "c", "2024-02-01"), (2, "d", "2024-02-01")], "k long, v string, at string")
    once = snapshot.supersede(rows, batch, "k", "at")
    assert once.where("status = 'current'").groupBy("k").count().where("count > 1").count() == 0
    assert sorted(map(str, once.collect())) == sorted(map(str, snapshot.supersede(once, batch, "k", "at").collect()))


def test_uuid(spark):
    assert spark.range(1).select(exprs.uuid_v5(F.lit("x:é")).alias("u")).first()["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "x:é"))


def test_modes_and_reads(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green pear"), (3, "red pear")], "id long, t string")
    words = retrieval.ranked(docs.where("t like 'red%'").select("id", F.lit(1.0).alias("score")), "score", "id", 10)
    none = words.limit(0)
    assert [r["id"] for r in retrieval.hybrid(words, none, "id", 5).collect()] == [1, 3]
    assert retrieval.hybrid(words, none, "id", 5).first()["mode"] == "keyword_fallback" and retrieval.hybrid(words, none, "id", 5, "vector").count() == 0
    assert retrieval.fused(words, words, "id", 5).first()["score"] == pytest.approx(1.55 / 61, abs=1e-9)
    reads = serve.Reads()
    reads.add("docs", 2, lambda limit=1: filters.page(docs, [F.col("id")], limit))
    assert reads("docs", 3, limit=2).count() == 2
    with pytest.raises(PermissionError):
        reads("docs", 1)
    body = json.loads(serve.envelope(docs, ["id"]).first()["body"])
    assert body["total"] == 3 and body["items"][0] == {"id": 1, "t": "red apple"}


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = jobs.incremental(spark, str(tmp_path / "in"), events.schema, 1)
    read = lambda p: spark.read.parquet(p)
    jobs.upserting(stream.select("user_id", "event_id", "event_type"), ["user_id"], "event_id", str(tmp_path / "t"), str(tmp_path / "c"), read).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "t" / "generation=3"))
    assert last.count() == events.select("user_id").distinct().count()
    q = jobs.rolling_counts(jobs.incremental(spark, str(tmp_path / "in"), events.schema, 1), "40 days").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()


def test_identities_are_resolved_without_a_window(spark):
    from gleanery.operators import reconcile

    rows = [(1, None, "a"), (2, "C1", None), (3, "C1", "a"), (4, "C1", "b"), (5, "C2", "c"), (6, "C3", "d"), (7, "C3", "e"), (8, None, "f")]
    incoming = spark.createDataFrame([(i, c, (c or "").lower(), t) for i, c, t in rows], "ord long, code string, key string, title string")
    out = reconcile.resolve(incoming, spark.createDataFrame([("C1", 1)], "code string, id long"), spark.createDataFrame([("c2", 2)], "key string, id long"))
    got = {r["ord"]: (r["title"], r["outcome"]) for r in out.collect()}
    assert [got[i] for i in (1, 2, 8)] == [(None, "conflict")] * 3
    assert got[3] == got[4] == ("b", "existing_by_identifier") and got[5] == ("c", "existing_by_stable_key")
    assert got[6] == ("e", "created") and got[7] == ("e", "existing_by_stable_key")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_zero_vectors_and_missing_queries_are_left_out(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    assert [r["id"] for r in retrieval.vector(vectors, [2.0, 0.0], "id", 10).orderBy("place").collect()] == [1, 4]
    assert retrieval.vector(vectors, None, "id", 10).count() == 0 and retrieval.vector(vectors, [0.0, 0.0], "id", 10).count() == 0


def test_batches_apply_whole_or_not_at_all(spark):
    from gleanery.operators import apply, pages

    rows = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "k long, v long")
    checked = apply.checked(rows, {"there": F.col("v").isNotNull(), "positive": F.col("v") > 0})
    assert {r["k"]: r["errors"] for r in checked.collect()} == {1: [], 2: ["there", "positive"], 3: ["positive"]}
    assert apply.accepted(checked).count() == 0 and apply.accepted(checked.where("k = 1")).columns == ["k", "v"]
    old = rows.select("k", F.col("v").cast("string").alias("content_hash"), F.lit(3).alias("generation"))
    new = old.select("k", "content_hash").where("k < 3")
    once = apply.projection_sync(old, new, "k", 4)
    assert {r["k"]: r["generation"] for r in once.collect()} == {1: 3, 2: 3} and sorted(once.collect()) == sorted(apply.projection_sync(once, new, "k", 5).select(once.columns).collect())
    assert pages.progress(191, 150, 50, 50) == {"next_offset": 191, "has_more": False, "percent": 100}
    assert pages.progress(191, 100, 50, 50) == {"next_offset": 150, "has_more": True, "percent": 79}


def test_staging_and_verified_blobs(spark, tmp_path):
    import hashlib

    records = spark.createDataFrame([("s", "r1", "a"), ("s", "r1", "a"), ("s", "r2", "b")], "source string, record string, body string")
    first = sinks.stage(records.limit(0).withColumn("content_hash", F.lit("")), records, "source", "record", ["body"])
    assert first.count() == 2 and sinks.stage(first, records, "source", "record", ["body"]).count() == 2
    for name, data in (("a", b"one"), ("b", b"two")):
        (tmp_path / name).write_bytes(data)
    hashes = spark.createDataFrame([(hashlib.sha256(b"two").hexdigest(),)], "sha256 string")
    assert [bytes(r["content"]) for r in readers.verified(spark, str(tmp_path), hashes).collect()] == [b"two"]


def test_rows_come_once_through_a_stream(spark, tmp_path):
    rows = spark.sql("select id % 5 as k, timestamp'2024-01-01 00:00:00' as ts from range(20)")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = jobs.once(jobs.incremental(spark, str(tmp_path / "in"), rows.schema, 1), "k")
    stream.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["k"] for r in spark.table("once").collect()) == [0, 1, 2, 3, 4]


def test_folded_labels(spark):
    row = spark.range(1).select(exprs.label(F.lit("Ünï & Ångström Ñandú ẫ e\u0301")).alias("x"), exprs.alias_forms(F.lit("The Acme (City) Pty Ltd Australia")).alias("f")).first()
    assert row["x"] == "uni and angstrom nandu a e" and "acme" in row["f"] and "the acme city pty ltd australia" in row["f"]
