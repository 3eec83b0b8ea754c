"""Facts, page markup, evidence filters, cubes and collations on rows of their own."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from gleanery.functions import markup
from gleanery.operators import evidence, facts, filters, reconcile, regulatory, scoped


def test_entities_lines_and_headings(spark):
    texts = {
        "a &amp; b &lt;c&gt; &quot;&apos;&nbsp;&ndash;&mdash;": "a & b <c> \"'\u00a0–—",
        "&#65;&#x42;&#X1f600;&#8364;": "AB\U0001f600€",
        "&amp;lt; &#38;amp;": "&lt; &amp;",
        "&unknown; &; & &#; &#x; &#0; &#xD800; &#1114112; &#99999999;": "&unknown; &; & &#; &#x; &#0; &#xD800; &#1114112; &#99999999;",
        "": "",
        "&AMP;&Lt;": "&<",
    }
    df = spark.createDataFrame(list(texts.items()), "x string, y string")
    assert [tuple(r) for r in df.select("x", markup.decoded(F.col("x")).alias("d"), "y").where("not (d <=> y)").collect()] == []
    page = "<html><!-- <p>no</p> --><script>var t='</p>x'</script><h1 class=a>Big <b>&amp;</b>\n Bold</h1><p>one&nbsp;&nbsp; 1<br/>two &#233;</p><ul><li>l1</li><li> </li><li>l2</ul>a < b<style>p{}</style> end"
    got = spark.createDataFrame([(page,), ("",), (None,), ("plain",)], "h string").select(markup.lines(F.col("h")).alias("l"), markup.heading(F.col("h")).alias("t"), F.array_join(markup.tokens(F.col("h")), "").alias("same"), "h").collect()
    assert got[0]["l"] == ["Big &", "Bold", "one 1", "two é", "l1", "l2", "a < b end"] and got[0]["t"] == "Big & Bold"
    assert got[1]["l"] == [] and got[1]["t"] == "" and got[2]["l"] is None and got[3]["l"] == ["plain"] and all(r["same"] == r["h"] for r in got if r["h"] is not None)


def test_tables_by_key(spark):
    page = "<table><tr><th>Code</th><th>City</th></tr><tr><td>A&#49;</td><td>Bern</td><td>N</td></tr><tr><td>A1</td><td> </td></tr><tr><td></td><td>Rome</td></tr></table>"
    other = "<TABLE><TR><TD>A1</TD><TD>Aarau</TD><td>N</td></TR></TABLE>"
    got = markup.table_sets(spark.createDataFrame([(page,), (other,), (None,), ("no table",)], "h string"), "h", 0, {"city": 1, "campus": 2}).orderBy("key").collect()
    assert [tuple(r) for r in got] == [("A1", ["Aarau", "Bern"], ["N"]), ("Code", ["City"], [])]


def found_of(spark, *payloads, state="resolved"):
    rows = [(i, "P", "C1", state, "id", json.dumps(p)) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "record_id long, provider_code string, course_code string, state string, course_id string, payload string")
    return df.withColumn("payload", F.from_json("payload", facts.PAYLOAD))


def test_facts_stop_or_apply(spark):
    tests = spark.createDataFrame([("IELTS",)], "test_code string")
    whole = {"course_url": " u ", "fee_amount": "10.5", "fee_year": 2024, "intakes": [{"intake_label": "May"}, {"intake_label": "July", "intake_year": 2025}], "english_requirements": [{"test_code": " ielts", "overall_score": "6.5"}]}
    later = {"fee_amount": "12", "fee_year": 2024}
    got = {(r["relation"], r["fact_key"]): r["fact"] for r in facts.shredded(found_of(spark, whole, later, {}), tests).collect()}
    assert got == {
        ("link", "u"): {"url": "u"},
        ("fee", "c1:2024"): {"amount": "12.00", "year": "2024", "currency": "AUD"},
        ("intake", "c1:current:May"): {"label": "May"},
        ("intake", "c1:2025:July"): {"label": "July", "year": "2025"},
        ("english", "IELTS"): {"test": "IELTS", "score": "6.50"},
    }
    plan = facts.preview(found_of(spark, whole, {})).orderBy("record_id").collect()
    assert [tuple(r)[3:] for r in plan] == [(1, 1, 2, 1), (0, 0, 0, 0)]
    for bad, said in (({"fee_amount": "-1"}, "positive fee"), ({"fee_amount": "x"}, "positive fee"), ({"intakes": [{"intake_label": " "}]}, "intake label"), ({"english_requirements": [{"test_code": "OTHER"}]}, "no English test for OTHER")):
        with pytest.raises(Exception, match=said):
            facts.shredded(found_of(spark, whole, bad), tests).collect()
    with pytest.raises(Exception, match="breaks resolved"):
        facts.shredded(found_of(spark, whole, state="course_missing"), tests).collect()


def test_records_resolve_by_clean_codes_and_qualification(spark):
    record = lambda i, p, c: (i, p, c, "{}")
    records = spark.createDataFrame([record(1, " p1", "c1 "), record(2, "P1", "c9"), record(3, "px", "c1"), record(4, "P2", "C1"), record(5, None, None)], "record_id long, provider_code string, course_code string, payload string")
    providers = spark.createDataFrame([("P1", 1), ("P2", 2)], "provider_code string, provider_id long")
    courses = spark.createDataFrame([(1, "C1", "a"), (2, "C1", "b")], "provider_id long, course_code string, course_id string")
    found = facts.resolved(records, providers, courses, spark.createDataFrame([("p1 ",)], "provider_code string"))
    assert {r["record_id"]: r["state"] for r in found.collect()} == {1: "resolved", 2: "course_missing", 3: "provider_missing", 4: "source_unqualified", 5: "provider_missing"}


def test_images_are_what_is_written(spark):
    old = spark.createDataFrame([(1, {"a": "1", "b": "2", "api_key": "x"}), (2, {"a": "1"}), (3, {"a": "1"})], "k long, fact map<string,string>")
    new = spark.createDataFrame([(1, {"a": "1", "b": "3", "api_key": "y"}), (2, {"a": "1"}), (4, {"a": None, "c": "5"})], "k long, fact map<string,string>")
    rows = {r["k"]: r for r in facts.images(old, new, ["k"]).collect()}
    assert {k: (r["change"], r["differ"]) for k, r in rows.items()} == {1: ("updated", ["b"]), 2: ("unchanged", []), 3: ("kept", ["a"]), 4: ("created", ["c"])}
    assert rows[1]["before"] == {"a": "1", "b": "2"} and rows[1]["after"] == {"a": "1", "b": "3"}
    after = {r["k"]: r["fact"] for r in facts.written(old, new, ["k"]).collect()}
    for k, r in rows.items():
        assert {x: v for x, v in after[k].items() if x != "api_key"} == (r["after"] if r["after"] is not None else r["before"])
    again = facts.images(facts.written(old, new, ["k"]), new, ["k"])
    assert {r["change"] for r in again.collect()} == {"unchanged", "kept"}


def test_seventeen_filters(spark):
    rng = random.Random(2)
    columns = list(evidence.EQUAL)
    rows = [(*(rng.choice("abc") for _ in columns), f"{rng.randrange(256):02x}f{i}", rng.choice([None, dt.date(2024, 6, 1), dt.date(2024, 5, 12), dt.date(2024, 1, 1)]), rng.random() < 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns) + ", hash string, verified_at date, unresolved_conflicts boolean")
    today = "2024-06-02"
    every = [dict(zip(df.columns, r)) for r in rows]
    fresh = lambda d: "unverified" if d is None else "stale" if (dt.date(2024, 6, 2) - d).days > 30 else "ageing" if (dt.date(2024, 6, 2) - d).days > 14 else "fresh"
    cases = [({c: "a"}, lambda r, c=c: r[c] == "a") for c in columns] + [
        ({"hash": "1"}, lambda r: r["hash"].startswith("1")),
        ({"query": "B"}, lambda r: any("b" in r[c] for c in ("hash", "source_id", "entity_id", "evidence_type"))),
        ({"verified_from": "2024-05-12", "verified_to": "2024-06-01"}, lambda r: r["verified_at"] is not None and r["verified_at"] >= dt.date(2024, 5, 12)),
        ({"unresolved_conflicts": False}, lambda r: not r["unresolved_conflicts"]),
        ({"country": ["a", "b"], "layer": "", "job_id": None, "status": []}, lambda r: r["country"] != "c"),
        *[({"freshness": x}, lambda r, x=x: fresh(r["verified_at"]) == x) for x in ("fresh", "ageing", "stale", "unverified")],
    ]
    for wanted, test in cases:
        assert {r["hash"] for r in evidence.filtered(df, today=today, **wanted).collect()} == {r["hash"] for r in every if test(r)}, wanted
    assert len(columns) + 5 == 17 and evidence.filtered(df).count() == 300  # from and to count as one
    with pytest.raises(ValueError, match="no such filter: colour"):
        evidence.filtered(df, colour="red")


def test_cells_of_a_cube(spark):
    one = lambda *x: spark.createDataFrame([(list(x),)], "m array<string>")
    got = filters.coordinates({"a": one("a0", "a1"), "b": one("b0", "b1", "b2"), "c": one("c0", "c1")}, 12).orderBy("sample").collect()
    assert [(r["address"], r["a"], r["b"], r["c"]) for r in got] == [(i, f"a{i // 6}", f"b{i // 2 % 3}", f"c{i % 2}") for i in range(12)]
    few = filters.coordinates({"a": one(*map(str, range(1000))), "b": one(*map(str, range(1000))), "c": one(*map(str, range(1000)))}, 5).orderBy("sample").collect()
    assert [r["address"] for r in few] == [i * 10**9 // 5 for i in range(5)] and [r["a"] for r in few] == ["0", "200", "400", "600", "800"]


def test_dictionary_order(spark):
    df = spark.createDataFrame([(["z", "é", "e", "E", "ä", "a", "Z", "f", "é"],), ([],), (None,)], "w array<string>")
    got = [r["w"] for r in df.select(filters.in_locale(F.col("w")).alias("w")).collect()]
    assert got == [["a", "ä", "e", "E", "é", "é", "f", "z", "Z"], [], None]


def test_codes_alone(spark):
    rows = spark.createDataFrame([("O1", "b"), ("O1", "a"), ("x", "c"), (None, "d"), ("O2", None)], "code string, title string")
    got = {r["code"]: (r["title"], r["n"], r["outcome"], r["provider_id"]) for r in reconcile.by_code(rows, spark.createDataFrame([("O1", "7")], "code string, id string"), "^O[0-9]$").collect()}
    assert got["O1"] == ("a", 2, "existing", "7") and got["x"] == ("c", 1, "conflict", None) and got[None] == ("d", 1, "conflict", None) and got["O2"][2] == "created" and len(got["O2"][3]) == 32


def test_scoped_rules_and_conflicts(spark):
    for schemes, said in ((("", "local"), "required"), (("ircc_dli", " "), "required"), (("cricos", "local"), "ircc_dli"), (("IRCC_DLI", "CIP"), "classifies")):
        with pytest.raises(ValueError, match=said):
            scoped.ruled("CA", *schemes)
    assert scoped.ruled("AU", " CRICOS ", "Cricos") == ("cricos", "cricos")
    row = lambda i, p, n, c, t, s=None, g=None: (i, p, n, c, t, s, g, "7")
    rows = [row(1, " o1 ", "P", "C-1", "A"), row(2, "O1", "P", "C-1", "B", "Suspended", "CIP"), row(3, "O1", "P", "c 1", "C"), row(4, "O2", "Q", "C-1", "D"), row(5, None, "P", "C", "A"), row(6, "O1", "P", "C", " "), row(7, "O1", "P", "C", "A", "closed")]
    df = spark.createDataFrame(rows, "ord long, provider_code string, provider_name string, course_code string, title string, lifecycle string, reg_scheme string, reg_code string").repartition(3)
    known = spark.createDataFrame([("o2", 9)], "code string, id long")
    out = scoped.reconciled(df, "CA", "ircc_dli", "local", known)
    got = {r["ord"]: (r["provider_outcome"], r["course_outcome"]) for r in out.where("not conflict").collect()}
    assert got == {1: ("created", "created"), 2: ("existing", "existing"), 3: ("existing", "existing"), 4: ("existing", "created")}  # "c 1" and "C-1" make one key
    assert {r["name"]: r["n"] for r in scoped.counted(out).collect()} == {"records": 7, "conflicts": 3, "provider_created": 1, "provider_existing": 3, "course_created": 2, "course_existing": 2, "lifecycle_active": 3, "lifecycle_suspended": 1, "lifecycle_inactive": 0, "lifecycle_unknown": 0}
    made = {r["course_key"]: (r["title"], r["lifecycle"], r["provider_id"]) for r in scoped.courses(out).collect()}
    assert made["course:ca:ircc_dli:o2:local:c-1"] == ("D", "active", "9") and made["course:ca:ircc_dli:o1:local:c-1"][:2] == ("C", "active")
    ids = scoped.identifiers(out, "ircc_dli", "local")
    assert ids.where("relation = 'course_registration'").count() == 1 and ids.count() == ids.distinct().count()
    known_course = spark.createDataFrame([("O1", "C-1", "x")], "provider_code string, course_code string, id string")
    again = scoped.reconciled(df, "CA", "ircc_dli", "local", known, known_course)
    assert {r["ord"] for r in again.where("course_id = 'x'").collect()} == {1, 2} and scoped.counted(scoped.reconciled(df.limit(0), "CA", "ircc_dli", "local", known)).where("n > 0").count() == 0


def test_a_snapshot_ends_others_and_its_replay_changes_nothing(spark):
    record = lambda i, c, tuition, other=None: (i, "p", c, "yes", "3", "en", tuition, other, None)
    records = spark.createDataFrame([record(1, "a", "AUD 1,000.50", "n/a"), record(2, "b", None), record(3, "zz", "5"), record(4, "a", "AUD 2", "n/a")], "ord long, provider_code string, course_code string, dual_raw string, hours_raw string, language string, tuition_raw string, non_tuition_raw string, total_raw string")
    courses = spark.createDataFrame([("P", "A", 1), ("P", "B", 2)], "provider_code string, course_code string, course_id long")
    rows = regulatory.matched(regulatory.parsed(records), courses)
    grid = regulatory.fee_grid(rows, "s", "2024-02-01")
    day = dt.date
    observed = spark.createDataFrame([(1, day(2024, 1, 1), "h", "current", None), (1, day(2024, 3, 1), "h", "current", None), (9, day(2024, 1, 1), "h", "current", None)], "course_id long, snapshot_at date, content_hash string, status string, valid_to date")
    fees = spark.createDataFrame([(1, "tuition", "old", 7, day(2024, 1, 1), "active", None), (1, "non_tuition", "o2", 7, None, "active", None), (9, "tuition", "o9", 7, day(2024, 1, 1), "active", None)], "course_id long, fee_type string, source_fee_key string, amount int, snapshot_at date, status string, valid_to date").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    counts = {(r["kind"], r["outcome"]): r["n"] for r in regulatory.counted(rows, grid, observed, fees, "2024-02-01").collect()}
    assert counts == {("fact", "created"): 2, ("fact", "superseded"): 2, ("fee", "created"): 1, ("fee", "superseded"): 2, ("fee", "invalid"): 1, ("record", "course_missing"): 1}
    after, paid = regulatory.observed_after(rows, observed, "2024-02-01"), regulatory.fees_after(grid, fees, "2024-02-01")
    state = {(r["course_id"], str(r["snapshot_at"])): r["status"] for r in after.collect()}
    assert state == {(1, "2024-01-01"): "superseded", (1, "2024-03-01"): "superseded", (9, "2024-01-01"): "current", (1, "2024-02-01"): "current", (2, "2024-02-01"): "current"}
    assert {(r["source_fee_key"], str(r["amount"]), r["status"]) for r in paid.collect()} == {("old", "7.00", "superseded"), ("o2", "7.00", "superseded"), ("o9", "7.00", "active"), ("s:a:tuition:2024-02-01", "2.00", "active")}
    same = lambda x, y: sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    assert same(after, regulatory.observed_after(rows, after, "2024-02-01")) and same(paid, regulatory.fees_after(grid, paid, "2024-02-01"))
    replay = {(r["kind"], r["outcome"]): r["n"] for r in regulatory.counted(rows, grid, after, paid, "2024-02-01").collect()}
    assert replay == {("fact", "unchanged"): 2, ("fee", "unchanged"): 1, ("fee", "invalid"): 1, ("record", "course_missing"): 1}
