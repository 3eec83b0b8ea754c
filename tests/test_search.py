"""Full-text search against brute force."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from gleanery.functions import tables
from gleanery.functions.porter import STOP, stem
from gleanery.operators import fulltext

# Words and their stems as Porter's paper gives them.
STEMS = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electrical electr goodness good revival reviv allowance allow airliner airlin gyroscopic gyroscop adjustable adjust irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()


def test_stems():
    assert [stem(w) for w in STEMS[::2]] == STEMS[1::2]
    assert [stem(w) for w in ("für", "a1ing", "as", "", "être")] == ["für", "a1ing", "as", "", "être"]


def test_query_language():
    term = lambda w: ((0, w),)
    q = fulltext.asked('Data "Machine learning" or robots -sales the "the art of war" für or')
    assert q.wanted == ((term("data"),), (((0, "machin"), (1, "learn")), term("robot")), (((0, "art"), (2, "war")),), (term("für"),))
    assert q.banned == (term("sale"),)
    for empty in (None, "", "  ", "the of", '""', "-", "or", "!?"):
        assert not fulltext.asked(empty).wanted and not fulltext.asked(empty).banned


WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}


def brute(rows, labels, query):
    """Scores by covers found from their definition: the shortest interval from each hit on that begins one."""
    q = fulltext.asked(query)
    out = {}
    for key, *texts in rows:
        words, at = [], 0
        for text, label in zip(texts, labels):
            for w in regex.findall(r"[\p{L}\p{N}]+", (text or "").lower()):
                at += 1
                words.append((at, stem(w) if w not in STOP else None, label))
            at += 1
        term_at = {a: t for a, t, _ in words}
        hits = lambda p: [(a, label) for a, t, label in words if all(term_at.get(a + o) == x for o, x in p)]  # noqa: E731, B023
        groups = [[h for p in dict.fromkeys(g) for h in hits(p)] for g in q.wanted]
        if not all(groups) or any(hits(p) for p in q.banned):
            continue
        entries = sorted((a, g, 1 / WEIGHTS[label]) for g, found in enumerate(groups) for a, label in found)
        score, best = 0.0, {}
        for first in range(len(entries)):
            need = set(range(len(groups)))
            for last in range(first, len(entries)):
                need.discard(entries[last][1])
                if not need:
                    best[last] = first  # a later start for the same end is shorter
                    break
        for last, first in best.items():
            n = last - first + 1
            noise = entries[last][0] - entries[first][0] - (n - 1)
            score += n / sum(e[2] for e in entries[first : last + 1]) / (1 + (noise if noise >= 0 else (n - 1) // 2))
        out[key] = round(score, 6)
    return out


ROWS = [
    (1, "alpha", "beta gamma", None),
    (2, "Alpha beta!", "x", "alpha y beta z alpha beta"),
    (3, None, "", "Bücher für die Studenten, für alle; BÜCHER"),
    (4, "", "robots and data", "the art of war; art war; art in war"),
    (5, None, None, None),
    (6, "", "", "   "),
    (7, "alpha " * 50, "beta", "alpha beta " * 30),
    (8, "data", "machine learning", "learning machines, data of robot sales"),
]


@pytest.fixture(scope="module")
def at(spark, tmp_path_factory):
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "betas", "the", "of", "éa", "x"])
    rows = ROWS + [(100 + i, *(" ".join(word() for _ in range(rng.randrange(n))) for n in (4, 6, 40))) for i in range(80)]
    docs = spark.createDataFrame([(*r, r[0] % 3) for r in rows], "id long, title string, owner string, body string, kind long").repartition(5)
    return rows, fulltext.build(docs, "id", {"title": "A", "owner": "B", "body": "C"}, str(tmp_path_factory.mktemp("search") / "i"), ["kind"], buckets=7)


@pytest.mark.parametrize("query", ["alpha", "alpha beta", '"alpha beta"', '"alpha beta" gamma or éa', "beta or alpha alpha -x", "für", "bücher für", "f", '"art of war"', '"art the war" data', '"machine learning" or robots data -sales', "alpha nowhere", '"beta betas"', "alpha or alpha beta gamma éa x"])
def test_ranks_equal_brute_force(at, query):
    rows, index = at
    got = {r["id"]: r["score"] for r in fulltext.matches(index, query).collect()}
    expected = brute(rows, "ABC", query)
    assert set(got) == set(expected) and all(abs(got[k] - v) < 2e-6 for k, v in expected.items())


def test_phrases_end_with_their_field(at):
    rows, index = at
    assert 1 not in {r["id"] for r in fulltext.matches(index, '"alpha beta"').collect()} and 1 in {r["id"] for r in fulltext.matches(index, "alpha beta").collect()}


def test_filters_and_empty_queries(at):
    rows, index = at
    for query in ("alpha", "", "-alpha"):
        every = {r["id"] for r in fulltext.matches(index, query).collect()}
        assert {r["id"] for r in fulltext.matches(index, query, kind=[0, 2]).collect()} == {k for k in every if k % 3 != 1}
        assert {r["id"] for r in fulltext.matches(index, query, kind=None).collect()} == every
    assert fulltext.matches(index, "").count() == len(rows) and fulltext.matches(index, "the").agg(F.max("score")).first()[0] == 0.0
    assert fulltext.matches(index, "-alpha").count() == len(rows) - fulltext.matches(index, "alpha").count()


def test_a_query_reads_its_own_buckets(at, spark):
    plan = fulltext.matches(at[1], "alpha")._jdf.queryExecution().executedPlan().toString()
    assert regex.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = ", plan) and "EqualTo(term,alpha)" in plan


def test_the_index_follows_its_files(spark, tmp_path):
    path = str(tmp_path / "d")
    write = lambda rows: spark.createDataFrame(rows, "id long, t string").write.mode("overwrite").parquet(path)
    read = lambda: fulltext.index(spark.read.parquet(path), "id", {"t": "A"})
    write([(1, "alpha")])
    first = read()
    assert read() is first and fulltext.matches(first, "alpha").count() == 1
    write([(1, "alpha"), (2, "alphas alpha"), (None, "alpha")])
    assert read() is not first and fulltext.matches(read(), "alpha").count() == 2


def test_candidates_in_sql(spark):
    tables.register(spark)
    spark.createDataFrame([(1, 10, "words", 1), (1, 11, "words", 2), (1, 11, "vectors", 1), (2, 10, "vectors", 3)], "request int, key long, branch string, place long").createOrReplaceTempView("lists")
    got = spark.sql("SELECT * FROM candidates(TABLE(lists) PARTITION BY (request), 5)").collect()
    assert sorted(((r["key"], r["word_place"], r["vector_place"], r["score"]) for r in got), key=str) == [(10, 1, None, round(1 / 61, 9)), (10, None, 3, round(0.55 / 63, 9)), (11, 2, 1, round(1 / 62 + 0.55 / 61, 9))]
