"""Periodic runs, edit fingerprints and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import edit_sketch, periodic, queries, resample

SF = "/root/testdata/sf0.001"
EDGES = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (903, "one"), (None, "a b " * 20), (None, "a b " * 20), (904, "x " * 4000), (905, "u v w\u0085x " * 9), (906, "\U0001f600 é" * 40)]


def table(spark, rows):
    return spark.createDataFrame([(k, t, "r", 1, 2, "n") for k, t in rows], "doc_id long, text string, runs string, n_words int, part int, next string").repartition(3)


# 11: periodic runs


def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, e - a, q) for (a, e), q in out.items())


def test_runs_equal_brute_force():
    rng = random.Random(11)
    documents = []
    for _ in range(400):
        letters, w = rng.choice([1, 2, 3, 60]), []
        while len(w) < 250 and rng.random() < 0.9:
            if rng.random() < 0.5:
                w += [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(1, 20))]
            else:
                part = [b"%d" % rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 16, 17, 31, 40]))]
                w += (part * rng.randrange(2, 9))[: rng.randrange(1, 200)]
        documents.append(w)
    assert periodic.runs_of(documents) == [brute_runs(w) for w in documents]
    assert sum(map(len, map(brute_runs, documents))) > 300


@pytest.mark.parametrize("w", [[0] * 20_000, ([0] * 100 + [1]) * 60, [0] * 9_000 + [1] + [0] * 9_000, list(range(5_000)) * 3, list(range(5_000)) * 3 + [7] + list(range(5_000)) * 4])
def test_long_runs(w):
    found = periodic.runs(np.array(w))
    assert all(w[s + q : s + n] == w[s : s + n - q] for s, n, q in found)
    assert all((s == 0 or w[s - 1] != w[s - 1 + q]) and (s + n == len(w) or w[s + n] != w[s + n - q]) for s, n, q in found)
    expected = {20_000: 1, 6_060: 61, 18_001: 2, 15_000: 1, 35_001: 2}[len(w)]
    assert len(found) == len(set(found)) == expected


def expected_11(key, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and w:
        a, n = h // 10 % len(w), len(w)
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    top = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if found else (None,) * 3
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (key, len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op11_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 9000").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert [got[k] for k, _ in rows] == [expected_11(k, t) for k, t in rows]


def test_runs_of_edge_rows(spark):
    found = periodic.find(table(spark, EDGES))
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted(map(str, ((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect())))
    expected = []
    for key, text in EDGES:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = brute_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        expected.append(str((key, len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone))))
    assert got == sorted(expected)
    assert periodic.find(table(spark, EDGES).limit(0)).count() == 0


# 12: fingerprints


def edited(x, y):
    half = len(x) // 2
    return x[: len(x) - half] + y[:half]


def expected_12(rows):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for i, (k, x) in enumerate(rows):
        y = rows[(i + 1) % len(rows)][1]
        e = edited(x, y)
        a, b, c = map(edit_sketch.fingerprint_of, (x, e, y))
        out.append((k, len(x), hashlib.sha256(e.encode()).hexdigest(), a, b, edit_sketch.likeness_of(a, b), edit_sketch.likeness_of(a, c)))
    return sorted(out, key=str)


def test_op12_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_edit_fingerprints(spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == expected_12(rows)
    long = [r for r in got if r["n_chars"] >= 100]
    assert sum(0.35 <= r["near_edited"] <= 0.65 for r in long) >= 0.95 * len(long) and sum(r["near_next"] <= 0.15 for r in long) >= 0.9 * len(long)


@pytest.mark.parametrize("parts", [1, 2, 5, 40])
def test_next_rows_over_ranges(spark, parts):
    docs = table(spark, EDGES).fillna("", ["text"])
    ordered = edit_sketch.in_order(docs, "doc_id", parts)
    assert ordered.columns == ["doc_id", "text", "runs", "n_words", "part", "next"]
    rows = sorted(((k, t or "") for k, t in EDGES), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    expected = sorted((str((rows[i], rows[(i + 1) % len(rows)])) for i in range(len(rows))))
    assert sorted(str(((r["doc_id"], r["text"]), (r["next"]["doc_id"], r["next"]["text"]))) for r in ordered.collect()) == expected
    one = edit_sketch.in_order(docs.where("doc_id = 901"), "doc_id", parts).first()
    assert one["next"]["doc_id"] == 901 and edit_sketch.in_order(docs.limit(0), "doc_id", parts).count() == 0


def test_likeness_follows_edits(spark):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    means = []
    for share in (0.0005, 0.01, 0.05):
        found = []
        for _ in range(30):
            x = text(4000)
            y = list(x)
            for _ in range(int(4000 * share)):
                i = rng.randrange(len(y))
                y[i : i + 1] = rng.choice(["", "z", y[i] + "q"])
            found.append(edit_sketch.likeness_of(edit_sketch.fingerprint_of(x), edit_sketch.fingerprint_of("".join(y))))
        means.append(sum(found) / len(found))
    assert means[0] > 0.9 > means[1] > means[2]
    assert edit_sketch.likeness_of("", "") == 1.0 and edit_sketch.likeness_of("", edit_sketch.fingerprint_of("a")) == 0.0
    assert edit_sketch.fingerprint_of(None) == "" and edit_sketch.likeness_of(*map(edit_sketch.fingerprint_of, ("ab", "ab"))) == 1.0
    bases = [text(3000) for _ in range(20)]
    docs = [(i, b) for i, b in enumerate(bases)] + [(100 + i, b[:1500] + "!" + b[1500:]) for i, b in enumerate(bases)] + [(200 + i, b) for i, b in enumerate(bases[:5])]
    pairs = edit_sketch.near(table(spark, docs + EDGES))
    found = {tuple(sorted((r["a"], r["b"]))): r["likeness"] for r in pairs.collect()}
    true = {(i, 100 + i) for i, b in enumerate(bases) if edit_sketch.likeness_of(*(edit_sketch.fingerprint_of(t) for t in (b, b[:1500] + "!" + b[1500:]))) >= 0.8}
    assert set(found) == true and len(true) >= 15 and edit_sketch.near(table(spark, EDGES).limit(0)).count() == 0


# 13: resampling


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected_13(docs, target, most, buckets, least, share):
    def grams(text):
        w = brute_words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    s, t = ([0] * buckets, [0] * buckets)
    for texts, into in ((docs, s), (target, t)):
        for _, text in texts:
            for b in grams(text):
                into[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for key, text in docs:
        g = grams(text)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        out.append((key, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(brute_words(text)) >= least))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks: dict = {}
    for i, r in enumerate(fit[: len(fit) * share[0] // share[1]]):
        ranks.setdefault(r[:4], []).append(i + 1)
    rows = []
    for r in out:
        mine = ranks.get(r[:4])
        rows.append((*r[:4], mine.pop() if mine else None))
    return sorted(rows, key=str)


@pytest.mark.parametrize(("most", "buckets", "parts"), [(1, 10_000, 5), (2, 97, 1), (3, 1_000, 50)])
def test_resampling_equals_brute_force(spark, most, buckets, parts):
    rng = random.Random(13)
    prose = lambda n: " ".join(rng.choice(["Alpha", "beta", "über", "x1", "gamma,"]) + str(rng.randrange(30)) for _ in range(n))
    docs = [(i, prose(rng.randrange(40))) for i in range(120)] + EDGES + [(5, "same words " * 15)] * 3
    target = [(i, prose(25)) for i in range(5)] + [(8, None)]
    got = resample.resampled(table(spark, docs), table(spark, target), most=most, buckets=buckets, share=(3, 10), parts=parts)
    assert sorted(map(tuple, got.collect()), key=str) == expected_13(docs, target, most, buckets, 20, (3, 10))


def test_op13_and_edges(spark):
    read = lambda t, k: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(k, "text").collect()]
    got = queries.op13_resample(spark, SF)
    assert sorted(map(tuple, got.collect()), key=str) == expected_13(read("documents", "doc_id"), read("benchmark", "item_id"), 1, 10_000, 20, (10, 100))
    empty = table(spark, EDGES).limit(0)
    assert resample.resampled(empty, empty).count() == 0
    none = resample.resampled(table(spark, EDGES), empty)
    assert none.count() == len(EDGES) and none.where("n_features = 0 and (weight <> 0 or rank is not null)").count() == 0
    assert resample.counts(table(spark, EDGES)).agg(F.sum("n")).first()[0] == sum(len(brute_words(t)) for _, t in EDGES)
