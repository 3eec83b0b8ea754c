"""Text operators against brute force and on edge rows."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gleanery.llm import decontaminate, mixing, near_dedup, pii, quality, suffix_dedup
from gleanery.llm.common import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, items string, key string, at string"


def docs_of(spark, texts):
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "k", "i", "k", "a") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of", "and", "zebra", "ümlaut", "x1"]) + str(rng.randrange(60)) for _ in range(n))


EDGES = [(900, None), (901, ""), (902, "   \n"), (903, "one"), (903, "one"), (None, "null id, two of these"), (None, "null id, two of these"), (904, "z" * 3000), (905, "\u2028 \u0085 a\u00a0b Ünïcode \U0001f600 text")]


# 1: personal data


def brute_spans(text):
    out = []

    def luhn(d):
        s = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            s += v - 9 * (v > 9)
        return s % 10 == 0

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    for k, (name, (pattern, good)) in enumerate(rules.items()):
        out += [(m.start(), k, m.end(), name) for m in re.finditer(pattern, text) if good(m.group())]
    return sorted(out)


PRIVATE = [
    "mail a.b+c@x.example.com, or x@y.z_q@e.f and a@b@c.d.e",
    "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 and 010.0.0.255 and 00000000000000000001.2.3.4",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111111111111111 2",
    "\U0001f600 phone +1 (017) 555-7713. +44 20 7946 0958 and +12 and +1-2-3-4-5-6-7-8-9)",
    "token = \"908038b7daaf91e730d2f64001c52934d43d\" and john (at) example (dot) com and 123-45-6789",
    "@" * 500 + "a" * 500 + "@b.c",
    "9 " * 400,
]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    texts = PRIVATE + ["".join(rng.choice("a1.@+- (_5é") for _ in range(rng.randrange(1, 120))) for _ in range(400)] + ["1234" * 5000 + "@a.b"]
    got = pii.spans(docs_of(spark, list(enumerate(texts)) + EDGES)).collect()
    names = (*pii.KINDS, "secret")
    assert len(got) == len(texts) + len(EDGES)
    for r in got:
        expected = [f"{n}:{a}:{b}" for a, _, b, n in brute_spans(r["text"] or "")]
        assert [f"{names[x['kind']]}:{x['start']}:{x['end']}" for x in r["base"]] == expected, r["text"]
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))


def test_method_adds_secrets_and_redaction_marks_them(spark):
    rng = random.Random(1)
    texts = [f"{prose(rng, 20)} token = \"{''.join(rng.choice('0123456789abcdef') for _ in range(36))}\" {prose(rng, 5)}" for _ in range(60)]
    texts += [f"{prose(rng, 20)} on 2024-01-02 page 1234567 see {prose(rng, 4)}" for _ in range(60)]
    out = pii.redacted(docs_of(spark, list(enumerate(texts + PRIVATE[:2])) + EDGES)).orderBy("doc_id").collect()
    by = {r["doc_id"]: r for r in out}
    assert all("<SECRET>" in by[i]["text"] and "token" in by[i]["text"] for i in range(60))
    assert all(by[i]["text"] == texts[i] for i in range(60, 120))
    assert by[120]["text"].startswith("mail <EMAIL>, or ") and by[900]["text"] is None and by[901]["text"] == ""
    assert by[120]["n_chars"] == len(by[120]["text"])


def test_long_secrets_are_one_span(spark):
    rng = random.Random(2)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (36, 200, 201, 450, 5000)]
    keys += [k[:150] + "x4111111111111111x" + k[150:] for k in keys if len(k) > 200]
    texts = [f"{prose(rng, 20)} token = \"{k}\" {prose(rng, 5)}" for k in keys]
    every = {"weights": [0.0] * pii.BUCKETS, "bias": 1.0}
    out = {r["doc_id"]: r["text"] for r in pii.redacted(docs_of(spark, list(enumerate(texts))), every).collect()}
    assert [out[i] for i in range(len(keys))] == [t.replace(k, "<SECRET>") for t, k in zip(texts, keys)]


def test_private_empty_table(spark):
    assert pii.redacted(docs_of(spark, [])).count() == 0


def test_redaction_returns_columns_of_any_name(spark):
    docs = docs_of(spark, [(1, "mail a@b.co now"), (2, "x " * 400_000 + "a@b.co")]).withColumns({"base": F.lit("b"), "spans": F.lit(3)})
    rows = {r["doc_id"]: r for r in pii.redacted(docs).collect()}
    assert rows[1]["text"] == "mail <EMAIL> now" and (rows[1]["base"], rows[1]["spans"]) == ("b", 3) and rows[2]["text"].endswith(" <EMAIL>")


def test_long_obfuscated_parts_and_digits_are_whole(spark):
    local, number = "a" * 300, "1 " * 200 + "1"
    texts = [f"x {local} [at] {'d' * 90} [dot] example [dot] co [dot] uk end", f"n {number} end"]
    every = {"weights": [0.0] * pii.BUCKETS, "bias": 1.0}
    out = {r["doc_id"]: r["text"] for r in pii.redacted(docs_of(spark, list(enumerate(texts))), every).collect()}
    assert out[0] == "x <EMAIL> end" and out[1] == "n <CARD> end"


# 2: decontamination


def brute_hits(text, items, window=13):
    w = words((text or "").encode())
    hit, found = set(), set()
    for item, t in items:
        iw = words(t.encode())
        n = min(window, len(iw))
        grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if iw else set()
        for i in range(len(w) - n + 1) if n else []:
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), found


def test_one_automaton_at_a_time_and_clashing_names(spark):
    rng = random.Random(15)
    bench = spark.createDataFrame([(i, prose(rng, 40)) for i in range(20)] + [(None, "x"), (30, None), (31, "")], "item_id long, text string")
    texts = [(i, prose(rng, 50)) for i in range(10)] + [(20 + i, prose(rng, 5) + " " + r["text"]) for i, r in enumerate(bench.where("length(text) > 9").collect())]
    docs = docs_of(spark, texts + EDGES).withColumns({"n_hit": F.lit("a"), "Longest": F.lit("b"), "n_words": F.lit(1), "contaminated": F.lit("c")})
    nodes = lambda df: df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    few, many = (decontaminate.judged(docs, bench, block_words=w) for w in (1_000_000, 100))
    assert nodes(few) == nodes(many) == 1 and len(decontaminate.blocks(bench, 100)) > 5
    key = lambda df: sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"], r["items"])) for r in df.collect())
    assert key(few) == key(many) and few.where("contaminated").count() == 20
    left = decontaminate.remove_spans(docs, bench, block_words=100)
    assert left.columns == docs.columns and {r["n_hit"] for r in left.collect()} == {"a"} and left.count() == 10 + len(EDGES)
    assert decontaminate.judged(docs.limit(0), bench).count() == 0 and decontaminate.judged(docs, bench.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("block_words", [1_000_000, 60, 8])
def test_windows_equal_brute_force(spark, block_words):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "Ü", "e5"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 9, 12, 13, 14, 20, 40])))) for i in range(1, 40) if i % 7] + [(50, ""), (51, " . "), (2, "a b c Ü e5 e5 a")]
    texts = []
    for i in range(120):
        t = [rng.choice([*vocabulary, "unknown"]) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            t[at:at] = rng.choice(items)[1].upper().replace("Ü", "Ü").split()
        texts.append((i, " ".join(t)))
    bench = spark.createDataFrame([*items, (None, "a b"), (60, None)], "item_id long, text string")
    got = decontaminate.judged(docs_of(spark, texts + EDGES), bench, block_words=block_words).collect()
    assert len(got) == len(texts) + len(EDGES)
    for r in got:
        n, hit, found = brute_hits(r["text"], items)
        assert (r["n_words"], r["n_hit"], set(r["items"])) == (n, hit, found), r["text"]
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_spans_are_cut(spark):
    bench = spark.createDataFrame([(1, "q w e r t y u i o p a s d f")], "item_id long, text string")
    docs = docs_of(spark, [(1, "Before, Q w e r t y u i o p a s d F! After."), (2, "clean text")])
    got = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench, coverage=0).collect()}
    assert got == {1: "Before, ! After.", 2: "clean text"}
    assert [r["doc_id"] for r in decontaminate.remove_spans(docs, bench).collect()] == [2]
    assert decontaminate.remove_spans(docs, bench.limit(0)).count() == 2
    assert decontaminate.remove_spans(docs.limit(0), bench).count() == 0


def test_coverage_is_exact_and_long_texts_stream(spark):
    bench = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(13))), (2, "solo")], "item_id long, text string")
    passage = " ".join(f"q{i}" for i in range(13))
    docs = docs_of(spark, [(1, passage + " x" * 28), (2, passage + " x" * 31), (3, "x " * 300_000 + passage), (4, "Solo"), (4, "Solo")])
    got = {r["doc_id"]: r for r in decontaminate.judged(docs, bench, coverage=0.3).collect()}
    assert [got[i]["contaminated"] for i in (1, 2, 3, 4)] == [True, False, False, True]
    assert got[3]["n_hit"] == 13 and got[3]["n_words"] == 300_013 and got[4]["items"] == ["2"]


def test_no_window_is_left_in_the_texts_that_stay(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, 40)) for i in range(5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, [(i, prose(rng, 900) + " " + items[i % 5][1].upper() + ". " + prose(rng, 300)) for i in range(20)])
    left = decontaminate.remove_spans(docs, bench)
    assert left.count() == 20 and decontaminate.judged(left, bench).agg(F.sum("n_hit")).first()[0] == 0


def test_long_spans_are_cut_from_documents_that_stay(spark):
    passage = " ".join(f"q{i}" for i in range(40))
    bench = spark.createDataFrame([(1, passage), (2, "Short Item")], "item_id long, text string")
    long, short = ["w " * 500 + end for end in (f"<{passage.upper()}>", "a short item.")]
    rows = {r["doc_id"]: r for r in decontaminate.remove_spans(docs_of(spark, [(1, long + " w" * 500), (2, short), (3, None)]), bench).collect()}
    assert rows[1]["text"] == "w " * 500 + "<>" + " w" * 500 and rows[1]["n_chars"] == len(rows[1]["text"])
    assert rows[2]["text"] == short and rows[3]["text"] is None


# 4: quality


def test_classifier_rejects_junk_and_learns_words(spark):
    rng = random.Random(9)
    good = ["the of and " + prose(rng, 60) + " to the in" * 5 for _ in range(300)]
    toxic = [g[: len(g) // 2] + " grmblfx " + g[len(g) // 2 :] for g in good[:60]]
    junk = [" ".join(w + "###" for w in prose(rng, 40).split()) for _ in range(60)]
    texts = good + toxic + junk
    labels = [(i, 0 if i >= 360 else 1, 1 if 300 <= i < 360 else 0) for i in range(420) if i % 3]
    got = quality.classify(docs_of(spark, list(enumerate(texts)) + EDGES), spark.createDataFrame(labels + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int"))
    rows = {r["doc_id"]: r["keep"] for r in got.select("doc_id", "keep").collect()}
    kept = [rows[i] for i in range(420)]
    assert sum(kept[:300]) >= 297 and sum(kept[300:360]) <= 1 and sum(kept[360:]) <= 1  # the unlabelled third too
    assert not rows[900] and not rows[901] and got.count() == 420 + len(EDGES)


def test_em_equals_row_by_row_em():
    """Every document on its own, with arrays, against the counts of patterns; and the truth that made the votes."""
    import numpy as np

    rng = np.random.default_rng(3)
    n, k = 6000, 4
    kind = rng.choice(k + 1, n, p=[0.7, 0.1, 0.1, 0.07, 0.03])  # 0: good, i + 1: bad in the way of labeller i
    against = rng.random((n, k)) < np.where(kind[:, None] == np.arange(1, k + 1), 0.95, 0.02)
    votes = np.where(against, quality.BAD, np.where(rng.random((n, k)) < 0.7, quality.GOOD, quality.NONE))
    marks = np.where(rng.random(n) < 0.1, np.where(kind > 0, quality.BAD, quality.GOOD), quality.NONE)
    patterns, marked = {}, {}
    for v, m in zip(map(tuple, votes.tolist()), marks.tolist()):
        patterns[v] = patterns.get(v, 0) + 1
        marked[v, m] = marked.get((v, m), 0) + 1
    posterior, rates = quality.em(patterns, marked, rounds=7)
    by = np.zeros((n, k + 1))
    hit = votes == quality.BAD
    by[:, 1:] = np.where((marks == quality.BAD)[:, None] & hit, 1 / np.maximum(hit.sum(1, keepdims=True), 1), 0.0)
    by[:, 0] = marks == quality.GOOD
    by[:, 1:][:, by[:, 1:].sum(0) < quality.SEEDS] = 0
    expect = lambda c, i: quality.EXPECTED["good" if c == 0 else "own" if c == i + 1 else "other"]
    for _ in range(7):
        share = by.sum(0) / by.sum()
        like = np.ones((n, k + 1)) * share
        for c in range(k + 1):
            for i in range(k):
                r = {v: ((by[:, c] * (votes[:, i] == v)).sum() + quality.START * expect(c, i)[v]) / (by[:, c].sum() + quality.START) for v in (quality.BAD, quality.GOOD)}
                like[:, c] *= np.select([votes[:, i] == v for v in r], list(r.values()), 1 - sum(r.values()))
        free = like / like.sum(1, keepdims=True)
        by = free.copy()
        by[marks == quality.GOOD] = np.eye(k + 1)[0]
        by[marks == quality.BAD, 0] = 0
        by /= by.sum(1, keepdims=True)
    by = free
    assert max(abs(posterior[tuple(v)] - x) for v, x in zip(votes.tolist(), 1 - by[:, 0])) < 1e-9
    right = np.array([(posterior[tuple(v)] > 0.5) == (c > 0) for v, c in zip(votes.tolist(), kind.tolist())])
    assert right.mean() > 0.92 and abs(rates[0][1][quality.BAD] - 0.95) < 0.06
    # Marks start the estimation and decide no pattern: most of the marks of a pattern may be wrong.
    few, _ = quality.em({(1, 1): 5000, (-1, 1): 400, (1, -1): 300}, {((1, 1), quality.GOOD): 10, ((1, 1), quality.BAD): 15, ((-1, 1), quality.BAD): 30, ((1, -1), quality.BAD): 30})
    assert few[1, 1] < 0.2 < 0.9 < few[-1, 1] and few[1, -1] > 0.9
    for only in (quality.BAD, quality.GOOD):
        one, _ = quality.em({(1, 1): 5000, (-1, -1): 400}, {((1, 1) if only == quality.GOOD else (-1, -1), only): 50})
        assert one[1, 1] < 0.1 < 0.9 < one[-1, -1]


def test_scorer_equals_brute_force(spark):
    """The weights of the model from the sums of posteriors over documents, feature by feature."""
    import numpy as np

    rng = random.Random(8)
    texts = ["the of and to in is " + prose(rng, 30) for _ in range(200)] + [" ".join(f"{w}###" for w in prose(rng, 25).split()) + " zzjunk" for _ in range(80)]
    model = quality.fit(docs_of(spark, list(enumerate(texts))), None, evidence=20.0)
    votes = [(*quality.vote(t.encode(), words(t.encode())), quality.NONE) for t in texts]
    counts: dict = {}
    for v in votes:
        counts[v] = counts.get(v, 0) + 1
    posterior, _ = quality.em(counts, {})
    q = np.array([posterior[v] for v in votes])
    features = [{x for w in set(words(t.encode())) for x in quality._bucket(w, model["buckets"])} | set(quality._vote_features(v, model["buckets"])) for t, v in zip(texts, votes)]
    bad, good = q.sum(), (1 - q).sum()
    expected = {}
    for f in set().union(*features):
        at = np.array([f in x for x in features])
        b, g = q[at].sum(), (1 - q)[at].sum()
        w = math.log((b + 0.5) / (bad + 1)) - math.log((g + 0.5) / (good + 1))
        part = (bad + 1) / (bad + good + 2)
        g2 = 2 * (b * math.log((b + 1e-9) / ((b + g) * part)) + g * math.log((g + 1e-9) / ((b + g) * (1 - part))))
        if w > 3.5 and g2 > (10 if f >= model["buckets"] else 20.0):
            expected[f] = w
    assert set(model["weights"]) == set(expected) and len(expected) > 3
    assert all(abs(model["weights"][f] - w) < 1e-6 for f, w in expected.items()) and abs(model["bias"] - math.log((bad + 1) / (good + 1))) < 1e-9


def test_scores_keep_columns_and_ties(spark):
    text = "the of and to in is that it was " * 5
    docs = docs_of(spark, [(1, text), (1, text), (None, text), (2, None), (3, "the " * 200_000)]).withColumn("_keep", F.lit(7))
    rows = quality.classify(docs, None, ("_score", "_keep")).collect()
    assert len(rows) == 5 and {r["keep"] for r in rows} == {"k"} and len({r["_score"] for r in rows if r["text"] == text}) == 1
    assert [r["_keep"] for r in rows if r["doc_id"] == 2] == [False]


def test_classifier_without_labels_or_rows(spark):
    docs = docs_of(spark, [*[(i, "the of and to in is that it was " * 5) for i in range(1, 9)], (9, "### " * 50), (10, "#$% & | " * 50)])
    assert {r["doc_id"]: r["keep"] for r in quality.classify(docs, None).collect()} == {i: i < 9 for i in range(1, 11)}
    assert quality.classify(docs.limit(0), None).count() == 0


# 5: repeated strings


def brute_removed(texts):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d, x in enumerate(data):
        for i in range(len(x) - 399):
            seen.setdefault(x[i : i + 400], []).append((d, i))
    gone = [bytearray(len(x)) for x in data]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + 400] = b"\1" * 400
    out = []
    for x, g in zip(data, gone):
        kept = bytes(c for c, y in zip(x, g) if not y)
        out.append((len(x), sum(g), len(re.findall(b"\1+", bytes(g))), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)

    def noise(n):
        return "".join(rng.choice("abcdefgh éß\n") for _ in range(n))

    shared = [noise(n) for n in (399, 400, 401, 450, 700, 1500, 3000, 130)]
    texts = []
    for i in range(60):
        t = noise(rng.randrange(300))
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 4 + 1) if rng.random() < 0.5 else 0
            t += s[a:] + noise(rng.choice([0, 1, 30, 300]))
        texts.append(t)
    texts += [texts[0], texts[0], shared[5], "ab" * 700, "z" * 1200, noise(390), "x" * 400, noise(5000)]
    texts.append(texts[-1][100:2100])
    texts = [(i, t) for i, t in enumerate(texts)] + EDGES
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    got = {(r["doc_id"], r["kept_sha256"]): r for r in suffix_dedup.deduplicated(docs_of(spark, texts)).collect()}
    for (i, _), (n, removed, runs, sha) in zip(texts, brute_removed([t for _, t in texts])):
        r = got[i, sha]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (n, removed, runs)
    assert suffix_dedup.deduplicated(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("chunk", [500, 4096])
def test_anchors_do_not_depend_on_pieces(chunk, monkeypatch):
    import numpy as np

    data = random.Random(2).randbytes(9000)
    whole = [np.concatenate(x) for x in zip(*suffix_dedup.anchors(data))]
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    for a, b in zip(whole, [np.concatenate(x) for x in zip(*suffix_dedup.anchors(data))]):
        assert (a[whole[4]] == b[whole[4]]).all()


def test_common_periodic_stretch_does_not_crowd_one_key(spark, monkeypatch):
    rng = random.Random(7)

    def noise(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    lines = ["z" * 1500, "ab" * 900, (noise(37) + "\n") * 40, noise(30) * 20]
    texts = [noise(rng.randrange(200, 500)) + line * rng.randrange(1, 3) + noise(300) for line in lines for _ in range(8)]
    texts += ["z" * 400, "z" * 401, noise(50) + "z" * 700, "z" * 5000 + noise(450), "y" * 400 + noise(90)]
    tables, write = {}, suffix_dedup.stored

    def kept(df, name):
        tables[name] = write(df, name)
        return tables[name]

    monkeypatch.setattr(suffix_dedup, "stored", kept)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 900)
    got = {r["doc_id"]: r for r in suffix_dedup.deduplicated(docs_of(spark, list(enumerate(texts)))).collect()}
    for i, want in enumerate(brute_removed(texts)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want
    # A stretch gives a row for each piece of a text that it reaches, not one for each of its bytes.
    most = tables["shared"].where("around is not null").groupBy("around", "check").count().agg(F.max("count")).first()[0]
    assert most <= 6 * len(texts)
    # Representatives are written before they are joined by gram: no more than one for each surrounding.
    assert tables["ones"].count() == tables["shared"].where("around is not null").join(tables["ones"], ["key", "at"], "left_semi").select("around", "check").distinct().count()


def test_equal_identifiers_of_different_bytes_remove_nothing(spark, monkeypatch):
    import numpy as np

    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdef ") for _ in range(900)) for _ in range(4)]
    texts.append(texts[0][:500] + "".join(rng.choice("abcdef ") for _ in range(300)))
    rows = list(enumerate(texts))
    code = compile("def refine(a, b):\n    return a * 0 + 1\n", "x", "exec")  # every string has one identifier
    space = {}
    exec(code, space)
    data = texts[0].encode()
    ids, checks = suffix_dedup.strings(data, np.arange(0, 400), 400)
    monkeypatch.setattr(suffix_dedup, "refine", space["refine"])
    same, checked = suffix_dedup.strings(data, np.arange(0, 400), 400)
    assert len(set(same.tolist())) == 1 and (checked == checks).all() and len(set(checks.tolist())) == 400 == len(set(ids.tolist()))
    monkeypatch.undo()
    got = {r["doc_id"]: r for r in suffix_dedup.deduplicated(docs_of(spark, rows)).collect()}
    assert [got[i]["n_removed"] for i in range(5)] == [500, 0, 0, 0, 500] and got[0]["spans"] == "0:500" and got[1]["spans"] == ""


# 6: mixing


def test_raking_meets_marginals(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(1, 40)) + (" @" if i % 5 == 0 else ""), rng.choice(["en", "de", None]), rng.choice(["a"] * 6 + ["b", "c", None]), 0) for i in range(600)]
    docs = spark.createDataFrame(rows + [(900, None, "en", "a", 0), (901, "", None, None, 0)], "doc_id long, text string, lang string, source string, copies int")
    known = mixing.measured(docs)
    cells = known.groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic")).agg(F.sum("__tokens").alias("tokens"))
    out = mixing.raked(cells, rounds=30)
    for d in mixing.DIMENSIONS:
        for r in out.groupBy(d).agg(F.sum("weight").alias("w"), F.max(f"goal_{d}").alias("g")).collect():
            assert abs(r["w"] - r["g"]) < 1e-3 * max(1, r["g"])
    drawn = mixing.sampled(docs)
    total, expected = known.agg(F.sum("__tokens")).first()[0], drawn.agg(F.sum(F.col("__tokens") * F.col("copies"))).first()[0]
    assert abs(expected / total - mixing.BUDGET) < 0.1
    assert drawn.where("doc_id >= 900").count() == 0
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.where("doc_id >= 900")).count() == 0  # rows, but no tokens


def test_mixing_keeps_columns_and_draws_repeats_alike(spark):
    rows = [(i % 50, "word " * (1 + i % 50) if i else "long " * 300_000, "en", "a", i, "r") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __tokens long, row string")
    out = mixing.mixed(docs).collect()
    assert out and {r["row"] for r in out} == {"r"} and len({r["__tokens"] for r in out}) == len(out)
    drawn = {r["__tokens"] for r in out}
    assert all((i in drawn) == (i + 50 in drawn) for i in range(1, 50))


# 9: near duplicates


def jaccard_classes(texts, least=0.8):
    sets = []
    for t in texts:
        w = words((t or "").encode())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_classes_equal_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(25):
        base = prose(rng, rng.choice([3, 12, 60, 150, 400])).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            w = list(base)
            for _ in range(max(0, int(len(w) * rng.choice([0, 0.005, 0.01, 0.06])))):
                w[rng.randrange(len(w))] = "edited"
            texts.append(" ".join(w).upper() + "!")
    got = near_dedup.classes(docs_of(spark, list(enumerate(texts)) + EDGES))
    rows = {r["doc_id"]: r["class_id"] for r in got.where("doc_id < 900").collect()}
    expected = jaccard_classes(texts)
    mine = [rows[i] for i in range(len(texts))]
    ours = {(i, j) for i in range(len(texts)) for j in range(i) if mine[i] == mine[j]}
    theirs = {(i, j) for i in range(len(texts)) for j in range(i) if expected[i] == expected[j]}
    assert ours <= theirs and len(ours) >= 0.99 * len(theirs)
    assert {r["class_size"] for r in got.where("doc_id = 903").collect()} == {2}
    kept = near_dedup.deduplicated(docs_of(spark, list(enumerate(texts)) + EDGES))
    assert kept.where("doc_id < 900").count() == len(set(mine)) and kept.where("doc_id is null").count() == 1
    assert near_dedup.deduplicated(docs_of(spark, [])).count() == 0


def test_one_document_of_each_class_stays_whatever_the_ids(spark):
    rng = random.Random(4)
    a, b, c = [prose(rng, 80) for _ in range(3)]
    rows = [(1, a), (1, b), (1, b), (2, a + " end"), (None, c), (None, c + " end"), (None, a + " more")]
    kept = near_dedup.deduplicated(docs_of(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"][:40]) for r in kept) == sorted([(1, a[:40]), (1, b[:40]), (0, c[:40])])


def test_long_copies_are_one_class(spark):
    rng = random.Random(12)
    base = prose(rng, 5000).split()
    edited = list(base)
    for i in range(0, 5000, 250):
        edited[i] = "edited"
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, prose(rng, 5000)), (4, "the the the " * 3000), (5, "the the the " * 3100)]
    docs = docs_of(spark, rows).withColumns({"uid": F.lit("u"), "th": F.lit(1)})
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    kept = near_dedup.deduplicated(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4] and {(r["uid"], r["th"]) for r in kept} == {("u", 1)}


def test_signature_estimates_weighted_jaccard():
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    wa, wb = rng.uniform(0.2, 4, len(x)), rng.uniform(0.2, 4, len(x))
    k = 2048
    a, b = near_dedup.dart_minhash(x, k, wa), near_dedup.dart_minhash(x, k, wb)
    assert abs((a == b).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.05
    s, t = near_dedup.dart_minhash(x[:200], k), near_dedup.dart_minhash(x[50:250], k)
    assert abs((s == t).mean() - 150 / 250) < 0.05


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(bytes([0, i]), bytes([0, i + 1])) for i in range(40)] + [(b"\x01\x02", b"\x01\x01")], "a binary, b binary")
    got = near_dedup.components(edges).collect()
    assert {bytes(r["root"]) for r in got if r["key"][0] == 0} == {b"\0\0"} and len(got) == 43


def test_parities_never_rule_out_more_than_the_sets_differ():
    import numpy as np

    rng = np.random.default_rng(5)
    for n, k in ((1, 0), (60, 3), (400, 90), (5000, 800)):
        x = rng.integers(-(2**63), 2**63, n + k)
        a, b = x[:n], x[k:]
        bits = sum(int(v).bit_count() for v in (near_dedup.parities(a) ^ near_dedup.parities(b)).view(np.uint64))
        assert bits <= len(set(a.tolist()) ^ set(b.tolist())) and (k == 0) == (bits == 0)
    assert not near_dedup.parities(x[:0]).any()
