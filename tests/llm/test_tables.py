"""Operators on pages, embeddings and conversations, and the registered queries."""

import gzip
import hashlib
import io
import random

import numpy as np
from pyspark.sql import functions as F

from gleanery.llm import ann, chat, queries, url_filter, warc

SF = "/root/testdata/sf0.001"


# 3: urls


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    n = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, after = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
    n = min([i for i in (after.find(c) for c in "?#") if i >= 0], default=len(after))
    path = after[:n]
    fits = [h + p for h, p, _ in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_rules_equal_brute_force(spark):
    urls = ["http://A.Example.COM/en/x?y#z", "http://example.com/en/", "http://www.example.com/en/1", "https://x.net/es/", "https://x.net/de/", "net/fr/", None, "", "a://", "http://com", "http://com/", "http://notexample.com/en/", "http://h?q://x/", "http://h#://", "http://İ.net/fr/#", "http://x\ny.net/fr/a\nb"]
    pages = spark.createDataFrame([(i, u, "<title>casino bets</title>", "v") for i, u in enumerate(urls)] + [(None, "http://x.org/", None, "v")], "page_id long, url string, html string, verdict string")
    verdicts = {h + p: v for h, p, v in url_filter.RULES}
    for r in url_filter.judged(pages).where("page_id is not null").collect():
        host, path, rule = brute_url(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdicts[rule] if rule else r["verdict"] in ("allow", "block")
    assert url_filter.judged(pages.limit(0)).count() == 0


def test_names_are_split_and_bad_hosts_blocked(spark):
    rows = [(i, f"http://m.{h}.org/en/{i}", f"<title>{t}</title>") for i, (h, t) in enumerate([("freecasinobets", "casino bets"), ("schoollibrary", "school library news"), ("cheap-pills", "pills"), ("newsblog", "blog")] * 5)]
    got = {r["host"]: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert "h:free h:casino h:bets" in got["m.freecasinobets.org"]["tokens"] and got["m.freecasinobets.org"]["verdict"] == "block"
    assert "h:school h:library" in got["m.schoollibrary.org"]["tokens"] and got["m.schoollibrary.org"]["verdict"] == "allow"
    assert got["m.cheap-pills.org"]["verdict"] == "block"


def test_rare_words_and_tokens_count_whatever_the_size_of_the_model(spark):
    rows = [(i, f"http://m.{h}.org/en/{i}/{p}?{i}", f"<title>{t}</title>") for i, (h, p, t) in enumerate([("freecasinobets", "casino", "casino bets"), ("schoollibrary", "Kelvin\u212a", "school library news"), ("newsblog", "", "blog")] * 5)]
    rows += [(90, "http://zebraquokka.org/", "<title>zebra quokka</title>"), (91, "http://m.newsblog.org/en/2/?2", ""), (92, None, ""), (92, "http://x.net/es/" + "zebra" * 400, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = [sorted(map(tuple, url_filter.judged(pages, **options).collect()), key=str) for options in ({}, {"vocabulary": 3}, {"vocabulary": 0})]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    assert [r[6] for r in found[0] if r[0] == 90] == ["h:zebra h:quokka h:org"]
    model = url_filter.fit(pages, vocabulary=3)
    assert url_filter.fit(pages)["totals"] == model["totals"] and model["totals"][2] == model["sums"].count()
    assert sorted(map(tuple, url_filter.judged(pages, model).collect()), key=str) == found[0]


# 7: neighbours


def test_search_recall_and_edges(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((10, 32))
    x = (centres[rng.integers(0, 10, 3000)] + 0.7 * rng.standard_normal((3000, 32))).astype(np.float32)
    x[500] = x[100]
    x[700] = x[100]
    odd = [(5001, None), (5002, [0.0] * 32), (5003, [1.0, None] * 16), (5100, [float("nan")] * 32), (5004, [float("inf")] * 32), (5005, [1.0] * 3), (None, [1.0] * 32), (5006, [])]
    rows = [(i, [float(v) for v in x[i]], "r") for i in range(3000)] + [(i, v, "r") for i, v in odd]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string").repartition(3)
    got = ann.search(vectors).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 3000, 100))
    hits = 0
    for q, found in by.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-12 for _, v, s in found)
        assert [v for _, v, _ in found] == sorted((v for _, v, _ in found), key=lambda v: (d[v], v))
        hits += len(set(best.tolist()) & {v for _, v, _ in found})
    assert hits >= 0.9 * 10 * len(by)
    assert [v for _, v, _ in by[100]][:2] == [500, 700]
    few = ann.search(vectors.where("vec_id < 3 or vec_id = 100"))
    assert few.where("query_id = 0").count() == 3 and ann.search(vectors.limit(0)).count() == 0


# 8: archives


def test_archives_round_trip(spark, tmp_path):
    long = "<p>é\r\n\r\nWARC/1.1\r\n" + "x" * 200
    rows = [(3, "http://a/\r\nX: y", long), (1, "u", long), (1, "u", long), (2, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", long), (7, "u", "y" * 100), (8, "u", "y" * 100)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "w")
    got = sorted(warc.archived(pages, path, file_bytes=900).collect(), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    expected = []
    for page, _, html in rows:
        n = len((html or "").encode())
        same = [p for p, _, h in rows if h == html and p is not None]
        refers = min(same) if n >= 100 and same and page != min(same) else None
        expected.append((page, n, sha(html), "revisit" if refers is not None else "response", refers))
    assert sorted((tuple(r) for r in got), key=str) == sorted(expected, key=str)
    records = [x for f in (tmp_path / "w").glob("*.gz") for x in warc.parse(io.BytesIO(gzip.decompress(f.read_bytes())))]
    assert len(records) == len(rows) and all(h["WARC-Record-ID"].startswith("<urn:uuid:") for h, _ in records)
    assert {h["WARC-Refers-To"] for h, _ in records if h["WARC-Type"] == "revisit"} <= {h["WARC-Record-ID"] for h, _ in records if h["WARC-Type"] == "response"}
    assert warc.archived(pages.limit(0)).count() == 0


# 10: conversations


def test_every_path_and_the_best(spark):
    rows = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 3.0), ("t", 4, 3, 0.0), ("t", 5, 3, 5.0), ("u", 1, 99, 1.0), ("c", 1, 2, 1.0), ("c", 2, 1, 1.0)]
    rows += [("long", i, i - 1 if i else None, 0.5) for i in range(70)]
    messages = spark.createDataFrame([(*r, "user" if r[1] % 2 else "assistant", f"m{r[1]}") for r in rows], "tree string, id long, parent long, score double, role string, text string")
    path = lambda best: {(r["tree"], r["leaf"]): r["ids"] for r in chat.chosen_paths(messages, best).groupBy("tree", "leaf").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "id"))), lambda x: x["id"]), ",").alias("ids")).collect()}
    assert path(9) == {("t", 2): "1,2", ("t", 4): "1,3,4", ("t", 5): "1,3,5", ("u", 1): "1", ("long", 69): ",".join(map(str, range(70)))}
    assert set(path(1)) == {("t", 5), ("u", 1), ("long", 69)}
    out = {r["tree"]: r for r in chat.read_back(chat.reply_trees(messages)).collect()}
    assert [(t["role"], t["text"]) for t in out["t"]["turns"]] == [("user", "m1"), ("user", "m3"), ("user", "m5")] and out["long"]["loss"].startswith("m0m2")


def test_round_trip_of_control_strings(spark):
    rng = random.Random(6)
    alphabet = ["<|im_start|>", "<|im_end|>\n", "</s>", "[INST]", "[/INST]", "\\", "\n", "<", "|", "é", "\U0001f600", "assistant", "%0A", "<<SYS>>", "$1"]
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "sys%\ntem<|im_start|>", None]), rng.choice([None, "", "".join(rng.choice(alphabet) for _ in range(12))])))
    rows += [(None, 1, "user", "a"), (None, None, "assistant", "b"), (70, 1, "user", "same"), (70, 1, "user", "same")]
    given = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, id string")
    got = {r["tree"]: r for r in chat.read_back(chat.reply_trees(chat.as_messages(given))).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        r = got["" if c is None else str(c)]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in mine]
        assert r["loss"] == "".join(x[3] or "" for x in mine if x[2] == "assistant")
        for m, x in zip(r["mask"], mine):
            own = r["formatted"][m["start"] : m["end"]]
            assert own == "" if x[2] != "assistant" else len(own) >= len(x[3] or "")
    assert chat.reply_trees(chat.as_messages(given.limit(0))).count() == 0


def test_registered(spark):
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
    rows = queries.op10_chat(spark, SF)
    probe = rows.where("conv_id = -1").first()
    assert probe["n_turns"] == 2 and probe["loss_chars"] == len("</s>[INST] ok [/INST]") and probe["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
    assert set(queries.oracle_sql()) <= set(queries.queries())
