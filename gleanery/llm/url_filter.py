"""URL filter: rules first, then segmented host words scored by naive Bayes.

Host names are split into words by the Viterbi path of a unigram model whose
counts come from the titles and urls of all pages. Multinomial naive Bayes over
the segmented words of host and path decides where no rule does; it is trained
on all urls, those whose host holds a seed word being taken as bad.

Cases: null urls and those without "://" have an empty host and path and no
words, which the prior decides (allowed); repeated rows are judged alike. The
model has all words and tokens, as stored tables. Tables of at most ``vocabulary``
words (twice as many tokens) are broadcast and urls judged one by one, so a host
that holds a third of the rows needs no shuffle; beyond that the words and weights
of distinct urls are joined, with equal results.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# The rules as (host, path, verdict) and the seed words.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
BAD_WORDS = ("casino", "bet", "bets", "poker", "jackpot", "pill", "pills", "viagra", "porn", "xxx", "adult", "escort", "loan", "loans", "ads", "track", "tracker", "malware", "warez", "torrent")
GOOD_WORDS = ("news", "blog", "wiki", "school", "university", "library", "docs", "help", "free", "cheap", "win", "online", "shop", "best", "the", "and")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST = 24


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, empty without a scheme."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.lit(2**31 - 1))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.lit(2**31 - 1)), "^([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def unigrams(pages: DataFrame) -> DataFrame:
    """Counts of all words of titles and urls: w, n."""
    title = F.regexp_extract(F.coalesce(F.col("html"), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1) if "html" in pages.columns else F.lit("")
    text = F.lower(F.concat_ws(" ", title, F.coalesce("url", F.lit(""))))
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit("[a-z]{2,24}"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    # Host names themselves must not become words: what is to be split is only known from titles and paths.
    host, _ = parts(F.col("url"))
    labels = pages.select(F.explode(F.regexp_extract_all(host, F.lit("[a-z]{2,24}"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("h"))
    own = stored(words.join(labels, "w", "left").select("w", (F.col("n") - F.coalesce("h", F.lit(0))).alias("n")).where("n > 0"), "own")
    most = own.agg(F.max("n")).first()[0] or 1
    seeds = pages.sparkSession.createDataFrame([(w, most // 4 + 1) for w in sorted({*BAD_WORDS, *GOOD_WORDS})], "w string, n long")
    return stored(own.unionByName(seeds).groupBy("w").agg(F.max("n").alias("n")), "unigrams")


class Segmenter:
    """Viterbi segmentation under a unigram model; unknown words cost by length."""

    def __init__(self, counts: dict[str, int], total: int):
        self.total = total
        self.cost = self.costs(counts)
        self.unknown, self.seen = math.log(self.total) + 2.0, {}

    def costs(self, counts: dict[str, int]) -> dict[str, float]:
        return {w: -math.log(n / self.total) for w, n in counts.items()}

    def word(self, text: str, own: dict[str, int] | None = None) -> list[str]:
        """The words of a run; ``own`` holds counts that the model lacks."""
        costs = ChainMap(self.costs(own), self.cost) if own else self.cost
        best, back = [0.0], [0]
        for end in range(1, len(text) + 1):
            options = []
            for start in range(max(0, end - LONGEST), end):
                w = text[start:end]
                options.append((best[start] + costs.get(w, self.unknown + 2.5 * len(w)), -start))
            cost, start = min(options)
            best.append(cost)
            back.append(-start)
        out, end = [], len(text)
        while end:
            out.append(text[back[end] : end])
            end = back[end]
        return out[::-1]

    def words(self, text: str) -> list[str]:
        if text not in self.seen:
            if len(self.seen) >= 200_000:
                self.seen.clear()
            self.seen[text] = [w for run in re.findall("[a-z]+", text) for w in self.word(run)]
        return self.seen[text]

    def tokens(self, host: str, path: str) -> list[str]:
        return tokens(host, path, self.words)


def tokens(host: str, path: str, words: Callable[[str], list[str]]) -> list[str]:
    """h:word of the host, p:word of the path, whose numbers are one word."""
    in_path = [w for run in re.findall("[a-z]+|[0-9]+", path.lower()) for w in (["0"] if run[0].isdigit() else words(run))]
    return [f"h:{w}" for w in words(host)] + [f"p:{w}" for w in in_path]


def weight(good: int, bad: int, good_sum: int, bad_sum: int, size: int) -> float:
    return math.log((bad + 0.1) / (bad_sum + 0.1 * size)) - math.log((good + 0.1) / (good_sum + 0.1 * size))


def attached(rows: DataFrame, keys: Column, pairs: DataFrame, often: int) -> DataFrame:
    """``rows`` (distinct host, path) with ``found``, the map of their keys to values in ``pairs`` (key, value, n).

    The ``often`` most frequent pairs are broadcast, so that the rest can be joined without a hot key.
    """
    top = stored(pairs.orderBy(F.desc("n"), "key").limit(often).select("key", "value"), "top")
    asked = rows.select("host", "path", F.explode(F.array_distinct(keys)).alias("key"))
    rest = pairs.select("key", "value").join(F.broadcast(top.select("key")), "key", "left_anti")
    met = asked.join(F.broadcast(top), "key").unionByName(asked.join(F.broadcast(top.select("key")), "key", "left_anti").join(rest, "key"))
    return rows.join(met.groupBy("host", "path").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("found")), ["host", "path"], "left")


def segmented(runs: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """key, value, n of distinct runs (key, n): their words, joined by blanks.

    Words of up to three letters, 18,278 at most, are broadcast; the longer parts
    of a run are joined to the counts.
    """
    short = runs.sparkSession.sparkContext.broadcast({r["w"]: r["n"] for r in counts.where("length(w) <= 3").collect()})

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at in range(0, len(key) - 3, 1000):  # batches stay small, however long the run is
                    subs = {key[k : k + n] for k in range(at, min(at + 1000, len(key) - 3)) for n in range(4, min(LONGEST, len(key) - k) + 1)}
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(subs), pa.string()), pa.array(list(subs), pa.string())], names=["id", "w"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Segmenter(short.value, total)
        for batch in batches:
            values = [" ".join(model.word(key, dict(own or ()))) for key, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.string()), batch.column(1)], names=["key", "value", "n"])

    runs = runs.withColumn("id", F.sha2("key", 256))
    known = runs.select("id", "key").mapInArrow(substrings, "id string, w string").distinct().join(counts, "w").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("own"))
    return runs.join(known, "id", "left").select("key", "n", "own").mapInArrow(split, "key string, value string, n long")


def split_urls(urls: DataFrame, counts: DataFrame, total: int, often: int) -> DataFrame:
    """host, path, tokens and n of the distinct ``urls``, by joins."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [list(dict.fromkeys(re.findall("[a-z]+", h) + re.findall("[a-z]+", p.lower()))) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, pa.list_(pa.string()))], names=["host", "path", "n", "runs"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, p, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                words = dict(found or ())
                out.append(tokens(h, p, lambda text: [w for run in re.findall("[a-z]+", text) for w in words[run].split(" ")]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.string()))], names=["host", "path", "n", "tokens"])

    rows = stored(urls.groupBy("host", "path").agg(F.count("*").alias("n")).mapInArrow(listed, "host string, path string, n long, runs array<string>"), "urls")
    runs = rows.select(F.explode("runs").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    pairs = stored(segmented(runs, counts, total), "runs")
    return stored(attached(rows, F.col("runs"), pairs, often).select("host", "path", "n", "found").mapInArrow(joined, "host string, path string, n long, tokens array<string>"), "split")


def fit(pages: DataFrame, *, vocabulary: int = 50_000, rules=RULES) -> dict:
    """Unigram counts and naive Bayes weights from all pages.

    ``counts`` (w, n) and ``sums`` (t, good, bad) are tables; ``split`` has the
    tokens of these pages' distinct urls where the counts are too many to be broadcast.
    """
    counts = unigrams(pages)
    size, total = counts.agg(F.count("*"), F.sum("n")).first()
    host, path = parts(F.col("url"))
    urls = pages.select(host.alias("host"), path.alias("path"))
    bad = frozenset(f"h:{w}" for w in BAD_WORDS)
    split = None
    if size <= vocabulary:
        sent = pages.sparkSession.sparkContext.broadcast({r["w"]: r["n"] for r in counts.collect()})

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            split, sums = Segmenter(sent.value, total), {}
            for batch in batches:
                for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    tokens = split.tokens(h, p)
                    c = int(not bad.isdisjoint(tokens))
                    for t in (*tokens, ""):
                        sums.setdefault(t, [0, 0])[c] += 1
                    if len(sums) > 500_000:
                        yield batch_of(sums)
                        sums = {}
            yield batch_of(sums)

        def batch_of(sums: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1] for x in sums.values()], pa.int64())], names=["t", "good", "bad"])

        found = urls.mapInArrow(count, "t string, good long, bad long")
    else:
        split = split_urls(urls, counts, total, vocabulary)
        is_bad = F.arrays_overlap("tokens", F.array(*[F.lit(t) for t in sorted(bad)]))
        found = split.select(F.explode(F.concat("tokens", F.array(F.lit("")))).alias("t"), F.when(is_bad, 0).otherwise(F.col("n")).alias("good"), F.when(is_bad, F.col("n")).otherwise(0).alias("bad"))
    summed = stored(found.groupBy("t").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "sums")
    sums = summed.where("t != ''")
    good_sum, bad_sum, kinds = sums.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0)), F.count("*")).first()
    good_urls, bad_urls = (summed.where("t = ''").select("good", "bad").first() or (0, 0))
    return {"counts": counts, "words": size, "total": total, "split": split, "sums": sums, "tokens": kinds, "totals": (good_sum, bad_sum, kinds or 1), "bias": math.log((bad_urls + 1) / (good_urls + 1)), "rules": rules, "vocabulary": vocabulary}


def judged(pages: DataFrame, model: dict | None = None, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, and the method's score and words."""
    split = None if model else (model := fit(pages, **options))["split"]
    host, path = parts(F.col("url"))
    rule, verdict = ruled(host, path, model["rules"])
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("ruled"))
    most, totals, bias = model["vocabulary"], model["totals"], model["bias"]
    if model["words"] > most or model["tokens"] > 2 * most:
        split = split or split_urls(urls.select("host", "path"), model["counts"], model["total"], most)
        scored = _scored(split, model)
        final = F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow"))
        return urls.join(scored, ["host", "path"]).select("page_id", "host", "path", "rule", final.alias("verdict"), "score", "tokens")
    counts = {r["w"]: r["n"] for r in model["counts"].collect()}
    weights = {r["t"]: weight(r["good"], r["bad"], *totals) for r in model["sums"].collect()}
    sent, total = pages.sparkSession.sparkContext.broadcast((counts, weights)), model["total"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, weights = Segmenter(sent.value[0], total), sent.value[1]
        for batch in batches:
            scores, texts, verdicts = [], [], []
            for h, p, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                tokens = split.tokens(h, p)
                scores.append(bias + sum(weights.get(t, 0.0) for t in tokens))
                texts.append(" ".join(tokens))
                verdicts.append(v or ("block" if scores[-1] > 0 else "allow"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdicts), pa.array(scores, pa.float64()), pa.array(texts)], names=["page_id", "host", "path", "rule", "verdict", "score", "tokens"])

    return urls.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, score double, tokens string")


def _scored(split: DataFrame, model: dict) -> DataFrame:
    """host, path, score and tokens of distinct urls (host, path, n, tokens), by joins."""
    totals, bias = model["totals"], model["bias"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([weight(g, b, *totals) for g, b in sums], pa.float64()), pa.array([g + b for g, b in sums], pa.int64())], names=["key", "value", "n"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, texts = [], []
            for tokens, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                weights = dict(found or ())
                scores.append(bias + sum(weights.get(t, 0.0) for t in tokens))
                texts.append(" ".join(tokens))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores, pa.float64()), pa.array(texts, pa.string())], names=["host", "path", "score", "tokens"])

    weights = stored(model["sums"].select("t", "good", "bad").mapInArrow(weigh, "key string, value double, n long"), "weights")
    return stored(attached(split, F.col("tokens"), weights, model["vocabulary"]).select("host", "path", "tokens", "found").mapInArrow(score, "host string, path string, score double, tokens string"), "scored")
