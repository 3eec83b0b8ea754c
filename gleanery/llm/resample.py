"""Importance resampling towards a target corpus, by hashed n-grams of words.

Each worker numbers the words of a few MB of text and sorts the places of all
documents by the words from there on (a suffix array as deep as the longest n-gram).
Neighbours in that order that share n words or more are a run: one n-gram and all its
places. The n-gram is hashed once for its run, and its bucket is scattered back to
the places, which are then counted by bucket or summed by document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, part_of, quantiles, slices, stored, utf8, words

END = -1  #: stands after each document's words: no n-gram holds it


def suffix_order(w: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places by their first ``depth`` words, and how many of them each shares with the place before (at most ``depth``)."""
    ahead = [np.append(w[k:], np.full(min(k, len(w)), END, w.dtype)) for k in range(depth)]
    order = np.argsort(w, kind="stable") if depth == 1 else np.lexsort(ahead[::-1])
    shared, still = np.zeros(len(w), np.int64), np.ones(max(len(w) - 1, 0), bool)
    for column in ahead:
        still &= column[order[1:]] == column[order[:-1]]
        shared[1:] += still
    return order, shared


def bucketed(documents: list[list[bytes]], most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each n-gram occurrence its bucket and document, and the number of occurrences of each document."""
    known: dict[bytes, int] = {}
    sizes = np.array([len(d) for d in documents], np.int64)
    w = np.full(int(sizes.sum()) + len(documents), END, np.int64)
    stops = np.cumsum(sizes + 1) - 1  # where each document's END stands
    inside = np.ones(len(w), bool)
    inside[stops] = False
    w[inside] = np.fromiter((known.setdefault(x, len(known)) for d in documents for x in d), np.int64, int(sizes.sum()))
    named = list(known)
    owner = np.repeat(np.arange(len(documents)), sizes + 1)
    left = stops[owner] - np.arange(len(w))  # words from a place to its document's end
    order, shared = suffix_order(w, most)
    found, owners = [], []
    for n in range(1, most + 1):
        whole = left[order] >= n  # of places, in suffix order, from which n words stand in the document
        first = whole & (shared < n)
        first[1:] |= whole[1:] & ~whole[:-1]
        at = order[first]
        hashes = np.fromiter((zlib.crc32(b" ".join([named[i] for i in w[a : a + n].tolist()])) % buckets for a in at.tolist()), np.int64, len(at))
        run = np.cumsum(first) - 1
        found.append(hashes[run[whole]])
        owners.append(owner[order[whole]])
    each = sum(np.maximum(sizes - n + 1, 0) for n in range(1, most + 1))
    return np.concatenate(found), np.concatenate(owners), each


def counts(docs: DataFrame, *, most: int = 1, buckets: int = 10_000) -> DataFrame:
    """``bucket``, ``n``: how many n-gram occurrences of all texts fall in each bucket.

    A task returns a row for each bucket at most. Null, empty and blank texts have none.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, 0):
            found, _, _ = bucketed([words(x) for x in utf8(batch.column(0))], most, buckets)
            total += np.bincount(found, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["bucket", "n"])

    return docs.select("text").mapInArrow(counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, *, most: int = 1, buckets: int = 10_000) -> DataFrame:
    """``bucket``, ``gain``: a thousand times the log ratio of a bucket's shares in the target and in the documents, rounded down.

    Each count has one added, each total the number of buckets.
    """
    s, t = (counts(x, most=most, buckets=buckets) for x in (docs, target))
    all_buckets = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = all_buckets.join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)).cast("double") / ((F.col("s") + 1) * (F.col("all_t") + buckets)).cast("double")
    return both.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))  # totals: one row


def weighed(docs: DataFrame, gained: DataFrame, key: str = "doc_id", *, most: int = 1, buckets: int = 10_000) -> DataFrame:
    """``key``, ``n_features``, ``weight``: the sum of the gains of a document's n-gram occurrences."""
    table = np.zeros(buckets, np.int64)
    for r in gained.collect():  # a row for each bucket
        table[r["bucket"]] = r["gain"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found, owners, each = bucketed([words(x) for x in utf8(batch.column(1))], most, buckets)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, owners, table[found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(each, pa.int64()), pa.array(total, pa.int64())], names=[key, "n_features", "weight"])

    given = docs.select(F.col(key), F.col("text").alias(free([key], "text")))
    return given.mapInArrow(summed, f"`{key}` {given.schema[0].dataType.simpleString()}, n_features bigint, weight bigint")


def gumbel(key: Column, seed: int) -> Column:
    """A thousand times a standard Gumbel draw, rounded down, told by the seed and the key; null counts as an empty key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, share: tuple[int, int], fits: Column, key: str = "doc_id", parts: int = 64) -> DataFrame:
    """``scored`` with ``rank``: place by descending ``score``, ties by ascending ``key``, of the first
    share (a fraction: numerator, denominator) of the rows that fit; null beyond.

    The scores are cut into ``parts`` ranges. Counts of the ranges say where each one's ranks
    begin, and only ranges that reach into the share are ordered, each by itself.
    """
    score = -F.col("score")
    eligible = scored.where(fits)
    cuts = quantiles(eligible.select(score.alias("low")), "low", parts)
    placed = scored.withColumn("part", F.when(fits, part_of(cuts, score)))
    sizes = sorted((r["part"], r["count"]) for r in placed.where("part is not null").groupBy("part").count().collect())  # a row for each range
    most = sum(n for _, n in sizes) * share[0] // share[1]
    before, starts = 0, []
    for part, n in sizes:
        if before < most:
            starts.append((part, before))
        before += n
    if not starts:
        return placed.drop("part").withColumn("rank", F.lit(None).cast("long"))
    begun = F.broadcast(scored.sparkSession.createDataFrame(starts, "part int, start long"))
    inside = placed.join(begun, "part")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("score"), F.asc_nulls_first(key))) + F.col("start")
    ranked = inside.withColumn("rank", F.when(rank <= most, rank).cast("long"))
    rest = placed.where(F.col("part").isNull() | (F.col("part") > starts[-1][0])).withColumn("rank", F.lit(None).cast("long"))
    return ranked.drop("part", "start").unionByName(rest.drop("part"))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", *, most: int = 1, buckets: int = 10_000, least: int = 20, share: tuple[int, int] = (10, 100), seed: int = 2024, parts: int = 64) -> DataFrame:
    """``key``, ``n_features``, ``weight``, ``score`` and ``rank`` for every row of ``docs``.

    Of the rows with at least ``least`` words ``share`` of them are drawn without replacement,
    in proportion to the exponent of their weights (a thousandth each): those with the
    highest sums of weight and Gumbel draw. Null, empty and blank texts have no features,
    weigh 0 and are not drawn; repeated rows count each; further columns are left out;
    without a target or without documents the counts are 0. ``rank`` is null if not drawn.
    """
    gained = gains(docs, target, most=most, buckets=buckets)
    scored = stored(weighed(docs, gained, key, most=most, buckets=buckets).withColumn("score", F.col("weight") + gumbel(F.col(key), seed)), "scored")
    # n words have n - k + 1 n-grams of k words, so ``least`` words have at least so many of all.
    features = sum(max(least - k + 1, 0) for k in range(1, most + 1))
    return drawn(scored, share, F.col("n_features") >= features, key, parts)
