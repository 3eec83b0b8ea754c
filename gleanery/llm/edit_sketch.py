"""Fingerprints that keep edit distance: a randomised embedding, sampled.

A walk reads a text's characters from the first on. At each step it writes what it
stands on, and shared random bits, one for each step and character, say whether it
moves on. Two walks that part at an edit come together again after a number of
steps that depends on the size of the edit, so texts at a small edit distance write
strings at a small Hamming distance (and others don't). A fingerprint holds samples
of the written string: the first 64 steps, then 32 steps of each octave (64 to 127,
128 to 255 and so on), so texts of any lengths are compared where both have steps.
A sample is six bits of a hash: of the character that the walk writes among the first
64, of the four characters from its place on beyond them, as single characters are
often equal by chance.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, part_of, quantiles

PERIOD = 4096  #: steps after which the shared bits come again
BASE, OCTAVE = 64, 32  #: samples of the first steps and of each octave after them
BAND = 6  #: samples of a band
LETTERS = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_", np.uint8)
NONE = ord(".")  #: a sample after the walk's end


@functools.cache
def moves() -> list[bytes]:
    """For each class of characters and step: how many steps until the walk has moved on."""
    out = []
    for c in range(256):
        data = b"".join(hashlib.sha256(b"walk:%d:%d" % (c, k)).digest() for k in range(PERIOD // 256))
        go = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))
        go = np.append(go, go[0] + PERIOD)
        steps = np.arange(PERIOD)
        out.append((go[np.searchsorted(go, steps)] - steps + 1).astype(np.uint8).tobytes())
    return out


@functools.cache
def octave(k: int) -> np.ndarray:
    """The sampled steps of octave ``k`` (from 64 * 2**k on), in an order that a hash gives."""
    first = BASE << k
    share = first // OCTAVE  # one step of each 32nd part
    picks = [int.from_bytes(hashlib.sha256(b"step:%d:%d" % (k, i)).digest()[:8]) % share for i in range(OCTAVE)]
    order = sorted(range(OCTAVE), key=lambda i: hashlib.sha256(b"order:%d:%d" % (k, i)).digest())
    return np.array([first + i * share + picks[i] for i in order], np.int64)


def fingerprint_of(text: str | None) -> str:
    """The fingerprint of one text; empty for null and empty texts."""
    if not text:
        return ""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    classes = points.astype(np.uint8) if text.isascii() else np.where(points < 128, points, 128 + (points * np.uint32(2654435761) >> np.uint32(25))).astype(np.uint8)
    step, steps, table, mask = 0, [], moves(), PERIOD - 1
    add = steps.append
    for c in classes.tobytes():
        add(step)
        step += table[c][step & mask]
    parts, k = [np.arange(BASE)], 0
    while BASE << k < step:
        parts.append(octave(k))
        k += 1
    sampled = np.concatenate(parts)
    at = np.searchsorted(np.array(steps), sampled, side="right") - 1
    padded = np.concatenate((points, np.zeros(4, np.uint32))).astype(np.uint64)
    mixed = np.zeros(len(at), np.uint64)
    for i in range(4):
        wide = padded[at + i] if i == 0 else np.where(np.arange(len(at)) < BASE, 0, padded[at + i])
        mixed = (mixed + wide + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    out = LETTERS[(mixed >> np.uint64(40)) & np.uint64(63)].copy()
    out[sampled >= step] = NONE
    return out.tobytes().decode()


@functools.cache
def weights(n: int) -> np.ndarray:
    """How many steps each of the first ``n`` samples stands for."""
    octaves = [np.full(OCTAVE, float((BASE << k) // OCTAVE)) for k in range(max(0, (n - BASE) // OCTAVE))]
    return np.concatenate([np.ones(BASE), *octaves])[:n]


def likeness_of(a: str | None, b: str | None) -> float:
    """The share of steps, of those that either walk has, at which both wrote the same."""
    a, b = a or "", b or ""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    x, y = (np.frombuffer(s.ljust(n, ".").encode(), np.uint8) for s in (a, b))
    w = weights(n)
    there = (x != NONE) | (y != NONE)
    return float(w[there & (x == y)].sum() / w[there].sum())


@F.pandas_udf(T.StringType())
def fingerprint(text: pd.Series) -> pd.Series:
    """Fingerprints of a column of texts."""
    return text.map(fingerprint_of)


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """The likeness, from 0 to 1, of two columns of fingerprints."""
    return pd.Series([likeness_of(x, y) for x, y in zip(a, b)], dtype="float64")


def bands(print_: Column, octaves: int = 3) -> Column:
    """Bit-sampled bands of a fingerprint: groups of six samples of its last full octaves.

    The last octave may be cut short by the text's end, so the ``octaves`` before it
    are taken; of shorter texts the first steps.
    """
    n = F.char_length(print_)
    full = F.floor((n - BASE) / OCTAVE) - 1  # octaves before the last
    start = F.when(full >= 1, BASE + OCTAVE * F.greatest(full - octaves, F.lit(0))).otherwise(F.lit(0))
    stop = F.when(full >= 1, BASE + OCTAVE * full).otherwise(F.least(n, F.lit(BASE)))
    places = F.sequence(F.lit(0), F.greatest(F.floor((stop - start) / BAND).cast("int") - 1, F.lit(0)))
    return F.when(n > 0, F.transform(places, lambda i: F.concat_ws(":", start + i * BAND, F.substring(print_, (start + i * BAND + 1).cast("int"), F.lit(BAND)))))


def near(docs: DataFrame, key: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """``a``, ``b``, ``likeness``: texts, by their smallest keys, and the text of a common band that they resemble.

    Equal texts are one; each text is held against the first text (by digest) of each
    of its bands, so a band that a third of all texts share costs one pair a text. Pairs
    at a likeness of 0.8 share one of 15 bands with a probability of 0.99. Null and
    empty texts have no bands; an empty table gives no rows.
    """
    texts = docs.where("text is not null").select(F.col(key).alias("k"), F.sha2("text", 256).alias("digest"), fingerprint("text").alias("print"))
    texts = texts.groupBy("digest").agg(F.min("k").alias("k"), F.first("print").alias("print"))
    banded = texts.select("digest", "k", "print", F.explode(bands(F.col("print"))).alias("band"))
    heads = banded.groupBy("band").agg(F.min(F.struct("digest", "k", "print")).alias("head"), F.count("*").alias("n")).where("n > 1")
    pairs = banded.join(heads, "band").where("digest != head.digest").groupBy("digest", F.col("head.digest").alias("other")).agg(F.first("k").alias("a"), F.first("head.k").alias("b"), F.first("print").alias("x"), F.first("head.print").alias("y"))
    return pairs.select("a", "b", likeness("x", "y").alias("likeness")).where(F.col("likeness") >= threshold)


def in_order(docs: DataFrame, key: str, parts: int) -> DataFrame:
    """``docs`` (without a column ``next``) and ``next``: the row that follows by descending ``key``, after the last one the first.

    Rows of equal keys follow each other by their texts, null keys come last. The keys are cut
    into about ``parts`` ranges; each is ordered by itself, with the rows of the first key
    of the range after it, so no task orders all rows.
    """
    docs = docs.drop("next")
    names = docs.columns
    cuts = quantiles(docs.select(key), key, parts)
    ranges = docs.select(part_of(cuts, F.col(key)).alias("part"), key).groupBy("part").agg(F.max(key).alias("first")).orderBy(F.desc("part")).collect()  # a row for each range
    goes = {r["first"]: ranges[i - 1]["part"] for i, r in enumerate(ranges)}  # the range that needs this key's rows too
    firsts = np.array(sorted(k for k in goes if k is not None), np.int64)
    before = np.array([goes[k] for k in firsts.tolist()], np.int32)
    null_goes = goes.get(None)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def parts_of(values: pd.Series) -> pd.Series:
        known = values.fillna(0).to_numpy(np.int64)
        own = np.searchsorted(cuts, known, side="right")
        at = np.minimum(np.searchsorted(firsts, known), max(len(firsts) - 1, 0))
        out = []
        for x, null, part, i in zip(known, values.isna(), own, at):
            if null:
                out.append([-1] if null_goes is None else [-1, null_goes])
            else:
                out.append([int(part), int(before[i])] if firsts[i] == x else [int(part)])
        return pd.Series(out)

    part, guest = free(names, "part"), free(names, "guest")
    placed = docs.select("*", F.posexplode(parts_of(F.col(key))).alias(guest, part))
    order = Window.partitionBy(part).orderBy(guest, F.col(key).desc_nulls_last(), "text")
    after = F.struct(*[F.lead(c).over(order).alias(c) for c in names])
    return placed.withColumn("next", after).where(F.col(guest) == 0).select(*names, "next")


def spliced(text: Column, following: Column) -> Column:
    """``text`` whose last half (rounded down) is replaced by as many characters of ``following``, or all it has."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))
