"""Exact repeated strings by bucket-pointer refinement.

A bucket identifier stands for the string of some depth at a position. The
buckets of 8 bytes are the bytes themselves; those of twice the depth come from
the identifier at the position and the one at a later offset, and are reused for
the next depth: 8, 16, ... 256. An identifier of 400 bytes refines the one of 256
with the one of 256 at offset 144.

Not every position is kept. Of the 273 positions in a window of 400 bytes at
which 128 bytes still fit, the one with the smallest identifier is the window's
anchor; equal windows have equal anchors. In a periodic stretch neighbouring anchors
have equal surroundings: all are covered by each other, and the first stands for
them, so a line repeated many times is one row. Between documents only anchors are
sorted into buckets, and buckets are refined in four steps, each dropping what is
alone: by 128 bytes; by all 672 bytes around the anchor (if these repeat, all are
covered at once, and one anchor stands for the others); by the eight strings of
366 bytes of which one lies inside any repeated window; by the 400 bytes, first
at both ends of what such a string leaves open, then between them.

All steps are counts by identifier, summed before the shuffle; what is counted is
written before it is joined, so the rows of a common string are split among tasks.
Equal texts share a key and are read once. Identifiers have 64 bits. What decides
about a removal is compared by its bytes as well: strings are taken as equal if
identifier and a second, independent 64-bit digest of their bytes are.

Cases: null is the empty text; strings shorter than 400 bytes are never removed;
repeated rows are documents of their own, so their texts go from 400 bytes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

LENGTH, GRAM, STEPS = 400, 128, 8
FREE = LENGTH - GRAM  # 272, bytes of a window beside its anchor
PIECE = FREE // STEPS  # 34
CORE = LENGTH - PIECE  # 366
CHUNK = 1 << 18

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def refine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifiers of the strings that a and b stand for together."""
    x = a * _K[0]
    x ^= x >> np.uint64(29)
    x += b
    x *= _K[1]
    x ^= x >> np.uint64(32)
    return x


def buckets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of depth 128 and 256 at each position of some bytes."""
    x = data.astype(np.uint64)
    for depth in (1, 2, 4):
        x = x[:-depth] | (x[depth:] << np.uint64(8 * depth))
    for depth in (8, 16, 32, 64):
        x = refine(x[:-depth], x[depth:])
    return x, refine(x[:-GRAM], x[GRAM:]) if len(x) > GRAM else x[:0]


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every ``width`` values in a row, by doubling."""
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def checks(data: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """Digests of the bytes of the strings at ``starts``."""
    view = memoryview(data)
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a : a + length]) for a in starts.tolist()), np.uint64, len(starts))


def anchors(data: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Places, 128-byte identifiers, 672-byte identifiers and digests, whether those exist.

    Long texts are taken in pieces that overlap, so memory doesn't grow with them.
    """
    n = len(data)
    everything = np.frombuffer(data, np.uint8)
    for low in range(0, n - GRAM + 1 if n >= LENGTH else 0, CHUNK):
        high = min(low + CHUNK, n - GRAM + 1)
        start = max(0, low - FREE)
        part = everything[start : min(n, high - 1 + LENGTH)]
        gram, double = buckets(part)
        least = _slide(gram, FREE + 1, np.minimum)
        pad = np.zeros(FREE, np.uint64)
        at = np.flatnonzero(_slide(np.concatenate((pad, least, pad)), FREE + 1, np.maximum) == gram)
        at = at[(at + start >= low) & (at + start < high)]
        whole = (at + start >= FREE) & (at + start + LENGTH <= n)
        inside = np.where(whole, at, FREE if len(double) > FREE + 144 else 0)
        if len(double) > FREE + 144:
            full = refine(refine(double[inside - FREE], double[inside - 16]), double[inside + 144])
        else:
            full = np.zeros(len(at), np.uint64)
        check = np.zeros(len(at), np.uint64)
        check[whole] = checks(data, at[whole] + start - FREE, FREE + LENGTH)
        yield at + start, gram[at], full, check, whole


def chains(full: np.ndarray, check: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last of neighbouring anchors whose 672 bytes are equal."""
    same = whole[1:] & whole[:-1] & (full[1:] == full[:-1]) & (check[1:] == check[:-1])
    return np.flatnonzero(np.append(True, ~same)[: len(full)]), np.flatnonzero(np.append(~same, True)[: len(full)])


def strings(data: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers and digests of the strings of 366 or 400 bytes at sorted ``starts``."""
    out, everything = [], np.frombuffer(data, np.uint8)
    for low in range(0, len(data), CHUNK):
        at = starts[(starts >= low) & (starts < low + CHUNK)]
        if len(at):
            begin = int(at[0])
            _, double = buckets(everything[begin : int(at[-1]) + length])
            out.append(refine(double[at - begin], double[at - begin + length - 2 * GRAM]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), checks(data, starts, length)


def _place(*columns: str) -> Column:
    return F.xxhash64(*columns)


def _several(rows: DataFrame, place: Column, *by: str, chain: Column | bool = False) -> DataFrame:
    """The values of ``by`` found at two places at least, with one of them; a row that is a ``chain`` stands for several."""
    return stored(rows.groupBy(*by).agg(F.min(place).alias("one"), F.max(place).alias("other"), F.max(F.lit(chain)).alias("chain")).where("chain or one != other").drop("other", "chain"), "several")


def _repeated(rows: DataFrame, place: Column, *by: str) -> DataFrame:
    """The rows whose values of ``by`` are found at two places at least."""
    return rows.join(_several(rows, place, *by).select(*by), [*by], "left_semi").select(*rows.columns)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(text, 256)
    return docs.select("doc_id", F.unhex(F.substring(digest, 1, 32)).alias("key"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), text.cast("binary").alias("data"))


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, doc, data) of documents with repeats, and (doc, spans) of what repeats."""
    texts = keyed(docs).where(F.col("n_bytes") >= LENGTH).select("key", "data")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at, *rest in anchors(data):
                    first, last = chains(*rest[1:])
                    found.append((at[first], at[last] - at[first], *(x[first] for x in rest)))
                    keys += [key] * len(first)
            if keys:
                at, more, gram, full, check, whole = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(at), pa.array(more), pa.array(gram.view(np.int64)), pa.array(full.view(np.int64), mask=~whole), pa.array(check.view(np.int64), mask=~whole)], names=["key", "at", "more", "gram", "around", "check"])

    every = stored(texts.mapInArrow(scan, "key binary, at long, more long, gram long, around long, check long"), "anchors")
    grams = _several(every.select("gram", _place("key", "at").alias("p"), "more"), F.col("p"), "gram", chain=F.col("more") > 0).select("gram")
    some = stored(every.join(grams, "gram").dropDuplicates(["key", "at"]), "shared")
    around = _several(some.where("around is not null"), _place("key", "at"), "around", "check", chain=F.col("more") > 0).select("around", "check", "one")
    # Anchors near an end of their text have no 672 bytes; as nulls they would all meet in one task of the join.
    edge = some.where("around is null").withColumn("one", F.lit(None).cast("long"))
    marked = some.where("around is not null").join(around, ["around", "check"], "left").unionByName(edge)
    covered = marked.where("one is not null").select("key", F.struct((F.col("at") - FREE).alias("a"), (F.col("at") + F.col("more") + LENGTH).alias("b")).alias("span"))
    edges = marked.where("one is null").select("key", "at", "gram")
    # Written, or Spark moves the join by gram before the one by surroundings, where a common gram meets in one task.
    ones = stored(marked.where(F.col("one") == _place("key", "at")).select("key", "at", "gram"), "ones").join(edges.select("gram").distinct(), "gram", "left_semi").select("key", "at", "gram")
    wanted = edges.unionByName(ones).select("key", "at").unionByName(covered.select("key", F.lit(None).cast("long").alias("at")).distinct())
    places = wanted.groupBy("key").agg(F.collect_set("at").alias("at"))
    subset = stored(texts.join(places, "key").dropDuplicates(["key"]).withColumn("doc", F.xxhash64("key")), "subset")

    def emit(starts_of, length: int):
        """Rows (doc, at, id, check) for the starts that ``starts_of`` makes of the other columns."""

        def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for doc, data, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                    starts = np.unique(starts_of(*(np.array(x or (), np.int64) for x in rest)))
                    starts = starts[(starts >= 0) & (starts + length <= len(data))]
                    if len(starts):
                        found = strings(data, starts, length)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), doc)), pa.array(starts), *(pa.array(x.view(np.int64)) for x in found)], names=["doc", "at", "id", "check"])

        return emitted

    form, place, texts_of = "doc long, at long, id long, check long", _place("doc", "at"), subset.select("doc", "data")
    cores = stored(subset.select("doc", "data", "at").mapInArrow(emit(lambda at: (at[:, None] - PIECE * np.arange(STEPS)).ravel(), CORE), form), "cores")
    cells = stored(_repeated(cores, place, "id", "check"), "cells")
    # The windows at both ends of a cell; where they repeat, those between cover nothing more.
    starts = cells.groupBy("doc").agg(F.collect_set("at").alias("s"))
    ends = stored(texts_of.join(starts, "doc").mapInArrow(emit(lambda s: np.concatenate((s, s - PIECE)), LENGTH), form), "ends")
    known = stored(_repeated(ends, place, "id", "check").select("doc", "at"), "known")
    both = cells.join(known.withColumn("right", F.lit(True)), ["doc", "at"], "left").join(known.select("doc", (F.col("at") + PIECE).alias("at"), F.lit(True).alias("left")), ["doc", "at"], "left")
    unclear = stored(both.where("right is null or left is null").select("id").distinct(), "unclear")
    inner = cells.join(unclear, "id", "left_semi").groupBy("doc").agg(F.collect_set("at").alias("s"))
    windows = stored(texts_of.join(inner, "doc").mapInArrow(emit(lambda s: (s[:, None] - np.arange(1, PIECE)).ravel(), LENGTH), form), "windows")
    found = known.unionByName(_repeated(windows, place, "id", "check").select("doc", "at"))
    spans = covered.select(F.xxhash64("key").alias("doc"), "span").unionByName(found.select("doc", F.struct(F.col("at").alias("a"), (F.col("at") + LENGTH).alias("b")).alias("span")))
    return subset.select("key", "doc", "data"), spans.groupBy("doc").agg(F.collect_set("span").alias("spans"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and
    ``spans``, the removed runs as start:end in bytes, comma-joined."""
    subset, spans = repeats(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, data, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ends = np.zeros(len(data) + 1, np.int64)
                pairs = found.values
                np.add.at(ends, pairs.field("a").to_numpy(), 1)
                np.add.at(ends, pairs.field("b").to_numpy(), -1)
                gone = np.cumsum(ends[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])).astype(np.int8)))
                runs = edges.reshape(-1, 2).tolist()
                out.append({"key": key, "removed": int(gone.sum()), "runs": len(runs), "kept": hashlib.sha256(kept).hexdigest(), "cut": ",".join(f"{a}:{b}" for a, b in runs)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.binary()), ("removed", pa.int64()), ("runs", pa.int64()), ("kept", pa.string()), ("cut", pa.string())]))

    cuts = subset.join(spans, "doc").select("key", "data", "spans").mapInArrow(cut, "key binary, removed long, runs long, kept string, cut string")
    rows = keyed(docs).select("doc_id", "key", "digest", "n_bytes")
    copies = stored(rows.where(F.col("n_bytes") >= LENGTH).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "copies")
    told = stored(copies.select("key").withColumn("copied", F.lit(True)).join(cuts, "key", "full_outer"), "told")
    copied = F.coalesce("copied", F.lit(False))
    return rows.join(told, "key", "left").select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "digest")).alias("kept_sha256"),
        F.when(copied, F.concat(F.lit("0:"), F.col("n_bytes").cast("string"))).otherwise(F.coalesce("cut", F.lit(""))).alias("spans"),
    )
