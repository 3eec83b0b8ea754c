"""Full-text search over an inverted index with positions.

The index is two Parquet tables: postings (a row for each term and some hundreds of documents,
with the places where the term stands) in folders by a hash of the term and sorted by it, and the
documents' keys with the columns that filters need. A query reads the folders of its
terms only, never a text. Fields stand on one line of places with a gap between them, so
a phrase ends where its field ends.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.porter import STOP, stem
from gleanery.session import scratch

from . import filters

WORD = r"[\p{L}\p{N}]+"
#: What a word counts by the label of its field; the inverses are exact in binary.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
LABELS = "ABCD"

Phrase = tuple[tuple[int, str], ...]  #: (offset, term) of its words that are no stop words


@dataclass(frozen=True)
class Query:
    """Groups of phrases of which a document must hold one each, and phrases that it must not hold."""

    wanted: tuple[tuple[Phrase, ...], ...]
    banned: tuple[Phrase, ...]

    @property
    def phrases(self) -> list[Phrase]:
        return list(dict.fromkeys([p for g in self.wanted for p in g] + list(self.banned)))

    @property
    def terms(self) -> list[str]:
        return sorted({t for p in self.phrases for _, t in p})


def asked(query: str | None) -> Query:
    """A query in the language of search boxes: words are ANDed, quotes make phrases, "or" joins
    two of them, a minus excludes. Stop words hold their place in a phrase and match anything."""
    wanted: list[list[Phrase]] = []
    banned: list[Phrase] = []
    joined = False
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', (query or "").lower()):
        if word == "or" and not minus:
            joined = bool(wanted)
            continue
        parts = regex.findall(WORD, quoted or word)
        phrase = tuple((i, stem(p)) for i, p in enumerate(parts) if p not in STOP)
        phrase = tuple((i - phrase[0][0], t) for i, t in phrase)
        if not phrase:
            continue
        if minus:
            banned.append(phrase)
        elif joined:
            wanted[-1].append(phrase)
        else:
            wanted.append([phrase])
        joined = False
    return Query(tuple(map(tuple, wanted)), tuple(banned))


@dataclass
class Index:
    postings: DataFrame  #: bucket, term, keys, sizes, at, field
    documents: DataFrame  #: key and the columns kept
    key: str
    labels: list[str]  #: of the fields, by their numbers
    buckets: int


def bucket_of(term: Column, buckets: int) -> Column:
    return (F.crc32(term.cast("binary")) % buckets).cast("int")


def slices(batch: pa.RecordBatch, texts: list[int], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text, a row at least."""
    lengths = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype("int64") for c in texts)
    upto, low = np.cumsum(lengths), 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + size, "right")))
        yield batch.slice(low, high - low)
        low = high


def postings(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``term``, ``keys``, ``sizes``, ``at``, ``field``: a row for a term and some documents that hold it.

    ``at`` holds the places of each document in turn, ascending, ``sizes`` how many are each
    document's, ``field`` the places' fields by number.
    """
    given = docs.select(F.col(key).alias("key"), *[F.col(f) for f in fields])
    word = regex.compile(WORD)

    def chunk(part: pa.RecordBatch) -> pa.RecordBatch:
        words: list[str] = []
        counts: list[int] = []  # words by document and field
        for texts in zip(*(part.column(c).to_pylist() for c in range(1, part.num_columns))):
            for text in texts:
                found = word.findall(text.lower()) if text else []
                words += found
                counts.append(len(found))
        coded = pa.array(words, pa.string()).dictionary_encode()
        stems = [None if w in STOP else stem(w) for w in coded.dictionary.to_pylist()]
        names = {t: i for i, t in enumerate(dict.fromkeys(t for t in stems if t is not None))}
        of = np.array([-1 if t is None else names[t] for t in stems], "int32")
        terms = of[coded.indices.to_numpy()]
        n, width = np.array(counts, "int64"), part.num_columns - 1
        cell = np.repeat(np.arange(len(n)), n)
        before = np.cumsum(n) - n
        before = before - np.repeat(before[::width], width)  # words of the document's earlier fields
        row, number = cell // width, cell % width
        at = np.arange(len(terms)) - np.repeat(np.cumsum(n) - n, n) + before[cell] + number + 1  # a gap between fields
        order = np.argsort(terms, kind="stable")
        order = order[np.searchsorted(terms[order], 0) :]  # no stop words
        terms, row = terms[order], row[order]
        other = np.concatenate([[True], terms[1:] != terms[:-1]])[: len(terms)]
        pair = other | np.concatenate([[True], row[1:] != row[:-1]])[: len(terms)]
        starts = np.flatnonzero(pair)
        by_term = np.append(np.flatnonzero(other), len(terms)).astype("int32")
        by_pair = np.append(np.flatnonzero(other[starts]), len(starts)).astype("int32")
        lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets), values)
        sizes = np.diff(np.append(starts, len(terms))).astype("int32")
        columns = [pa.array(list(names), pa.string()), lists(by_pair, part.column(0).take(pa.array(row[starts]))), lists(by_pair, pa.array(sizes)), lists(by_term, pa.array(at[order].astype("int32"))), lists(by_term, pa.array(number[order].astype("int8")))]
        return pa.RecordBatch.from_arrays(columns, names=["term", "keys", "sizes", "at", "field"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, range(1, batch.num_columns)):
                yield chunk(part)

    kind = given.schema["key"].dataType.simpleString()
    return given.mapInArrow(listed, f"term string, keys array<{kind}>, sizes array<int>, at array<int>, field array<tinyint>")


def unpacked(rows: DataFrame) -> DataFrame:
    """``term``, ``key``, ``at``, ``field``: a row for each document of some rows of ``postings``."""

    def one_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of = {c: batch.column(c)[i].values for c in ("keys", "sizes", "at", "field")}
                ends = pa.array(np.concatenate([[0], np.cumsum(of["sizes"].to_numpy())]).astype("int32"))
                columns = [pa.repeat(batch.column("term")[i], len(of["keys"])), of["keys"], *[pa.ListArray.from_arrays(ends, of[c]) for c in ("at", "field")]]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "key", "at", "field"])

    kind = rows.schema["keys"].dataType.elementType.simpleString()
    return rows.select("term", "keys", "sizes", "at", "field").mapInArrow(one_each, f"term string, key {kind}, at array<int>, field array<tinyint>")


def build(docs: DataFrame, key: str, fields: dict[str, str], path: str, keep: list[str] = (), buckets: int = 64) -> Index:
    """Write the index of ``docs`` below ``path``. ``fields``: name to label, in their order.

    Keys are unique and not null. A bucket of a frequent term is split over tasks and files.
    """
    known, cores = docs.where(F.col(key).isNotNull()), docs.sparkSession.sparkContext.defaultParallelism
    # A small table may be one row group, which one task would index; it is dealt out first.
    dealt = known.repartition(cores) if known.rdd.getNumPartitions() < cores else known
    rows = postings(dealt, key, list(fields)).withColumn("bucket", bucket_of(F.col("term"), buckets))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    known.select(F.col(key).alias("key"), *keep).write.parquet(f"{path}/documents")
    spark = docs.sparkSession
    return Index(spark.read.schema(rows.schema).parquet(f"{path}/postings"), spark.read.parquet(f"{path}/documents"), key, list(fields.values()), buckets)


_kept: dict[tuple, Index] = {}


def identity(docs: DataFrame) -> tuple:
    """The files of a table with their sizes and times: another write gives another identity."""
    jvm, conf = docs.sparkSession._jvm, docs.sparkSession._jsc.hadoopConfiguration()
    out = []
    for name in sorted(docs.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def index(docs: DataFrame, key: str, fields: dict[str, str], keep: dict[str, Column] | None = None, name: str = "search") -> Index:
    """The index of a table read from files, built at the first call and used until the files change."""
    spark: SparkSession = docs.sparkSession
    known = (spark.sparkContext.applicationId, identity(docs), key, tuple(fields.items()), str(keep), name)
    if known not in _kept:
        _kept[known] = build(docs.withColumns(keep or {}), key, fields, scratch(spark, name), list(keep or {}))
    return _kept[known]


def cover_density(entries: list[tuple[int, int, float]], groups: int) -> float:
    """The rank of a document by its shortest covers: intervals that hold a hit of each group.

    ``entries``: place, group and inverse weight, in order. For each place that ends an
    interval the last hits of the groups say where the shortest one that ends here begins;
    it counts if it begins after the one before. A cover counts the number of its entries
    by the sum of their inverse weights, less the more other words it holds.
    """
    last: dict[int, tuple[int, int, float]] = {}
    begun, score, upto = -1, 0.0, 0.0
    for n, (at, group, inverse) in enumerate(entries, 1):
        last[group] = (n - 1, at, upto)
        upto += inverse
        if len(last) == groups:
            first, place, before = min(last.values())
            if first > begun:
                begun, count = first, n - first
                noise = at - place - (count - 1)
                score += count / (upto - before) / (1 + (noise if noise >= 0 else (count - 1) // 2))
    return score


def judged(grouped: DataFrame, q: Query, labels: list[str]) -> DataFrame:
    """``key``, ``banned`` and ``score`` (null: something is missing) of rows with all ``terms`` of a document."""
    inverse = [1 / WEIGHTS[x] for x in labels]

    def judge(terms: list[dict]) -> tuple[bool, float | None]:
        of = {x["term"]: x for x in terms}
        there = {t: set(x["at"]) for t, x in of.items()}

        def hits(phrase: Phrase) -> list[tuple[int, float]]:
            if any(t not in of for _, t in phrase):
                return []
            first = of[phrase[0][1]]
            return [(a, inverse[f]) for a, f in zip(first["at"], first["field"]) if all(a + o in there[t] for o, t in phrase[1:])]

        banned = any(hits(p) for p in q.banned)
        entries = [[(a, g, w) for p in dict.fromkeys(group) for a, w in hits(p)] for g, group in enumerate(q.wanted)]
        return banned, None if banned or not all(entries) else cover_density(sorted(sum(entries, [])), len(entries))

    def batches_judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):  # a few documents as Python objects at once
                part = batch.slice(low, 256)
                out = [judge(x) for x in part.column("terms").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([b for b, _ in out], pa.bool_()), pa.array([x for _, x in out], pa.float64())], names=["key", "banned", "score"])

    kind = grouped.schema["key"].dataType.simpleString()
    return grouped.mapInArrow(batches_judged, f"key {kind}, banned boolean, score double")


def matches(at: Index, query: str | None, **wanted) -> DataFrame:
    """key, score of the documents that a query finds, among those whose kept columns are as ``wanted``.

    An empty query finds all of them with score 0.
    """
    q = asked(query)
    open_ = filters.where(at.documents, **wanted)
    if not q.wanted and not q.banned:
        return open_.select(F.col("key").alias(at.key), F.lit(0.0).alias("score"))
    buckets = sorted({zlib.crc32(t.encode()) % at.buckets for t in q.terms})
    rows = at.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(q.terms))
    grouped = unpacked(rows).groupBy("key").agg(F.collect_list(F.struct("term", "at", "field")).alias("terms"))
    placed = judged(grouped, q, at.labels)
    if q.wanted:
        found = placed.where(F.col("score").isNotNull()).select("key", F.round("score", 6).alias("score"))
        if wanted:
            found = found.join(open_.select("key"), "key", "left_semi")
    else:  # only exclusions: all documents but those that hold them
        bad = placed.where("banned").select("key")
        found = open_.join(bad, "key", "left_anti").select("key", F.lit(0.0).alias("score"))
    return found.select(F.col("key").alias(at.key), "score")
