"""Near-duplicates by DartMinHash signatures, banding and exact checks.

Each distinct shingle owns a strip as wide as its weight. Darts fall on a strip
as a Poisson process in rank, fixed by the shingle's hash, so equal shingles get
equal darts in every document. A dart names a coordinate; the earliest dart at
each coordinate is the signature. About k ln k + 2k darts are thrown for k
coordinates, whatever the document's length; where one stays empty, more are.

A shingle's weight is the number of its occurrences, so banding works on multisets.
Documents that share a band are candidates. Within a band's bucket nobody is
paired with everybody: each member is compared with the bucket's hub only, and
those that don't reach the threshold with a second one; what is linked becomes
one component. Links between different components of the candidates are then
found by an exact prefix filter: two sets of the similarity asked for share one
of their rarest shingles, so each set is listed under these alone, and only sets
of different components that meet there, and that sizes, places in the lists and
parities don't rule out, are compared. The parities are bits that each shingle of
a set turns over, one by its hash: two sets differ in as many shingles as bits at
least, so too many bits rule a link out for certain. In a crowd of near copies the
largest component of a shingle isn't paired with itself. All comparisons are exact
(Jaccard similarity of the sets of shingles).

Cases: documents are one class if their words are equal or linked by a chain of
links; a document of fewer than five words has one shingle, all its words; one
without words (or null) is a class of its own. A class's id is its smallest
doc_id (null if it has none). Repeated rows are members like others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, stored, utf8, words

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 6
PARITIES = 16  # longs, 1024 bits

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 120_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(tokens: list[bytes], hashes: _Words, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the word shingles, with repeats."""
    if not tokens:
        return np.zeros(0, np.uint64)
    w = np.fromiter((hashes[t] for t in tokens), np.uint64, len(tokens))
    if len(w) < size:
        return mix(np.array([xxhash.xxh64_intdigest(b" ".join(tokens))], np.uint64))
    n = len(w) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _ODD[0] + mix(w[i : i + n] + _ODD[i % 5])
    out = mix(out)
    out.sort()
    return out


def dart_minhash(elements: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """The signature of a weighted set of hashed elements: k dart names.

    A weight of w is w strips of width 1, the last thinned to what is left of w,
    so the darts of a smaller weight are among those of a larger one. The part
    of coordinates in which two sets agree estimates their weighted Jaccard
    similarity, sum of minima over sum of maxima.
    """
    if weights is None:
        strips, width = mix(elements), None
    else:
        full = np.ceil(weights).astype(np.int64)
        at = np.repeat(np.arange(len(elements)), full)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(full) - full, full)
        strips = mix(elements[at] + nth.astype(np.uint64) * _ODD[1])
        width = np.minimum(1.0, weights[at] - nth) if (full != weights).any() else None
    total = float(len(elements)) if weights is None else float(np.sum(weights))
    limit = (k * math.log(k) + 2 * k) / max(total, 1e-9)
    while True:
        active, rank, thrown = strips, np.zeros(len(strips)), 0
        wide = width
        names, ranks = [], []
        while len(active):
            c = min(int(limit) + 1, 4096)
            u = mix(active[:, None] + np.arange(thrown + 1, thrown + c + 1, dtype=np.uint64) * _GOLD)
            at = rank[:, None] - np.cumsum(np.log(((u >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53), axis=1)
            hit = at < limit
            more = hit[:, -1]
            if wide is not None:
                hit &= (mix(u ^ _ODD[2]) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < wide[:, None]
                wide = wide[more]
            names.append(u[hit])
            ranks.append(at[hit])
            active, rank, thrown = active[more], at[more, -1], thrown + c
        name, order = mix(np.concatenate(names) + _ODD[3]), np.argsort(-np.concatenate(ranks), kind="stable")
        name = name[order]
        coordinate = ((name >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
        signature, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
        signature[coordinate], filled[coordinate] = name, True  # the last, earliest dart stays
        if filled.all():
            return signature
        limit *= 2


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
    for column in signature.reshape(bands, rows).T:
        out = mix(out * _ODD[4] + column)
    return out.view(np.int64)


def signed(docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS, weights: str = "count") -> DataFrame:
    """A row for each document: uid, th, doc_id, key (of its words), n, bands.

    ``weights``: "set" counts a shingle once, "count" as often as it occurs.
    """
    given = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("uid"), F.xxhash64("text").alias("th"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        for batch in batches:
            keys, sizes, found = [], [], []
            for data in utf8(batch.column(3)):
                tokens = words(data)
                if not tokens:
                    keys.append(None), sizes.append(0), found.append(None)
                    continue
                elements, counts = np.unique(shingles(tokens, hashes), return_counts=True)
                keys.append(xxhash.xxh3_128_digest(b" ".join(tokens)))
                sizes.append(len(elements))
                found.append(band_keys(dart_minhash(elements, bands * rows, counts.astype(float) if weights == "count" else None), bands, rows))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                names=["uid", "th", "doc_id", "key", "n", "bands"],
            )

    return given.mapInArrow(sign, "uid long, th long, doc_id long, key binary, n long, bands array<long>")


def parities(elements: np.ndarray) -> np.ndarray:
    """For each bit whether an odd number of the elements fall on it."""
    hits = np.bincount((mix(elements.view(np.uint64) + _ODD[4]) % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES)
    return np.packbits((hits & 1).astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, set and parities of the documents whose (uid, th) are ``wanted``."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("uid"), F.xxhash64("text").alias("th"), "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [np.unique(shingles(words(data), hashes)).view(np.int64) for data in utf8(part.column(1))]
                odd = [parities(x) for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], names=["key", "set", "odd"])

    rows = texts.join(wanted, ["uid", "th"]).select("key", "text")
    return rows.mapInArrow(sets, "key binary, set array<long>, odd array<long>").dropDuplicates(["key"])


def components(edges: DataFrame) -> DataFrame:
    """(key, root) for each key of the edges (a, b): the smallest key it is linked to.

    Alternating large and small stars; each round's links are written to the
    shared folder. The number of rounds grows with the logarithm of a chain.
    """

    def changed(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    before = changed(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a != b").distinct()
        links = stored(small, "links")
        after = changed(links)
        if after == before:
            return links.select(F.col("a").alias("key"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("key"), F.col("b").alias("root")).distinct())
        before = after


def _compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, linked) for distinct pairs with their sizes na and nb."""
    sized = pairs.where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity - 1e-9))
    joined = sized.join(sets.select(F.col("key").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return joined.select("a", "b", (both >= F.lit(similarity - 1e-12) * (F.col("na") + F.col("nb") - both)).alias("linked"))


def prefixes(sets: DataFrame, similarity: float, cells: int = 1 << 20) -> DataFrame:
    """(token, key, n, place): each set's rarest shingles, as many as the filter needs.

    Any order that is the same for all sets keeps the filter exact; the counts
    of ``cells`` hashed cells, which is all that is sent to the tasks, make it
    nearly the order by frequency.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(cells, np.int64)
        for batch in batches:
            at, times = np.unique(batch.column(0).flatten().to_numpy() & (cells - 1), return_counts=True)
            sums[at] += times
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["cell", "n"])

    found = sets.select("set").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(cells, np.int32)
    often[found["cell"].to_numpy()] = np.minimum(found["n"].to_numpy(), 2**31 - 1)
    sent = sets.sparkSession.sparkContext.broadcast(often)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, tokens, places = [], [], [], []
            for key, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                mine = row.values.to_numpy()
                most = len(mine) - math.ceil(similarity * len(mine) - 1e-9) + 1
                first = mine[np.lexsort((mine, sent.value[mine & (cells - 1)]))[:most]]
                keys += [key] * len(first)
                sizes.append(np.full(len(first), len(mine)))
                tokens.append(first)
                places.append(np.arange(len(first)))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(keys, pa.binary()), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], names=["token", "key", "n", "place"])

    return sets.select("key", "set").mapInArrow(rarest, "token long, key binary, n long, place long")


def apart(listed: DataFrame, odd: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs of different roots that the filters let pass: a, na, b, nb, ra, rb.

    ``listed``: token, key, n, place, root; ``odd``: key and parities. The members of a token's largest root
    are never on the left side, so they don't meet each other.
    """
    listed = stored(listed, "prefixes")
    roots = listed.groupBy("token", "root").agg(F.count("*").alias("m")).groupBy("token").agg(F.count("*").alias("k"), F.max(F.struct("m", "root")).alias("x"))
    # Written before it is joined: a token with many rows is then split among tasks.
    crowd = stored(roots.where("k > 1").select("token", F.col("x.root").alias("crowd")), "crowds")
    listed = stored(listed.join(crowd, "token").join(odd, "key"), "listed")
    left = listed.where("root != crowd").select("token", F.col("key").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("root").alias("ra"), F.col("odd").alias("oa"), "crowd")
    right = listed.select("token", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("root").alias("rb"), F.col("odd").alias("ob"))
    sized = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity - 1e-9)
    # The rarest shingle in common is met with nothing before it; what follows it in either list is all there can be.
    reach = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= (F.col("na") + F.col("nb")) * F.lit(similarity / (1 + similarity)) - 1e-6
    bits = reduce(Column.__add__, [F.bit_count(F.col("oa")[i].bitwiseXOR(F.col("ob")[i])) for i in range(PARITIES)])
    near = bits <= (F.col("na") + F.col("nb")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6
    once = (F.col("rb") == F.col("crowd")) | (F.col("a") < F.col("b"))
    met = left.join(right, (left["token"] == right["token"]) & (F.col("ra") != F.col("rb")) & once & sized & reach & near)
    turned = (("a", "b", "a"), ("na", "nb", "na"), ("b", "a", "b"), ("nb", "na", "nb"), ("ra", "rb", "ra"), ("rb", "ra", "rb"))
    return met.select(*[F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in turned]).distinct()


def classes(docs: DataFrame, *, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weights: str = "count", hubs: int = 2) -> DataFrame:
    """A row for each document row: uid, th, doc_id, class_id, class_size."""
    known = _rooted(docs, similarity=similarity, bands=bands, rows=rows, weights=weights, hubs=hubs)
    own = known.where("root is null").select("uid", "th", "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    known = known.where("root is not null")
    sizes = known.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return known.join(sizes, "root").select("uid", "th", "doc_id", "class_id", "class_size").unionByName(own)


def _rooted(docs: DataFrame, *, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weights: str = "count", hubs: int = 2) -> DataFrame:
    """uid, th, doc_id and root of each document row; rows without words have no root."""
    rowsof = stored(signed(docs, bands=bands, rows=rows, weights=weights), "signed")
    nodes = rowsof.where("key is not null").groupBy("key").agg(F.min(F.struct("uid", "th")).alias("at"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    member = nodes.select("key", "n", F.col("at.uid").alias("uid"), F.col("at.th").alias("th"), F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.count("*").alias("m")).where("m > 1").select("band")
    left = stored(member.join(shared, "band"), "buckets")
    sets = stored(shingle_sets(docs, left.select("uid", "th", "key").distinct()), "sets")
    left, found = left.select("band", "key", "n"), []
    for i in range(hubs):
        order = F.struct(F.xxhash64(F.lit(i), "key").alias("h"), "key", "n")
        hub = left.groupBy("band").agg(F.min(order).alias("hub")).select("band", F.col("hub.key").alias("a"), F.col("hub.n").alias("na"))
        dealt = left.join(hub, "band").where("key != a").select("band", "a", "na", F.col("key").alias("b"), F.col("n").alias("nb"))
        linked = stored(_compared(dealt.select("a", "na", "b", "nb").distinct(), sets, similarity).where("linked").select("a", "b"), "linked")
        found.append(linked)
        left = stored(dealt.join(linked, ["a", "b"], "left_anti").select("band", F.col("b").alias("key"), F.col("nb").alias("n")), "buckets")
    edges = reduce(DataFrame.unionByName, found)
    roots = components(edges)
    listed = prefixes(sets, similarity).join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    pairs = stored(apart(listed, sets.select("key", "odd"), similarity), "pairs")
    more = stored(_compared(pairs, sets, similarity).where("linked").join(pairs, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")), "linked")
    joined = components(more).select(F.col("key").alias("root"), F.col("root").alias("lower"))
    roots = roots.join(joined, "root", "left").select("key", F.coalesce("lower", "root").alias("root")).unionByName(joined.join(roots.select("root").distinct(), "root", "left_anti").select(F.col("root").alias("key"), F.col("lower").alias("root")))
    return rowsof.select("uid", "th", "doc_id", "key").join(roots, "key", "left").select("uid", "th", "doc_id", F.coalesce("root", "key").alias("root"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, the one with its smallest doc_id (of equal ids, the smallest text hash).

    Rows without an id stay only where their class has none with an id. Rows
    without words are classes of their own.
    """
    found = _rooted(docs, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "uid")).alias("x")
    keep = found.where("root is not null").groupBy("root").agg(first).select("x.uid", "x.th").unionByName(found.where("root is null").select("uid", "th")).distinct()
    uid, th = free(docs.columns, "uid"), free(docs.columns, "th")
    marked = docs.withColumns({uid: F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), th: F.xxhash64("text")})
    kept = marked.join(keep.select(F.col("uid").alias(uid), F.col("th").alias(th)), [uid, th], "left_semi")
    return kept.dropDuplicates([uid, th]).select(*docs.columns)
