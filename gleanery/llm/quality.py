"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document (bad, good or no vote):
six on its form, and a lexicon of words that speak against a document, which is
learned from a bounded sample of annotated rows. Expectation-maximisation over the
counts of vote patterns estimates how often each labeller votes in each class: good
documents, and for each labeller those that are bad in its way (toxic ones look good to
the labellers of form, and repeated lines to the others). The posterior of a pattern is
the label of its documents, and the posteriors of all documents train a linear scorer
over hashed word features.

Annotations give the lexicon and the rates from which the estimation starts, no label. The sample has at most
``max_annotated`` rows, those with the smallest hashes of their ids, so its ids fit
a broadcast whatever the table's size. Every ``holdout``-th annotated id by another
hash is never used, so it can measure the result. All else covers every document.

Cases: null and empty texts have no words and are rejected; repeated rows get the
same score; equal scores of 0 are rejected; other columns pass through; an empty
table gives an empty result; labels without ids or values don't count, and of an
id with several labels the worst counts.
"""

from __future__ import annotations

import math
import operator
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, utf8, words

LABELLERS = ("short", "symbols", "capitals", "separators", "repeats", "function_words", "lexicon")
BAD, NONE, GOOD = -1, 0, 1

#: Words whose presence marks running prose, in four languages.
FUNCTION_WORDS = frozenset(
    "the of and to in is that it was for on are as with be by a der die das und ist von zu mit den für le la les de des et est dans que pour el los las y en es por un con".encode().split()
)

_LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_CAPITALS = bytes(range(0x41, 0x5B))
_SYMBOLS = b"#$%&*!|@^~<>{}[]=_\\"
_ALONE = re.compile(rb"(?<!\S)[!-/:-@\[-`{-~]+(?!\S)")  # signs without a letter or digit beside them
_PREFIXES = (5, 6, 7)


def vote(data: bytes, tokens: list[bytes]) -> list[int]:
    """The votes of all labellers but the lexicon. Bytes stand for characters."""
    n, size = len(tokens), len(data) - data.count(b" ") - data.count(b"\n")
    if not n:
        return [BAD, NONE, NONE, NONE, NONE, NONE]
    letters = len(data) - len(data.translate(None, _LETTERS))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    alone = len(_ALONE.findall(data)) if symbols else 0
    repeats = sum(map(operator.eq, tokens, tokens[1:]))
    functional = sum(map(FUNCTION_WORDS.__contains__, tokens))
    return [
        BAD if n < 3 else NONE,
        BAD if symbols > 0.08 * size else GOOD if symbols < 0.01 * size else NONE,
        BAD if capitals > 0.3 * max(letters, 1) else NONE,
        BAD if alone > 0.2 * n else NONE,
        BAD if n >= 20 and repeats > 0.2 * n else NONE,
        NONE if n < 20 else GOOD if functional > 0.1 * n else BAD if functional < 0.02 * n else NONE,
    ]


def _bucket(word: bytes, buckets: int) -> tuple[int, ...]:
    """Hashed features of a word: itself and its first 5, 6 and 7 characters."""
    digest = xxhash.xxh64_intdigest
    if word.isascii():
        n, starts = len(word), word
    else:
        starts = word.decode("utf-8", "replace")
        n = len(starts)
    own = digest(word) % buckets
    if n < 5:
        return (own,)
    cut = [starts[:k] for k in range(5, min(n, 7) + 1)]
    return own, *[digest(x, 1) % buckets for x in cut]  # seed 1: the start of a word isn't that word


class _Numbers(dict):
    """Words, numbered in the order in which they are asked for, with their features.

    ``heavy`` has the weights of those words that have one in ``weights``.
    """

    def __init__(self, buckets: int, weights: dict[int, float]):
        super().__init__()
        self.buckets, self.weights = buckets, weights
        self.features, self.sizes = array("q"), array("b")
        self.heavy: dict[bytes, float] = {}

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        found = _bucket(word, self.buckets)
        self.features.extend(found)
        self.sizes.append(len(found))
        if total := sum(self.weights.get(f, 0.0) for f in found) if self.weights else 0.0:
            self.heavy[word] = total
        return n

    def clear(self) -> None:
        super().clear()
        self.features, self.sizes, self.heavy = array("q"), array("b"), {}


class _Weights:
    """Sums of the weights of words in several models; words seen are remembered, up to ``most``."""

    def __init__(self, models: list[dict[int, float]], buckets: int, most: int = 120_000):
        self.models, self.buckets, self.most = models, buckets, most
        self.all = frozenset().union(*models)
        self.seen: set[bytes] = set()
        self.heavy: set[bytes] = set()
        self.of: dict[bytes, list[float]] = {}

    def total(self, distinct: set[bytes]) -> list[float]:
        if not self.all:
            return [0.0] * len(self.models)
        fresh = distinct - self.seen
        if len(self.seen) + len(fresh) > self.most:
            self.seen, self.heavy, self.of, fresh = set(), set(), {}, distinct
        for word in fresh:
            found = _bucket(word, self.buckets)
            if not self.all.isdisjoint(found):
                self.heavy.add(word)
                self.of[word] = [sum(m.get(f, 0.0) for f in found) for m in self.models]
        self.seen |= fresh
        hits = sorted(distinct & self.heavy)
        return [sum(self.of[w][i] for w in hits) for i in range(len(self.models))]


def _vote_features(votes: list[int], buckets: int) -> list[int]:
    """The votes' own places, behind the words'."""
    return [buckets + 3 * i + v + 1 for i, v in enumerate(votes) if v]


def _lexicon_vote(lexicon: dict, found: float) -> int:
    """All weights are positive, so 0 means that no word is in the lexicon."""
    return BAD if found and lexicon["bias"] + found > 0 else NONE


# How often a labeller is expected to vote among good documents, those bad in its own way and in another's;
# counts as START documents of the class. A bad class begins with SEEDS annotated rows at least, or, where
# nothing is annotated, with the share OUTSET.
EXPECTED, START, SEEDS, OUTSET = {"good": {BAD: 0.02, GOOD: 0.6}, "own": {BAD: 0.9, GOOD: 0.02}, "other": {BAD: 0.1, GOOD: 0.5}}, 5, 5, 0.03


def em(patterns: dict[tuple[int, ...], int], marked: dict[tuple[tuple[int, ...], int], int] | None = None, rounds: int = 30) -> tuple[dict[tuple[int, ...], float], list[list[dict]]]:
    """Posterior of "bad" for each vote pattern, and each labeller's rates by class.

    Class 0 holds good documents, class i + 1 those that are bad in the way of labeller i.
    The labellers are taken as independent given the class. There are at most
    3 ** labellers patterns, however many documents there are. ``marked``: counts of
    annotated rows by (votes, mark). They give the first shares and rates, a bad one to
    the classes of the labellers that vote against it (a class with too few stays empty);
    from then on all documents do, an annotated one with what its mark leaves of its
    posterior. A posterior is that of a pattern, whatever its marks.
    """
    k = len(next(iter(patterns), ()))
    classes = range(k + 1)
    prior_of = lambda c, i: EXPECTED["good" if c == 0 else "own" if c == i + 1 else "other"]

    def estimated(weighed: list[tuple[tuple[int, ...], int, float]]) -> tuple[list[float], list[list[dict]]]:
        """Shares and rates of the classes from (votes, class, weight)."""
        size, mass = [0.0] * (k + 1), [[{BAD: 0.0, GOOD: 0.0} for _ in classes] for _ in range(k)]
        for p, c, n in weighed:
            size[c] += n
            for i, v in enumerate(p):
                if v:
                    mass[i][c][v] += n
        total = sum(size)
        shares = [x / total for x in size] if 0 < size[0] < total else [1 - k * OUTSET, *[OUTSET] * k]
        return shares, [[{v: (mass[i][c][v] + START * prior_of(c, i)[v]) / (size[c] + START) for v in (BAD, GOOD)} for c in classes] for i in range(k)]

    def seeds(p: tuple[int, ...], mark: int, n: int) -> list[tuple[tuple[int, ...], int, float]]:
        against = [i + 1 for i, v in enumerate(p) if v == BAD]
        return [(p, 0, n)] if mark == GOOD else [(p, c, n / len(against)) for c in against]

    marked = marked or {}
    known = [x for (p, mark), n in marked.items() if mark != NONE for x in seeds(p, mark, n)]
    sizes = [sum(n for _, c, n in known if c == x) for x in classes]
    shares, rates = estimated([x for x in known if x[1] == 0 or sizes[x[1]] >= SEEDS])
    posterior: dict[tuple[int, ...], list[float]] = {}
    for _ in range(rounds):
        for p in patterns:
            logs = [math.log(max(shares[c], 1e-300)) + sum(math.log(max(1e-6, rates[i][c][v] if v else 1 - rates[i][c][BAD] - rates[i][c][GOOD])) for i, v in enumerate(p)) for c in classes]
            each = [math.exp(x - max(logs)) for x in logs]
            posterior[p] = [x / sum(each) for x in each]
        weighed = []
        for p, by in posterior.items():
            good, bad = marked.get((p, GOOD), 0), marked.get((p, BAD), 0) if by[0] < 1 else 0
            open_ = patterns[p] - good - bad
            weighed.append((p, 0, open_ * by[0] + good))
            weighed += [(p, c, open_ * q + (bad * q / (1 - by[0]) if bad else 0.0)) for c, q in enumerate(by) if c]
        shares, rates = estimated(weighed)
    return {p: 1 - q[0] for p, q in posterior.items()}, rates


def _sums(rows: DataFrame, judge, buckets: int, weights: dict[int, float], most: int = 120_000) -> DataFrame:
    """f, bad, good: the words of documents that have a feature, by class.

    ``judge`` goes from (data, tokens, sum of ``weights``, mark) to the weight of "bad"
    and further features of the document. Words are summed first, at most ``most`` at
    once, features from them.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, extra = _Numbers(buckets, weights), {}
        bad, n = np.zeros(1 << 12), np.zeros(1 << 12)

        def flush(some: int = 40_000) -> Iterator[pa.RecordBatch]:
            k, ends = len(numbers), np.concatenate(([0], np.cumsum(np.array(numbers.sizes, np.int64))))
            features = np.array(numbers.features, np.int64)
            for low in range(0, k, some):
                sizes = np.diff(ends[low : low + some + 1])
                every = features[ends[low] : ends[min(k, low + some)]]
                order, at = np.argsort(every, kind="stable"), slice(low, min(k, low + some))
                every, own = every[order], np.repeat(np.stack((bad[at], n[at] - bad[at])), sizes, axis=1)[:, order]
                first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
                sums = np.add.reduceat(own, first, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (every[first], *sums)], names=["f", "bad", "good"])
            more = np.array([(x[0], x[1] - x[0]) for x in extra.values()]).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(list(extra), pa.int64()), pa.array(more[0]), pa.array(more[1])], names=["f", "bad", "good"])
            numbers.clear(), extra.clear()
            bad[:], n[:] = 0, 0

        for batch in batches:
            for data, mark in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                tokens = words(data)
                distinct = set(tokens)
                at = np.fromiter(map(numbers.__getitem__, distinct), np.int64, len(distinct))
                named = sum(numbers.heavy[w] for w in sorted(distinct & numbers.heavy.keys())) if numbers.heavy else 0.0
                p, more = judge(data or b"", tokens, named, mark)
                if len(numbers) > len(bad):
                    bad, n = (np.concatenate((x, np.zeros(len(numbers)))) for x in (bad, n))
                bad[at] += p
                n[at] += 1
                for f in more:
                    pair = extra.setdefault(f, [0.0, 0])
                    pair[0] += p
                    pair[1] += 1
                if len(numbers) > most:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(summed, "f long, bad double, good double").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _weighted(sums: DataFrame, bad: float, good: float, evidence: float, least: float, most: int, buckets: int) -> dict:
    """Log-odds of the features that speak against a document, and the bias, of ``bad`` and ``good`` documents.

    A feature counts from a likelihood ratio (G-squared) of ``evidence`` and log-odds
    of ``least`` on, so only if it is rare among good documents; of more than ``most`` those with the largest
    ratio make the model. Votes, from ``buckets`` on, are few: for them a ratio of 10 does.
    """
    if bad + good == 0:
        return {"weights": {}, "bias": -1.0}
    a, b = bad + 1.0, good + 1.0
    lr, share = F.log((F.col("bad") + 0.5) / a) - F.log((F.col("good") + 0.5) / b), F.col("bad") + F.col("good")
    g2 = 2 * (F.col("bad") * F.log((F.col("bad") + 1e-9) / (share * a / (a + b))) + F.col("good") * F.log((F.col("good") + 1e-9) / (share * b / (a + b))))
    kept = sums.select("f", lr.alias("w"), g2.alias("g")).where(((F.col("g") > evidence) | ((F.col("f") >= buckets) & (F.col("g") > 10))) & (F.col("w") > least))
    return {"weights": {r["f"]: r["w"] for r in kept.orderBy(F.desc("g"), "f").limit(most).collect()}, "bias": math.log(a / b)}


def fit(docs: DataFrame, labels: DataFrame | None, *, max_annotated: int = 20_000, holdout: int = 5, buckets: int = 1 << 40, evidence: float = 60.0, max_features: int = 500_000) -> dict:
    """Fit the lexicon, the labellers' rates and the hashed scorer.

    Without annotations there is no lexicon. ``buckets``: the hashed space, so wide
    that a rare word doesn't meet one that counts. ``max_features``: of the model.
    """
    texts, lexicon = docs.select("doc_id", "text"), {"weights": {}, "bias": -1.0}
    known = texts.select("text", F.lit(NONE).alias("mark"))
    if labels is not None:
        marks = stored(
            labels.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64(F.lit("holdout"), "doc_id"), F.lit(holdout)) != 0))
            .groupBy("doc_id")
            .agg(F.min(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), BAD).otherwise(GOOD)).alias("mark"), F.max(F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 1)).alias("any"))
            .where("any = 1")
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(max_annotated)
            .select("doc_id", "mark"),
            "marks",
        )
        annotated = texts.join(F.broadcast(marks), "doc_id").select("text", "mark")
        found = dict(docs.select("doc_id").join(F.broadcast(marks), "doc_id").groupBy("mark").agg(F.count("*")).collect())  # two rows
        sums = _sums(annotated, lambda data, tokens, named, mark: (float(mark == BAD), ()), buckets, {})
        lexicon = _weighted(sums, found.get(BAD, 0), found.get(GOOD, 0), 40.0, 4.0, max_features, buckets)
        known = texts.join(F.broadcast(marks), "doc_id", "left").select("text", F.coalesce("mark", F.lit(NONE)).alias("mark"))
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def patterns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, counts = _Weights([sent.value["weights"]], buckets), {}
        for batch in batches:
            for data, mark in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                tokens = words(data)
                p = (*vote(data or b"", tokens), _lexicon_vote(sent.value, *lexicon.total(set(tokens))), mark)
                counts[p] = counts.get(p, 0) + 1
        yield pa.RecordBatch.from_pydict({"p": pa.array([list(p) for p in counts], pa.list_(pa.int32())), "n": pa.array(list(counts.values()), pa.int64())})

    found = known.mapInArrow(patterns_of, "p array<int>, n long").groupBy("p").agg(F.sum("n").alias("n"))
    patterns: dict[tuple[int, ...], int] = {}
    marked: dict[tuple[tuple[int, ...], int], int] = {}
    for r in found.toLocalIterator():  # 3 ** 8 rows at most
        *votes, mark = r["p"]
        patterns[tuple(votes)] = patterns.get(tuple(votes), 0) + r["n"]
        marked[tuple(votes), mark] = r["n"]
    posterior, rates = em(patterns, marked)

    def judge(data: bytes, tokens: list[bytes], named: float, mark: int) -> tuple[float, list[int]]:
        votes = [*vote(data, tokens), _lexicon_vote(lexicon, named)]
        return posterior.get(tuple(votes), 0.0), _vote_features(votes, buckets)

    bad = sum(n * posterior[p] for p, n in patterns.items())
    return _weighted(_sums(known.select("text", "mark"), judge, buckets, lexicon["weights"]), bad, sum(patterns.values()) - bad, evidence, 3.5, max_features, buckets) | {"lexicon": lexicon, "rates": dict(zip(LABELLERS, rates)), "buckets": buckets}


def score(docs: DataFrame, model: dict, names: tuple[str, str] = ("quality_score", "keep"), columns: list[str] | None = None) -> DataFrame:
    """Each document's columns, then its score (log-odds of good) and whether to keep it.

    ``names``: of the two columns; input columns of these names are replaced.
    ``columns``: those of the input to return, all by default.
    """
    docs = docs.drop(*names)
    columns = columns or docs.columns
    places = [docs.columns.index(c) for c in columns]
    schema = docs.select(*columns, F.lit(0.0).alias(names[0]), F.lit(True).alias(names[1])).schema
    at, sent = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        weights, buckets = model["weights"], model["buckets"]
        both = _Weights([model["lexicon"]["weights"], weights], buckets)
        for batch in batches:
            scores = []
            for data in utf8(batch.column(at)):
                tokens = words(data)
                named, speaking = both.total(set(tokens))
                votes = [*vote(data or b"", tokens), _lexicon_vote(model["lexicon"], named)]
                against = model["bias"] + sum(weights.get(x, 0.0) for x in _vote_features(votes, buckets)) + speaking
                scores.append(-against if tokens else -20.0)
            arrays = [*(batch.column(i) for i in places), pa.array(scores, pa.float64()), pa.array([s > 0 for s in scores])]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(judged, schema)


def classify(docs: DataFrame, labels: DataFrame | None, names: tuple[str, str] = ("quality_score", "keep"), columns: list[str] | None = None, **options) -> DataFrame:
    """Fit on ``docs`` and ``labels`` and score every document."""
    return score(docs, fit(docs, labels, **options), names, columns)
