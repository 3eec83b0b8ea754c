"""Benchmark decontamination with a generalised suffix automaton.

The automaton of the normalised benchmark items is built once for a block of
items and sent to the tasks; each document's words stream through it, and the
length of the longest match that ends at each word is tracked. A benchmark is a
stated query set: it is taken in blocks of about ``block_words`` words, and a longer
item in pieces that overlap. Each block is a pass of its own over the documents, whose
result is written before the next one begins: a task has one automaton at a time, and the
driver too (about 0.6 KB a word), whatever the benchmark's size.

Cases: null, empty and blank texts have no words, no hits and are not contaminated;
repeated rows are judged alike, as are equal texts; an empty table stays empty; without
benchmark rows nothing is hit. Input columns named as results (``n_words``, ``hits``,
``items``, ``longest``, ``n_hit``, ``contaminated``) are replaced by them in ``match`` and
``judged`` and kept by ``remove_spans``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, utf8, words

WINDOW = 13


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, set] = {}  # state: items of which a prefix ends there
        short: list[tuple[int, object, int]] = []
        for item, tokens in items:
            last = 0
            for token in tokens:
                last = self._extend(last, self.vocabulary.setdefault(token, len(self.vocabulary)))
                ends.setdefault(last, set()).add(item)
            if 0 < len(tokens) < window:
                short.append((item, [self.vocabulary[t] for t in tokens]))
        self.shortest = min([window, *(len(t) for _, t in short)])
        self.items: list[set] = [set(ends.get(s, ())) for s in range(len(self.next))]
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[s]] >= window:  # below, only whole short items count
                self.items[self.link[s]] |= self.items[s]
        # The states of whole short items, and for each state the nearest such one above.
        self.whole: dict[int, list[tuple[int, object]]] = {}
        for item, numbers in short:
            state = 0
            for c in numbers:
                state = self.next[state][c]
            self.whole.setdefault(state, []).append((len(numbers), item))
        self.up = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            p = self.link[s]
            self.up[s] = p if p in self.whole else self.up[p] if p > 0 else -1
        # For each state, the one of its suffix of exactly ``window`` words.
        self.exact = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[s] >= window:
                self.exact[s] = s if self.length[self.link[s]] < window else self.exact[self.link[s]]

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.length[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._new(self.length[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def match(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Maximal hit runs of words, the items found, the longest match.

        A word outside the vocabulary ends every match, so only runs of known
        words that are long enough are streamed.
        """
        get = self.vocabulary.get
        numbers = np.fromiter((get(t, -1) for t in tokens), np.int64, len(tokens))
        unknown = np.concatenate(([-1], np.flatnonzero(numbers < 0), [len(tokens)]))
        gaps = np.flatnonzero(np.diff(unknown) > self.shortest)
        runs: list[list[int]] = []
        found: set = set()
        longest = 0
        nexts, link, length = self.next, self.link, self.length
        for g in gaps.tolist():
            state = matched = 0
            start = int(unknown[g]) + 1
            for i, c in enumerate(numbers[start : int(unknown[g + 1])].tolist(), start + 1):
                while state and c not in nexts[state]:
                    state = link[state]
                    matched = length[state]
                if c in nexts[state]:
                    state, matched = nexts[state][c], matched + 1
                longest = max(longest, matched)
                cover = 0
                if matched >= self.window:
                    cover = matched
                    found |= self.items[self.exact[state]]
                at = state if state in self.whole else self.up[state]
                while at > 0:
                    for n, item in self.whole[at]:
                        if n <= matched:
                            cover = max(cover, n)
                            found.add(item)
                    at = self.up[at]
                if cover:
                    if runs and i - cover <= runs[-1][1]:
                        runs[-1] = [min(runs[-1][0], i - cover), i]
                        while len(runs) > 1 and runs[-1][0] <= runs[-2][1]:
                            last = runs.pop()
                            runs[-1] = [min(runs[-1][0], last[0]), last[1]]
                    else:
                        runs.append([i - cover, i])
        return [(a, b) for a, b in runs], found, longest


def blocks(benchmark: DataFrame, block_words: int) -> list[list[int]]:
    """Block numbers 0..n-1 for the benchmark: each a bounded share of its words."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    return list(range(max(1, -(-int(total) // (4 * block_words)))))


def pieces(items: DataFrame, words_each: int, window: int) -> DataFrame:
    """item, text: items of more than ``words_each`` words in pieces that share ``window`` - 1 words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for item, data in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                tokens = words(data)
                for at in range(0, max(1, len(tokens) - (window - 1 if len(tokens) > words_each else 0)), words_each):
                    ids.append(item)
                    texts.append(b" ".join(tokens[at : at + words_each + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary())], names=["item", "text"])

    return items.mapInArrow(cut, "item string, text binary")


def match(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_words: int = 200_000) -> DataFrame:
    """Per document row: its columns, then ``n_words``, ``hits`` (maximal runs of
    hit words as (start, end)), ``items`` and ``longest``.

    Benchmark rows without an id or without words are left out; repeated ids are
    one item with several texts. Null documents have no words and no hits.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "hits", "items", "longest")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    n = len(blocks(items, block_words))
    items = pieces(items, max(window, block_words // 4), window)
    schema = docs.selectExpr("*", "0L as n_words", "array(struct(0L as a, 0L as b)) as hits", "array('') as items", "0L as longest").schema
    at, width = docs.columns.index("text"), len(docs.columns)
    out = docs
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        sent = spark.sparkContext.broadcast(SuffixAutomaton([(r["item"], bytes(r["text"]).split()) for r in part.collect()], window))
        first = k == 0

        def matched(batches: Iterator[pa.RecordBatch], sent=sent, first=first) -> Iterator[pa.RecordBatch]:
            automaton = sent.value
            for batch in batches:
                before = None if first else batch.select(["hits", "items", "longest"]).to_pylist()
                counts, hits, items, most = [], [], [], []
                for i, data in enumerate(utf8(batch.column(at))):
                    tokens = words(data)
                    runs, found, longest = automaton.match(tokens)
                    if before:
                        runs = merged(runs + [(x["a"], x["b"]) for x in before[i]["hits"]])
                        found, longest = found | set(before[i]["items"]), max(longest, before[i]["longest"])
                    counts.append(len(tokens))
                    hits.append([{"a": a, "b": b} for a, b in runs])
                    items.append(sorted(found))
                    most.append(longest)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:width], pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(items, pa.list_(pa.string())), pa.array(most, pa.int64())],
                    names=schema.names,
                )

        out = out.mapInArrow(matched, schema)
        if k < n - 1:
            out = stored(out, "matched")
            sent.destroy()
    return out


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def judged(docs: DataFrame, benchmark: DataFrame, *, coverage: float = 0.05, **options) -> DataFrame:
    """``match`` with ``n_hit`` and ``contaminated`` (hit words reach ``coverage``)."""
    out = match(docs.drop("n_hit", "contaminated"), benchmark, **options)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    out = out.withColumn("n_hit", hit)
    limit = Fraction(str(coverage))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * limit.denominator >= F.col("n_words") * limit.numerator))


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, coverage: float = 0.05, span_words: int = 13, **options) -> DataFrame:
    """Documents without contaminated ones, hit spans of at least ``span_words`` words cut from the others.

    With a coverage of 0 every hit span is cut from the texts and no document goes.
    Other texts and columns stay; ``n_chars``, where it is a column, is counted anew
    for changed texts.
    """
    packed = docs.select("text", F.struct("*").alias("row"))
    if coverage > 0:
        found = judged(packed, benchmark, coverage=coverage, **options).where(~F.col("contaminated"))
        found = found.select("row", "text", F.filter("hits", lambda x: x["b"] - x["a"] >= span_words).alias("hits"))
    else:
        found = match(packed, benchmark, **options).select("row", "text", "hits")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not h else cut_words(t, [(x["a"], x["b"]) for x in h]) for t, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    left = found.mapInArrow(cut, found.select("row", "text").schema)
    changed = ~F.col("text").eqNullSafe(F.col("row.text"))
    columns = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.char_length("text").cast("long")).otherwise(columns["n_chars"])
    return left.select(*[x.alias(c) for c, x in columns.items()])


def cut_words(text: str, runs: list[tuple[int, int]]) -> str:
    """``text`` without the words (and what stands between them) of each run."""
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
    out, start = [], 0
    for a, b in runs:
        out.append(text[start : at[a][0]])
        start = at[b - 1][1]
    return "".join([*out, text[start:]])
