"""Periodic runs: stretches of words that repeat with a fixed period three times or more.

A run of period q holds an aligned block of b words, b the power of two with
b <= q < 2b, that stands again q words later. So for each b the aligned blocks are
keys of an automaton over word numbers, which searches the words after them; an
occurrence at a distance from b to 2b - 1 seeds an exact extension to both sides.
The scale of 8 takes the distances below 8 too, as a run has 24 words at least.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, slices, utf8

SHORTEST, TIMES = 24, 3
SMALLEST = 8  #: words of the smallest blocks
LONGEST_KEY = 1 << 12  #: words of the longest key; a longer block is sought by its first words
BLOCKS = 64  #: keys of one automaton, so that no node has more branches

Run = tuple[int, int, int]  #: start, length, period


def extended(w: np.ndarray, at: int, end: int, distance: int) -> tuple[int, int]:
    """The longest stretch around [at, end) in which words ``distance`` apart are equal."""

    def equal(a: int, step: int) -> int:
        """How many words from ``a`` on, in the direction of ``step``, equal those ``distance`` later."""
        most = len(w) - distance - a if step > 0 else a + 1
        done, size = 0, 16
        while done < most:
            n = min(size, most - done)
            lo = a + done if step > 0 else a - done - n + 1
            differ = w[lo : lo + n] != w[lo + distance : lo + distance + n]
            if differ.any():
                return done + int(differ.argmax() if step > 0 else differ[::-1].argmax())
            done, size = done + n, size * 2
        return done

    right = equal(at, 1)
    return at - equal(at - 1, -1), at + right + distance


def runs(w: np.ndarray) -> list[Run]:
    """All runs of the word numbers ``w``: each maximal, with its smallest period."""
    n, shortest = len(w), max(SHORTEST, TIMES)
    if n < shortest:
        return []
    order = np.argsort(w, kind="stable")
    again = np.full(n, n + n, np.int64)  # how far the same word stands next
    same = w[order[1:]] == w[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    found: dict[tuple[int, int], int] = {}  # (start, end): smallest period
    since, until, period = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64)  # of the run that holds a word and ends last
    b = SMALLEST
    while TIMES * b <= n or b == SMALLEST:
        near, far = 1 if b == SMALLEST else b, 2 * b - 1
        reach = again[: n // b * b].reshape(-1, b).max(axis=1)
        starts = np.flatnonzero(reach <= far) * b
        # Blocks well inside a run of a short period recur at its multiples only.
        inside = (until[starts] >= np.minimum(starts + 3 * b, n)) & (2 * period[starts] <= b)
        starts = starts[~inside].tolist()
        size = min(b, LONGEST_KEY)
        while starts:
            last = starts[0] + BLOCKS * b
            group = [s for s in starts[:BLOCKS] if s < last]
            starts = starts[len(group) :]
            keys: dict[tuple, int] = {}
            key_of = {s: keys.setdefault(tuple(w[s : s + size].tolist()), len(keys)) for s in group}
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, k in keys.items():
                automaton.add_word(key, k)
            automaton.make_automaton()
            first = group[0] + 1
            for end, k in automaton.iter(tuple(w[first : group[-1] + far + size].tolist())):
                place = first + end - size + 1
                for s in range(max(0, -(-(place - far) // b) * b), place - near + 1, b):  # one block, or two
                    if key_of.get(s) != k:
                        continue
                    distance = place - s
                    if until[s] >= place + size and distance % period[s] == 0:
                        continue  # within a run whose period divides the distance
                    if until[s] != until[place] and period[s] == period[place] and 2 * period[s] <= b and until[s] >= s + size and until[place] >= place + size and since[s] + distance != since[place] and until[s] + distance != until[place]:
                        continue  # in two runs of which no ends meet: what is equal there is shorter than two distances
                    start, stop = extended(w, s, s + size, distance)
                    if stop - start >= max(shortest, TIMES * distance):
                        found[start, stop] = min(distance, found.get((start, stop), distance))
                        span = slice(start, stop)
                        later = until[span] < stop
                        since[span][later], until[span][later] = start, stop
                        period[span][later] = found[start, stop]
        b *= 2
    return sorted((start, stop - start, q) for (start, stop), q in found.items())


def numbered(documents: list[list[bytes]]) -> list[np.ndarray]:
    """Word numbers of each document; no number is shared by two documents."""
    out, at = [], 0
    for words in documents:
        known: dict[bytes, int] = {}
        out.append(np.fromiter((known.setdefault(x, len(known)) for x in words), np.int64, len(words)) + at)
        at += len(known)
    return out


def runs_of(documents: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each document. Short documents are searched together: as they share no number, no run crosses their ends."""
    sizes = [len(d) for d in documents]
    ends = np.cumsum(sizes)
    out: list[list[Run]] = [[] for _ in documents]
    if not documents or not ends[-1]:
        return out
    for start, length, q in runs(np.concatenate(numbered(documents))):
        k = int(np.searchsorted(ends, start, side="right"))
        out[k].append((start - int(ends[k]) + sizes[k], length, q))
    return out


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words without those that stand in a run after its first period."""
    if not found:
        return words
    kept = np.ones(len(words), bool)
    for start, length, q in found:
        kept[start + q : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def repeating(words: list[bytes], key: int | None) -> list[bytes]:
    """A tenth of all documents, told by the checksum of their key, with a tail that repeats."""
    if not words or key is None:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def find(docs: DataFrame, key: str = "doc_id", *, rewrite: Callable[[list[bytes], object], list[bytes]] | None = None) -> DataFrame:
    """``key``, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    Words are what stands between ASCII blanks; ``collapsed`` are the words left, joined
    by one blank. ``rewrite`` (words, key) may change the words first. Null, empty and
    blank texts have no words and no runs; repeated rows are answered alike, further
    columns are left out, an empty table stays empty. A worker holds a few MB of
    text at once, or one longer text.
    """

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids = batch.column(0).to_pylist()
            documents = [data.split() if data else [] for data in utf8(batch.column(1))]
            if rewrite:
                documents = [rewrite(words, i) for words, i in zip(documents, ids)]
            found = runs_of(documents)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(d) for d in documents], pa.int64()),
                    pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                    pa.array([b" ".join(collapsed(d, r)) for d, r in zip(documents, found)], pa.binary()).cast(pa.string()),
                ],
                names=[key, "n_words", "runs", "collapsed"],
            )

    given = docs.select(F.col(key), F.col("text").alias(free([key], "text")))
    kind = given.schema[0].dataType.simpleString()
    return given.mapInArrow(searched, f"`{key}` {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
