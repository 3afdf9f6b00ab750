"""Periodic runs of words by power-of-two naming.

Words get integer names within their document; level k names the stretch of 2^k words that starts at
each place, by sorting the pairs of names of its halves (Karp, Miller and Rosenberg). A stretch that
occurs once is equal to no other and needs no further names. Two places' common stretch is measured
by descending the levels, forwards and backwards, for all candidates at once.

Candidates: a run of period q holds at least 2 q words, so it holds a place i that is a multiple of q
together with i + q. Of those places the first that lies in the run finds it; the number of candidates
of n words is about n ln n. A stretch found under several periods has the smallest.

A run is a stretch of consecutive words with smallest period q, of at least max(LEAST, 2 q) words, that
no neighbouring word extends keeping the period.

Defined results: words lie between ASCII white space; a null, empty or blank text has no words and no
runs; runs of one document may overlap; a text of any length is searched whole; rows repeated get a
row each; a null doc_id has no checksum, so its words stay as they are; an empty table gives no rows;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewest words of a run.
LEAST = 12
#: Words that are named together; a longer document is named alone. Candidates compared at a time.
TOGETHER, BLOCK = 1 << 18, 1 << 20


def _named(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Names of n + 1 places: equal keys at `at` share a number from 0, every other place has a negative one of its own."""
    names = -1 - np.arange(n + 1, dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    shared = sizes > 1
    names[at[order[np.repeat(shared, sizes)]]] = np.repeat(np.arange(shared.sum()), sizes[shared])
    return names


class Names:
    """Names of all stretches of 2^k words of some documents, laid end to end."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        """words: numbers of words, equal within a document where the words are; sizes: words of each document."""
        n = self.n = len(words)
        document = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        level = _named(document * (int(words.max(initial=0)) + 1) + words, np.arange(n), n)
        self.levels, half = [], 1
        while (level[:n] >= 0).any():
            self.levels.append(level)
            at = np.flatnonzero(level[:n] >= 0)
            at = at[at + half < n]
            at = at[level[at + half] >= 0]
            level = _named(level[at] * n + level[at + half], at, n)
            half *= 2

    def forwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal; i < j."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][i] == self.levels[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - begin

    def backwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j are equal; i < j."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            step = ((a >= 0) & (self.levels[k][a] == self.levels[k][b])).astype(np.int64) << k
            i -= step
            j -= step
        return begin - i


def _candidates(names: Names, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (place, period): multiples of each period in each document, where the word one period on is the same."""
    if not names.levels:
        return
    words, starts = names.levels[0], np.cumsum(sizes) - sizes
    halves = sizes // 2
    for lo in range(0, int(halves.sum()), BLOCK):
        hi = min(int(halves.sum()), lo + BLOCK)
        ends = np.cumsum(halves)
        number = np.arange(lo, hi)
        document = np.searchsorted(ends, number, side="right")
        period = number - (ends - halves)[document] + 1
        counts = (sizes[document] - 1) // period
        done = np.cumsum(counts)
        first = 0
        while first < len(number):
            last = max(first + 1, int(np.searchsorted(done, (done[first - 1] if first else 0) + BLOCK, side="right")))
            c, q = counts[first:last], period[first:last]
            if c.sum() <= 2 * BLOCK:
                yield from _equal(words, np.repeat(starts[document[first:last]], c) + (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)) * np.repeat(q, c), np.repeat(q, c))
            else:
                for k in range(0, int(c[0]), BLOCK):
                    place = starts[document[first]] + np.arange(k, min(k + BLOCK, int(c[0]))) * q[0]
                    yield from _equal(words, place, np.full(len(place), q[0]))
            first = last


def _equal(words: np.ndarray, place: np.ndarray, period: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    same = words[place] == words[place + period]
    if same.any():
        yield place[same], period[same]


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows of document, start (word number in it), length, period, in this order, of documents laid end to end."""
    names, found = Names(words, sizes), []
    for place, period in _candidates(names, sizes):
        length = names.forwards(place, place + period) + period
        near = length + period > np.maximum(least, 2 * period)
        place, period, length = place[near], period[near], length[near]
        before = names.backwards(place, place + period)
        length += before
        good = (before < period) & (length >= np.maximum(least, 2 * period))
        found.append(np.stack([place[good] - before[good], length[good], period[good]], axis=1))
    runs = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # Of a stretch found under several periods the smallest stays.
    runs = runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))] if len(runs) else runs
    ends = np.cumsum(sizes)
    document = np.searchsorted(ends, runs[:, 0], side="right")
    runs = np.column_stack([document, runs[:, 0] - (ends - sizes)[document], runs[:, 1], runs[:, 2]])
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def repeated_places(words: int, doc_id: int | None) -> np.ndarray | None:
    """Which word stands at each place of a text of so many words once its tail repeats; None where the document's checksum leaves it as it is."""
    if doc_id is None or not words or (h := crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    start = g % words
    period, at = 1 + (words - start) // (3 + g % 8), np.arange(words)
    return np.where(at >= start, start + (at - start) % period, at)


def _groups(texts: Iterator[tuple[int | None, bytes]]) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Documents' words, in groups of about TOGETHER words."""
    group, words = [], 0
    for doc_id, text in texts:
        parts = text.split()
        if group and words + len(parts) > TOGETHER:
            yield group
            group, words = [], 0
        group.append((doc_id, parts))
        words += len(parts)
    if group:
        yield group


def _searched(group: list[tuple[int | None, list[bytes]]], repeat: bool) -> Iterator[tuple[int | None, list[bytes], np.ndarray]]:
    """doc_id, words, runs (start, length, period) of each document of a group."""
    codes, lists, numbers = {}, [], []
    for doc_id, words in group:
        n = np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.int64, count=len(words))
        if repeat and (place := repeated_places(len(words), doc_id)) is not None:
            n, words = n[place], [words[p] for p in place.tolist()]
        lists.append((doc_id, words))
        numbers.append(n)
    sizes = np.fromiter(map(len, numbers), dtype=np.int64, count=len(numbers))
    runs = runs_of(np.concatenate(numbers), sizes)
    cuts = np.searchsorted(runs[:, 0], np.arange(len(lists) + 1))
    for k, (doc_id, words) in enumerate(lists):
        yield doc_id, words, runs[cuts[k] : cuts[k + 1], 1:]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds past its first period, joined by single spaces."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def _map(docs: DataFrame, fields: list[tuple[str, pa.DataType, str]], row: Callable[[list[bytes], np.ndarray], tuple], repeat: bool = False) -> DataFrame:
    """doc_id and the fields (name, Arrow type, SQL type) whose values row(words, runs) gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                texts = zip(some.column("doc_id").to_pylist(), (t.as_buffer().to_pybytes() for t in some.column("text")))
                rows = [row(words, runs) for group in _groups(texts) for _, words, runs in _searched(group, repeat)]
                columns = [pa.array(values, kind) for values, (_, kind, _) in zip(zip(*rows), fields)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *columns], names=["doc_id", *(name for name, _, _ in fields)])

    schema = ", ".join(f"{name} {kind}" for name, _, kind in fields)
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs: an array of start, length and period for each document, by start, then period."""
    fields = [("runs", pa.list_(_RUN), "array<struct<start: long, length: long, period: long>>")]
    return _map(docs, fields, lambda words, runs: ([dict(zip(("start", "length", "period"), r)) for r in runs.tolist()],))


def collapse_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: the words that no run holds past its first period, joined by single spaces."""
    return _map(docs, [("text", pa.string(), "string")], lambda words, runs: (collapsed(words, runs).decode(),))


def _digest(words: list[bytes], runs: np.ndarray) -> tuple:
    every = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
    # Runs lie by start, then period, so the first of the greatest length is the one that ties prefer.
    best = runs[runs[:, 1].argmax()].tolist() if len(runs) else [None] * 3
    milli = 1000 * best[1] // best[2] if len(runs) else None
    return len(runs), *best, milli, hashlib.sha256(every.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest()


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period), and digests of all runs and of the collapsed text.

    Of every ten documents, about one has the tail of its text replaced by repetitions first.
    """
    longs = ("n_runs", "start", "length", "period", "exponent_milli")
    fields = [(name, pa.int64(), "long") for name in longs] + [(name, pa.string(), "string") for name in ("runs_sha256", "collapsed_sha256")]
    return _map(docs, fields, _digest, repeat=True)
