"""Best-fit packing by a configuration linear program over the length histogram.

Each document's ids, closed by an end id, are cut into pieces of at most `capacity` tokens;
only longer documents are cut and only their first piece may be shorter. All that the planner
needs of the pieces is how many there are of each length, at most `capacity` numbers. A
configuration is a multiset of lengths that fits one sequence. The linear program asks for
the fewest configurations that cover the histogram; multiplicative weights solve it, and a
knapsack dynamic program over the capacity prices the next configuration. Every table of prices
bounds the program from below (its worth of the histogram over the best configuration's), so the
duality gap is known: the weights start from prices that favour long pieces the least, and start
anew from ones that favour them more until the gap is closed. The solution is rounded down; the
program is solved again for what that leaves while it still places a fair share of it. The last
few pieces, and those of configurations that leave room, are filled in by best fit decreasing,
on counts.

The plan says, for each length, which sequences and offsets take the pieces of which ranks, so
pieces find their places by their rank among those of equal length. Ranks are made in two
steps, within hash buckets of a length and over the buckets' counts: one length may hold a
third of all pieces.

Defined results: a null or empty text is one piece that holds the end id; pieces of `capacity`
tokens fill a sequence each; rows repeated get pieces of their own; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Workspace, take_worker
from ._vocab import text_ids

CAPACITY, END_ID = 1024, 2
#: How fast a length's price falls as it gets covered; how much starting prices favour length, in turn; the duality gap that ends the search; how far below the best a configuration may be priced.
RATE, TILTS, GAP, STALE = 0.1, (0.02, 0.05, 0.1, 0.2, 0.3), 0.003, 0.001
#: The program is solved again for what rounding leaves while it placed at least this share.
FAIR_SHARE = 0.25
#: Pieces of one length that are ranked in one group, about.
RANKED_TOGETHER = 50_000
TEXTS_TOGETHER = 128
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("packing", text_ids.cache_clear)
        encoder, end = text_ids(tokenizer_path), np.array([end_id], dtype=np.uint32)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for at in range(0, batch.num_rows, TEXTS_TOGETHER):
                some = batch.slice(at, TEXTS_TOGETHER)
                texts = [t or "" for t in some.column("text").to_pylist()]
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encoder.many(texts)):
                    ids = np.concatenate([ids, end]).astype("<u4")
                    first = len(ids) % capacity if len(ids) > capacity else 0
                    starts = ([0] if first else []) + list(range(first, len(ids), capacity))
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                        for column, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def knapsack(values: np.ndarray, capacity: int) -> np.ndarray:
    """The greatest value of any room, each length in it as often as it fits; values[length] may be -inf."""
    best, each = np.zeros(capacity + 1), values[1 : capacity + 1]
    for room in range(capacity):
        larger = best[room + 1 :]
        np.maximum(larger, each[: capacity - room] + best[room], out=larger)
        larger[0] = max(larger[0], best[room])
    return best


def configuration(best: np.ndarray, values: np.ndarray) -> dict[int, int]:
    """The configuration of greatest value, of equals the longest length first. With a table for earlier, higher values, one near it."""
    config: dict[int, int] = defaultdict(int)
    room = len(best) - 1
    while room:
        options = best[room - 1 :: -1][:room] + values[1 : room + 1]
        k = room - int(np.argmax(options[::-1]))
        if options[k - 1] > best[room - 1] - 1e-12 and values[k] > 0:
            config[k] += 1
            room -= k
        else:
            room -= 1
    return dict(config)


def price(values: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of greatest value."""
    return configuration(knapsack(values, capacity), values)


def weigh(counts: np.ndarray, capacity: int, tilt: float, rate: float = RATE) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Configurations, and how often to use each, that cover the counts exactly; the best lower bound of the prices met.

    A length's price starts near its share of the capacity, the dual solution of a program without
    waste, falls exponentially in the share of it that is covered, and is nought when all is. The
    configuration priced best is used until it covers a length. A knapsack table serves while it
    gives configurations that are nearly best; prices only fall, so it bounds them.
    """
    need, left = counts.astype(float), counts.astype(float)
    share = np.arange(len(counts)) / capacity
    start, bound = share * np.maximum(share, 1e-9) ** tilt, float(need @ share)
    used: dict[tuple, float] = defaultdict(float)
    best, open_ = None, left > 0
    while open_.any():
        values = np.where(open_, start * np.exp(-rate * (1 - left / np.maximum(need, 1))), -np.inf)
        worth = lambda c: sum(values[k] * n for k, n in c.items())
        config = configuration(best, values) if best is not None else {}
        if best is None or worth(config) < (1 - STALE) * best[-1]:
            best = knapsack(values, capacity)
            config = configuration(best, values)
            bound = max(bound, float(need[open_] @ values[open_]) / best[-1])
        times = min(left[k] / n for k, n in config.items())
        used[tuple(sorted(config.items()))] += times
        for k, n in config.items():
            left[k] -= n * times
            if left[k] < 1e-9:
                left[k], open_[k] = 0.0, False
    return [(dict(c), t) for c, t in used.items()], bound


def cover(counts: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], float]], float, float]:
    """The linear program's solution, how many configurations it uses, and a lower bound of that."""
    best, least, bound = [], float("inf"), 0.0
    for tilt in TILTS:
        found, low = weigh(counts, capacity, tilt)
        total = sum(t for _, t in found)
        bound = max(bound, low)
        if total < least:
            best, least = found, total
        if least <= (1 + GAP) * bound:
            break
    return best, least, bound


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best fit decreasing on counts: bins of equal contents are one entry."""
    open_: dict[int, list[list]] = defaultdict(list)  # room -> [contents, bins]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_ if r >= length and open_[r]), default=None)
            if room is None:
                each = capacity // length
                if whole := left // each:
                    open_[capacity - each * length].append([[length] * each, whole])
                if rest := left % each:
                    open_[capacity - rest * length].append([[length] * rest, 1])
                break
            contents, bins = open_[room].pop()
            each = min(room // length, left)
            take = min(bins, left // each)
            open_[room - each * length].append([contents + [length] * each, take])
            if take < bins:
                open_[room].append([contents, bins - take])
            left -= take * each
    return [(contents, bins) for entries in open_.values() for contents, bins in entries]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, low, high, first sequence, offset): pieces of ranks low to high - 1 go to consecutive sequences at that offset."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    configs = [([capacity], int(counts[capacity]))] if counts[capacity] else []
    counts[capacity] = 0
    placed = FAIR_SHARE
    while counts.any() and placed >= FAIR_SHARE:
        before = counts.sum()
        for config, times in sorted(cover(counts, capacity)[0], key=lambda c: -c[1]):
            full = sum(k * n for k, n in config.items()) == capacity
            m = min([int(times + 1e-6), *(int(counts[k]) // n for k, n in config.items())]) if full else 0
            if m:
                configs.append(([k for k, n in sorted(config.items(), reverse=True) for _ in range(n)], m))
                for k, n in config.items():
                    counts[k] -= m * n
        placed = 1 - counts.sum() / before
    configs += best_fit({k: int(n) for k, n in enumerate(counts) if n}, capacity)
    rows, used, sequence = [], defaultdict(int), 0
    for contents, m in configs:
        offset = 0
        for length in contents:
            rows.append((length, used[length], used[length] + m, sequence, offset))
            used[length] += m
            offset += length
        sequence += m
    return rows


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    work = Workspace(spark, "packing")
    pieces = work.table(cut_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    buckets = max(16, pieces.count() // RANKED_TOGETHER)
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = work.table(salted.groupBy("length", "bucket").agg(F.count("*").alias("n")), "sizes")
    histogram = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}
    before = sizes.selectExpr("length", "bucket", "sum(n) over (partition by length order by bucket) - n as before")
    ranked = salted.selectExpr("*", "row_number() over (partition by length, bucket order by doc_id, piece, ids_crc32) - 1 as rn")
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("rn"))
    # At most one row for each length and configuration: bounded by the capacity, whatever the input.
    places = spark.createDataFrame(plan(histogram, capacity), "len long, low long, high long, first long, offset long")
    hit = (ranked["length"] == places["len"]) & (ranked["rank"] >= places["low"]) & (ranked["rank"] < places["high"])
    return ranked.join(F.broadcast(places), hit).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset"
    )
