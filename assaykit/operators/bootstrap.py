"""Bootstrap intervals.

`exact_means` draws resamples of exactly the group's size. A group's values, in order, are cut into
leaves of LEAF ranks. Each leaf finds its own number of draws: from the root of a binary tree over the
leaves down, a node's draws are split by a binomial number from a generator seeded with the node, so
every leaf on the way comes to the same split and no two leaves have to meet. Inside a leaf draw j of
replicate b takes the rank that a word of a digest names. A leaf of one value needs no draws. Ranks come
from running totals of the values' counts; no group is ranked in one task and no draw is joined. The
result depends on the values alone, never on partitions.

`poisson_means` weights each row of each replicate by a Poisson(1) number from the row's own hash. It
needs no ranks: each task sums its rows by group and replicate, and only those sums are shuffled; weights
are drawn for a slice of rows at once, once for each id in it. A resample's size varies. One digest
serves eight replicates. A replicate whose weights are all nought,
which happens in groups of a few rows, has no mean and is left out of the interval.

Null values count in neither's means; a group of null values only has no row; an empty table gives no
rows; rows that share an id get the same Poisson weights, and are rows of their own in exact resamples.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running_totals, same

REPLICATES = 1000
#: Ranks of a leaf.
LEAF = 4096
#: 32-bit numbers in a digest.
WORDS = 8
#: Rows whose weights stand in memory at once, and groups whose sums do.
SLICE, MOST_GROUPS = 1000, 1000
#: Cumulative Poisson(1) probabilities at 0, 1, ..., 7.
POISSON_STEPS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def _key(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:16], "big")


@lru_cache(maxsize=4096)
def _split(group: str, size: int, leaf: int, lo: int, hi: int, n: int) -> np.ndarray:
    """Draws of each of n replicates that fall to leaves lo to hi - 1 of a group of `size` ranks."""
    if lo == 0 and hi * leaf >= size:
        return np.full(n, size, dtype=np.int64)
    # The parent's range is the one that a walk from the root comes through.
    a, b = 0, -(-size // leaf)
    while True:
        mid = (a + b) // 2
        left, right = (a, mid), (mid, b)
        if (lo, hi) in (left, right):
            break
        a, b = left if hi <= mid else right
    whole = _split(group, size, leaf, a, b, n)
    mass = lambda x, y: min(size, y * leaf) - x * leaf
    drawn = np.random.Generator(np.random.Philox(key=_key("split", group, a, b))).binomial(whole, mass(a, mid) / mass(a, b))
    return drawn if (lo, hi) == left else whole - drawn


def leaf_draws(group: str, size: int, at: int, n: int, leaf: int = LEAF) -> np.ndarray:
    """How many of each replicate's draws fall to a leaf."""
    return _split(group, size, leaf, at, at + 1, n)


def leaf_sums(group: str, size: int, at: int, values: np.ndarray, counts: np.ndarray, n: int, leaf: int = LEAF) -> np.ndarray:
    """Sum of the values that each of n replicates draws from a leaf; values in order, each so many times."""
    draws = leaf_draws(group, size, at, n, leaf)
    if len(values) == 1:
        return draws * values[0]
    ranks, out = np.repeat(values, counts), np.zeros(n)
    for b, k in enumerate(draws.tolist()):
        head = f"draw|{group}|{at}|{b}|"
        words = np.frombuffer(b"".join(hashlib.sha256(f"{head}{i}".encode()).digest() for i in range(-(-k // WORDS))), dtype=">u4")[:k]
        out[b] = ranks[words % len(ranks)].sum()
    return out


def exact_means(scored: DataFrame, group: str, value: str, n: int = REPLICATES, leaf: int = LEAF) -> DataFrame:
    """group, b, mean of resamples of exactly each group's number of values."""
    rows = scored.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("v is not null")
    values = rows.groupBy("g", "v").agg(F.count("*").alias("c"))
    sizes = values.groupBy("g").agg(F.sum("c").alias("size"))
    ranked = running_totals(values, ["g"], "v", {"start": "c"})
    # A value's ranks may lie in several leaves.
    pieces = ranked.withColumn("at", F.explode(F.sequence(F.floor(F.col("start") / leaf), F.floor((F.col("start") + F.col("c") - 1) / leaf))))
    inside = F.least(F.col("start") + F.col("c"), (F.col("at") + 1) * leaf) - F.greatest(F.col("start"), F.col("at") * leaf)
    leaves = pieces.groupBy("g", "at").agg(F.array_sort(F.collect_list(F.struct("v", inside.cast("long").alias("k")))).alias("p"))  # at most `leaf` pieces
    leaves = same(leaves, sizes, ["g"]).select("g", F.coalesce(F.col("g").cast("string"), F.lit("")).alias("name"), "size", "at", F.col("p.v").alias("v"), F.col("p.k").alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = zip(*(batch.column(c).to_pylist() for c in ("name", "size", "at", "v", "k")))
            sums = [leaf_sums(name, size, at, np.array(v), np.array(k), n, leaf) for name, size, at, v, k in each]
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("size"), pa.array(sums, pa.list_(pa.float64()))], names=["g", "size", "s"])

    summed = leaves.mapInArrow(run, f"g {rows.schema['g'].dataType.simpleString()}, size long, s array<double>")
    each = summed.select("g", "size", F.posexplode("s").alias("b", "s"))
    return each.groupBy("g", "b").agg((F.sum("s") / F.max("size")).alias("mean")).select(F.col("g").alias(group), F.col("b").cast("long").alias("b"), "mean")


def interval(means: DataFrame, by: list[str]) -> DataFrame:
    """The 2.5 and 97.5 percentiles."""
    return means.groupBy(*by).agg(F.round(F.percentile("mean", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("mean", F.lit(0.975)), 6).alias("high"))


def poisson_weights(ids: list[str | None], n: int) -> np.ndarray:
    """Ids by n replicates; eight replicates take one digest."""
    tails = ["" if i is None else f"|{i}" for i in ids]
    digests = b"".join(hashlib.sha256(f"poisson|{k}{tail}".encode()).digest() for tail in tails for k in range(-(-n // WORDS)))
    words = np.frombuffer(digests, dtype=">u4").astype(np.uint32).reshape(len(ids), -1)[:, :n]
    # Multiples of 2^-32 and steps are compared exactly.
    return np.searchsorted(np.array([math.ceil(step * 4294967296) for step in POISSON_STEPS], dtype=np.uint32), words, side="right").astype(np.int8)


def poisson_means(scored: DataFrame, group: str, value: str, id_: str = "item_id", n: int = REPLICATES) -> DataFrame:
    """group, b, mean under Poisson(1) weights; mean is null where all weights are nought."""
    rows = scored.select(F.col(group).alias("g"), F.col(id_).cast("string").alias("id"), F.col(value).cast("double").alias("v")).filter("v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, np.ndarray] = {}

        def told(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            for g, (s, w) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([g] * n, kind), pa.array(np.arange(n)), pa.array(s), pa.array(w.astype(np.int64))], names=["g", "b", "s", "w"])
            sums.clear()

        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                ids, groups = (part.column(c).dictionary_encode("encode") for c in ("id", "g"))
                weights, of = poisson_weights(ids.dictionary.to_pylist(), n), np.asarray(ids.indices)
                v, place = part.column("v").to_numpy(zero_copy_only=False), np.asarray(groups.indices)
                for k, g in enumerate(groups.dictionary.to_pylist()):
                    here = place == k
                    w = weights[of[here]].astype(np.float64)
                    more = np.stack([v[here] @ w, w.sum(axis=0)])
                    sums[g] = sums[g] + more if g in sums else more
                if len(sums) > MOST_GROUPS:
                    yield from told(part.schema.field("g").type)
        if sums:
            yield from told(batch.schema.field("g").type)

    each = rows.mapInArrow(run, f"g {rows.schema['g'].dataType.simpleString()}, b long, s double, w long")
    return each.groupBy("g", "b").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("mean")).select(F.col("g").alias(group), "b", "mean")
