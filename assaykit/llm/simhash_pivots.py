"""SimHash near-dedup with pivot distance tables.

A text's fingerprint has 64 bits, each the majority of that bit over the hashes of the text's
4-word shingles. Fingerprints that differ in at most `radius` bits are linked; documents are
grouped by the connected components of those links.

Pivot distance tables: each distinct fingerprint's Hamming distances to PIVOTS reference
fingerprints are computed once. By the triangle inequality two fingerprints within the radius
differ by at most the radius in every coordinate, so pairs with a larger difference are
discarded; survivors are verified bit by bit. No link is made but of pairs that the pivots let
through. Distances to random references lie near half the bits for all fingerprints alike, so the
table alone would leave a fixed share of all pairs; those that it is asked about come from buckets: 64 bits in b blocks, and
every choice of b - radius blocks is a key. Fingerprints within the radius agree on all blocks
but `radius` at most, so they share a bucket. b grows with the number of fingerprints, so that
chance company in a bucket stays rare.

A bucket of more than SMALL members, a dense group of near copies, is not compared pair by pair.
Its members are first linked to a few representatives, and the links so far are contracted. Where
it is then in several components, the members outside the largest one are compared with the
rest; if they are many, the pairs are found through shared neighbours instead: two fingerprints
within 2 * r bits have a common point within r bits of each, so each member emits the points
around it, and equal points link. Every way is exact, and none emits all pairs of a group.

Defined results: a null or empty text, or one of white space alone, has fingerprint zero and is
linked like any other; a text of fewer than four words is one shingle; texts of any length are
read in chunks; rows repeated get a row each; a null doc_id joins its group, whose id is its
lowest doc_id, null if it has none; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Workspace
from .components import connected_components

SHINGLE_WORDS, SEED, RADIUS, PIVOTS = 4, 42, 4, 16
#: Members of a bucket that are compared pair by pair, and those outside its largest component that are compared with all.
SMALL, FEW = 32, 256
REPRESENTATIVES = 4
CHUNK_BYTES = 1 << 20
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _shingle_hashes(text: str, words_each: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of a text, chunk by chunk."""
    data, at, kept, any_ = text.encode(), 0, [], False
    while at < len(data):
        end = at + CHUNK_BYTES
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = kept + data[at:end].lower().split()
        at = end
        if len(words) < words_each:
            kept = words
            continue
        joined, starts, ends, p = b" ".join(words), [], [], 0
        for w in words:
            starts.append(p)
            p += len(w)
            ends.append(p)
            p += 1
        digest = xxhash.xxh64_intdigest
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words_each - 1 :])], dtype=np.uint64)
        any_, kept = True, words[-(words_each - 1) :] if words_each > 1 else []
    if kept and not any_:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(kept), SEED)], dtype=np.uint64)


def fingerprints(texts: list[str | None], words_each: int = SHINGLE_WORDS) -> np.ndarray:
    """One uint64 for each text."""
    ones, n = np.zeros((len(texts), 64), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    pending: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if not pending:
            return
        who = [i for i, _ in pending]
        local = np.repeat(np.arange(len(pending)), [len(h) for _, h in pending])
        raw = np.concatenate([h for _, h in pending]).astype(">u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            seen = np.bincount(local * 256 + raw[:, k], minlength=256 * len(pending)).reshape(-1, 256)
            np.add.at(ones[:, 8 * k : 8 * k + 8], who, seen @ BITS)
        np.add.at(n, who, [len(h) for _, h in pending])
        pending.clear()

    waiting = 0
    for i, text in enumerate(texts):
        for h in _shingle_hashes(text or "", words_each):
            pending.append((i, h))
            waiting += len(h)
            if waiting > 200_000:
                flush()
                waiting = 0
    flush()
    return np.packbits(2 * ones > n[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for at in range(0, batch.num_rows, 256):
                parts.append(fingerprints(batch.column("text").slice(at, 256).to_pylist()))
            fp = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: the first 64 bits of SHA-256 of their number, as signed longs."""
    return [int.from_bytes(hashlib.sha256(str(i).encode()).digest()[:8], "big", signed=True) for i in range(n)]


def distance_table(fp: Column, refs: list[int]) -> list[Column]:
    """Distances to the references, eight in a long: t0, t1, ..."""
    out = []
    for at in range(0, len(refs), 8):
        packed = [F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(r))).cast("long"), 8 * i) for i, r in enumerate(refs[at : at + 8])]
        out.append(reduce(lambda a, b: a.bitwiseOR(b), packed).alias(f"t{at // 8}"))
    return out


def pivot_bound(radius: int) -> int:
    """How far coordinates of a pair within the radius may differ: by the triangle inequality, as much."""
    return radius


def near(a: str, b: str, radius: int, refs: int) -> Column:
    """Condition of a pair of aliased rows: no coordinate differs by more than the radius, nor do the fingerprints."""
    worst = F.greatest(*[
        F.abs(F.shiftright(F.col(f"{a}.t{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(127)) - F.shiftright(F.col(f"{b}.t{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(127)))
        for i in range(refs)
    ])
    return (worst <= pivot_bound(radius)) & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= radius)


def survives(u: str, v: str, radius: int, refs: list[int]) -> Column:
    """The same condition of a row that holds both fingerprints: the table's rows of two are made on the spot."""
    def apart(a: str, b: str, r: int) -> Column:
        return F.abs(F.bit_count(F.col(a).bitwiseXOR(F.lit(r))) - F.bit_count(F.col(b).bitwiseXOR(F.lit(r))))

    return (F.greatest(*[apart(u, v, r) for r in refs]) <= pivot_bound(radius)) & (F.bit_count(F.col(u).bitwiseXOR(F.col(v))) <= radius)


def discarded(pairs: DataFrame, radius: int = RADIUS, refs: int = PIVOTS) -> DataFrame:
    """Of pairs u, v: n, how many the pivots discard, how many bits decide, and how many link."""
    near_ = F.greatest(*[F.abs(F.bit_count(F.col("u").bitwiseXOR(F.lit(r))) - F.bit_count(F.col("v").bitwiseXOR(F.lit(r)))) for r in pivots(refs)]) <= radius
    both = survives("u", "v", radius, pivots(refs))
    count = lambda c, name: F.sum(c.cast("long")).alias(name)
    return pairs.agg(F.count("*").alias("n"), count(~near_, "by_pivots"), count(near_ & ~both, "by_bits"), count(both, "linked"))


def block_masks(n: int, radius: int) -> list[int]:
    """Masks of all choices of b - radius out of b blocks; b is the least that gives keys of about log2(n) bits."""
    b = radius + 1
    while 64 * (b - radius) // b < max(1, n).bit_length() and b < 16:
        b += 1
    edges = [64 * i // b for i in range(b + 1)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(blocks, b - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _around(fp: Column, r: int) -> Column:
    """All points within r <= 2 bits of a fingerprint."""
    flips = [0] + [1 << i for i in range(64)] + ([(1 << i) | (1 << j) for i, j in combinations(range(64), 2)] if r > 1 else [])
    flips = [f - (1 << 64) if f >> 63 else f for f in flips]
    return F.transform(F.array(*[F.lit(f) for f in flips]), lambda f: fp.bitwiseXOR(f))


def links(prints: DataFrame, work: Workspace, radius: int = RADIUS, refs: int = PIVOTS, small: int = SMALL, few: int = FEW) -> DataFrame:
    """Links (u, v) whose components are those of all pairs within the radius; prints: fp, distinct."""
    if radius % 2 or radius > 4:
        raise ValueError("the radius must be 2 or 4")
    table = work.table(prints.select("fp", *distance_table(F.col("fp"), pivots(refs))), "pivot_table")
    t = [c for c in table.columns if c != "fp"]
    masks = block_masks(table.count(), radius)
    keys = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    keyed = table.select("fp", *t, F.explode(keys).alias("key")).select("fp", *t, "key.m", "key.k")
    tries = [F.min_by("fp", F.xxhash64("fp", F.lit(i))).alias(f"r{i}") for i in range(REPRESENTATIVES)]
    buckets = work.table(keyed.groupBy("m", "k").agg(F.count("*").alias("n"), *tries).filter("n > 1"), "buckets")
    members = work.table(keyed.join(buckets, ["m", "k"]), "members")
    lesser = members.filter(F.col("n") <= small).select("m", "k", "fp", *t)
    pairs = lesser.alias("a").join(
        lesser.alias("b"), (F.col("a.m") == F.col("b.m")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.fp") < F.col("b.fp")) & near("a", "b", radius, refs)
    )
    pairs = pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()
    dense = members.filter(F.col("n") > small)
    stars = dense.select("fp", F.explode(F.array(*[f"r{i}" for i in range(REPRESENTATIVES)])).alias("r"))
    stars = stars.filter((F.col("fp") != F.col("r")) & survives("fp", "r", radius, pivots(refs)))
    stars = stars.select(F.least("fp", "r").alias("u"), F.greatest("fp", "r").alias("v")).distinct()
    found = work.table(pairs.unionByName(stars).distinct(), "links0")
    if dense.isEmpty():
        return found
    return found.unionByName(_between(dense, connected_components(found, work, "c0"), t, work, radius, refs, few))


def _between(dense: DataFrame, components: DataFrame, t: list[str], work: Workspace, radius: int, refs: int, few: int) -> DataFrame:
    """Links between components that share a dense bucket."""
    labelled = dense.select("m", "k", "fp", *t).join(components.withColumnRenamed("v", "fp"), "fp", "left")
    labelled = work.table(labelled.withColumn("c", F.coalesce("c", "fp")), "labelled")
    shares = labelled.groupBy("m", "k", "c").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("m", "k").agg(F.max_by("c", F.struct("n", "c")).alias("top"), (F.sum("n") - F.max("n")).alias("outside"), F.count("*").alias("parts"))
    mixed = work.table(mixed.filter("parts > 1").select("m", "k", "top", "outside"), "mixed")
    rows = work.table(labelled.join(mixed, ["m", "k"]), "mixed_members")
    inside = rows.filter(F.col("outside") <= few)
    out = inside.filter("c != top").alias("a").join(
        inside.alias("b"), (F.col("a.m") == F.col("b.m")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.c") != F.col("b.c")) & near("a", "b", radius, refs)
    )
    out = out.select(F.least("a.fp", "b.fp").alias("u"), F.greatest("a.fp", "b.fp").alias("v")).distinct()
    many = rows.filter(F.col("outside") > few).select("fp").distinct()
    points = many.select("fp", F.explode(_around(F.col("fp"), radius // 2)).alias("point"))
    met = points.groupBy("point").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high").select("point", "low")
    shared = points.join(met, "point").filter((F.col("fp") != F.col("low")) & survives("fp", "low", radius, pivots(refs))).select(F.col("low").alias("u"), F.col("fp").alias("v"))
    return work.table(out.unionByName(shared).distinct(), "links1")


def simhash_groups(spark: SparkSession, docs: DataFrame, radius: int = RADIUS, work: Workspace | None = None) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id."""
    work = work or Workspace(spark, "simhash")
    rows = work.table(fingerprint_rows(docs), "fingerprints")
    prints = work.table(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "prints")
    groups = connected_components(links(prints, work, radius), work, "c1")
    named = prints.join(groups.withColumnRenamed("v", "fp"), "fp", "left").withColumn("c", F.coalesce("c", "fp"))
    named = work.table(named, "named")
    lows = work.table(named.groupBy("c").agg(F.min("low").alias("component_id")), "lows")
    of_print = work.table(named.join(lows, "c").select("fp", "component_id"), "of_print")
    return rows.join(of_print, "fp").select("doc_id", "fp", "component_id")


def simhash_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return simhash_groups(spark, docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
