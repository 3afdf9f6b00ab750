"""Sharding by sampled splitters.

Records are ordered by (key, doc_id), the key being a hash of the text, so equal texts lie side
by side. A size-weighted sample of the order gives quantile boundaries, the records are dealt
to the ranges between them, and exact totals are taken. A range that holds too many bytes or
rows is sampled anew and subdivided, until every range is small. Boundaries fall between groups
of equal texts; only a group that would overfill a range is cut inside, and its ranges stay in
one shard unless it is larger than a shard's share. The ranges are given to the shards, largest
first to the emptiest shard (law "bytes"), and each range's records are numbered from the
range's offset in its shard.

What reaches the driver is the sample and one total for each range. Both follow the chosen
number of ranges; that grows with the rows only so far that a range stays a small task.

Defined results: a null text has no bytes and size 1; an empty table gives no rows; rows
repeated with the same doc_id and text get slots of their own; a null doc_id sorts first; a
text longer than a shard's share makes that shard larger; other columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Workspace

#: Ranges for each shard, and the most rows that a range should hold.
RANGES_PER_SHARD, ROWS_PER_RANGE = 64, 200_000
#: Sampled keys for each range wanted.
OVERSAMPLE = 16
LOWEST = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"), F.coalesce(F.col("doc_id"), F.lit(LOWEST)).cast("long").alias("sub"),
    )


def _unit(*salt: int):
    """A number in [0, 1) that depends on the row alone."""
    return F.pmod(F.xxhash64("key", "sub", *[F.lit(s) for s in salt]), F.lit(1 << 40)) / float(1 << 40)


def _deal(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """Adds bin: how many cuts are at or below (key, sub)."""
    keys = np.array([k for k, _ in cuts], dtype=np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, sub = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "sub"))
            at = np.searchsorted(keys, key, side="right")
            tied = np.flatnonzero(np.searchsorted(keys, key, side="left") < at)
            for i in tied:  # a cut has this very key
                at[i] = bisect_left(cuts, (int(key[i]), int(sub[i]) + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int64))], names=[*batch.schema.names, "bin"])

    return rows.mapInArrow(place, T.StructType([*rows.schema.fields, T.StructField("bin", T.LongType())]))


def _sample(rows: DataFrame, expected: float, total: float, salt: int) -> list[tuple[int, int, float]]:
    """Size-weighted keys: a row is drawn with probability size * expected / total, at most 1; each stands for so many bytes."""
    rate = expected / max(total, 1.0)
    chance = F.least(F.lit(1.0), F.col("size") * rate)
    drawn = rows.filter(_unit(salt) < chance).select("key", "sub", (F.col("size") / chance).alias("w"))
    return sorted((r[0], r[1], r[2]) for r in drawn.collect())


def _quantiles(sample: list[tuple[int, int, float]], pieces: int) -> list[tuple[int, int]]:
    total, out, seen, k = sum(w for *_, w in sample), [], 0.0, 1
    for key, sub, w in sample:
        seen += w
        if k < pieces and seen >= total * k / pieces:
            out.append((key, sub))
            while k < pieces and seen >= total * k / pieces:
                k += 1
    return out


def _split(rows: DataFrame, work: Workspace, shards: int, rounds: int = 8) -> tuple[DataFrame, list[dict]]:
    """Rows with bin, and each bin's bytes, rows and whether it is part of a cut group."""
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    total = float(total or 0)
    pieces = max(shards * RANGES_PER_SHARD, (n or 0) // ROWS_PER_RANGE)
    most_bytes, most_rows = 2 * total / pieces, 2 * max(1.0, n / pieces)
    # A group of equal texts that fills a range alone is a range, or several; there are at most 4 * pieces of those.
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    huge = {r[0]: r[1] for r in groups.filter((F.col("bytes") > most_bytes / 2) | (F.col("rows") > most_rows / 2)).select("key", "bytes").collect()}
    whole = lambda cuts: {(k, s) if k in huge else (k, LOWEST) for k, s in cuts}
    cuts = whole(_quantiles(_sample(rows, OVERSAMPLE * pieces, total, 0), pieces))
    cuts |= {(k, LOWEST) for k in huge} | {(k + 1, LOWEST) for k in huge if k < (1 << 63) - 1}
    closer = 1
    for r in range(1, rounds + 1):
        dealt = _deal(rows, sorted(cuts))
        sums = dealt.groupBy("bin").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
        bins = [x.asDict() for x in sums.collect()]
        full = [b for b in bins if (b["bytes"] > most_bytes or b["rows"] > most_rows) and (b["low"] != b["high"] or b["low"] in huge) and b["rows"] > 1]
        if not full:
            break
        if r == rounds and closer > 1:
            break  # even dense samples show no boundary in what is left, such as rows larger than a range
        if r == rounds:
            raise RuntimeError(f"{len(full)} ranges are still overfull")
        # One row for each full range, of which there are as many as ranges at most.
        inside = dealt.join(F.broadcast(dealt.sparkSession.createDataFrame([(b["bin"],) for b in full], "bin long")), "bin", "left_semi")
        extra = sum(int(b["bytes"] // max(most_bytes, 1)) + 1 for b in full) * 2
        found: dict[int, list] = {}
        at = sorted(cuts)
        for key, sub, w in _sample(inside, OVERSAMPLE * extra * closer, sum(b["bytes"] for b in full), r):
            found.setdefault(bisect_left(at, (key, sub + 1)), []).append((key, sub, w))
        new = set().union(*(whole(_quantiles(s, 2 * (int(len(s) / OVERSAMPLE) + 1))) for s in found.values())) - cuts
        # A sample that shows no new boundary is drawn more densely in the next round.
        closer = 1 if new else min(closer * 8, 512)
        cuts |= new
    for b in bins:  # ranges of one group stay together if a shard can hold the group
        b["unit"] = ("group", b["low"]) if b["low"] == b["high"] and huge.get(b["low"], total) <= total / shards else ("range", b["bin"])
    return work.table(dealt, "dealt"), bins


def _fill(bins: list[dict], shards: int) -> list[dict]:
    """Largest unit first, each to the shard with the fewest bytes so far."""
    units: dict[tuple, list[dict]] = {}
    for b in sorted(bins, key=lambda b: b["bin"]):
        units.setdefault(b["unit"], []).append(b)
    heap, out = [(0, s, 0) for s in range(shards)], []
    for unit in sorted(units.values(), key=lambda u: (-sum(b["bytes"] for b in u), u[0]["bin"])):
        had, s, rows = heapq.heappop(heap)
        for b in unit:
            out.append({"bin": b["bin"], "shard": s, "first": rows})
            had, rows = had + b["bytes"], rows + b["rows"]
        heapq.heappush(heap, (had, s, rows))
    return out


def shard_by_bytes(spark: SparkSession, docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    work = Workspace(spark, "sharding")
    rows = work.table(_keyed(docs), "keyed")
    dealt, bins = _split(rows, work, shards)
    given = spark.createDataFrame([(b["bin"], b["shard"], b["first"]) for b in _fill(bins, shards)], "bin long, shard int, first long")
    ranked = dealt.selectExpr("*", "row_number() over (partition by bin order by key, sub, size, text_crc32) - 1 as rn")
    return ranked.join(given, "bin").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rn")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """The documents as files, one folder for each shard, in slot order; one shard's files are written by many tasks."""
    placed = placed.select(F.col("doc_id").alias("_doc_id"), "shard", "slot")
    joined = docs.join(placed, docs["doc_id"] == placed["_doc_id"]).drop("_doc_id")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
