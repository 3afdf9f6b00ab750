"""Near copies by fingerprint and by shingles: what the pipeline drops.

SimHash with a radius of 4 of 64 bits finds few of the pairs whose shingle sets have a similarity
of 0.8, so the groups here are those of simhash_pivots joined with links of such pairs. Candidates
share a band of min-wise hashes of their five-word shingles; each is verified on the two texts'
whole shingle sets.

A band's bucket may hold thousands of near copies. Its members are paired with two of them first;
those of a small bucket with all. For each document, the partner that it shares the most bands
with is verified first; what the links so far join is not compared again, only pairs between
different components are. Where members of a large bucket are then still in several components,
the few that meet the most others are compared with the bucket's other components, and what that
leaves apart is joined exactly, on the rarest shingles of which similar sets must share one.

Defined results: a text of fewer than five words is one shingle; a null or empty text has none and
is linked by its fingerprint only; rows repeated whole are one; a null doc_id comes last when a
group's survivor is chosen; an empty table gives no rows; other columns are kept, not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simhash_pivots
from ._common import Workspace, fresh, join_same, row_keys, take_worker
from .components import connected_components

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 5
#: Members of a bucket that are paired with each other.
SMALL = 8
#: Members of a large bucket that are compared with its other components first; places of a shared shingle's rows.
FIRST, SALTS = 4, 16
_RANDOM = np.random.Generator(np.random.PCG64(20))
FACTORS = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes, in order."""
    parts = list(simhash_pivots._shingle_hashes(text or "", words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def bands(hashes: np.ndarray) -> list[int]:
    """One key for each band, from ROWS minima each; none for no hashes."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (FACTORS[:, None] * hashes[None, at : at + 2048] + OFFSETS[:, None]).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _scan(docs: DataFrame) -> DataFrame:
    """doc_id, th, fp, bands in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("shingles")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = some.column("text").to_pylist()
                fp = pa.array(simhash_pivots.fingerprints(texts).view(np.int64), pa.int64())
                keys = pa.array([bands(shingles(t)) for t in texts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("th"), fp, keys], names=["doc_id", "th", "fp", "bands"])

    rows = row_keys(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "th", "text")
    return rows.mapInArrow(run, "doc_id long, th long, fp long, bands array<long>")


def _shingle_sets(docs: DataFrame) -> DataFrame:
    """vid, s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("shingles")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                sets = [shingles(t.as_py()).view(np.int64) for t in some.column("text")]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                s = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([some.column("vid"), s], names=["vid", "s"])

    return docs.select("vid", "text").mapInArrow(run, "vid long, s array<long>")


def _candidates(rows: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """u < v, and how many bands they meet in; rows: vid, bands. Beside them the members of large buckets that were not paired with all."""
    each = rows.select("vid", F.posexplode("bands").alias("b", "k"))
    picks = [F.min("vid").alias("r0"), F.min_by("vid", F.xxhash64("vid", F.lit(1))).alias("r1")]
    buckets = work.table(each.groupBy("b", "k").agg(F.count("*").alias("n"), *picks).filter("n > 1"), "band_buckets")
    members = work.table(each.join(buckets, ["b", "k"]), "band_members")
    stars = members.select("vid", F.explode(F.array_distinct(F.array("r0", "r1"))).alias("r"))
    few = members.filter(F.col("n") <= SMALL).select("b", "k", "vid")
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.b") == F.col("y.b")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.vid") < F.col("y.vid")))
    both = stars.unionByName(pairs.select(F.col("x.vid").alias("vid"), F.col("y.vid").alias("r"))).filter("vid <> r")
    large = members.filter((F.col("n") > SMALL) & (F.col("vid") != F.col("r0")) & (F.col("vid") != F.col("r1"))).select("b", "k", "vid", "n")
    return both.groupBy(F.least("vid", "r").alias("u"), F.greatest("vid", "r").alias("v")).agg(F.count("*").alias("n")), large


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    a, b = sets.select(F.col("vid").alias("u"), F.col("s").alias("a")), sets.select(F.col("vid").alias("v"), F.col("s").alias("b"))
    both = pairs.select("u", "v").join(a, "u").join(b, "v").withColumn("i", F.size(F.array_intersect("a", "b")))
    return both.filter(F.col("i") >= similarity * (F.size("a") + F.size("b") - F.col("i"))).select("u", "v")


def _labels(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    return connected_components(edges, work, name).select(F.col("v").alias("vid"), "c")


def _named(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with c, the component of vid."""
    return rows.join(groups, "vid", "left").withColumn("c", F.coalesce("c", "vid"))


def _joined(groups: DataFrame, links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """groups (vid, c) with the components joined that links (u, v) lie between."""
    if links.isEmpty():
        return groups
    ends = _named(_named(links.withColumnRenamed("u", "vid"), groups).select(F.col("c").alias("cu"), F.col("v").alias("vid")), groups)
    pairs = ends.select(F.least("c", "cu").alias("u"), F.greatest("c", "cu").alias("v")).distinct()
    above = work.table(_labels(pairs, work, name), f"{name}_above")
    below = groups.join(above.select(F.col("vid").alias("c"), F.col("c").alias("to")), "c", "left").select("vid", F.coalesce("to", "c").alias("c"))
    return work.table(below.unionByName(above), f"{name}_groups")


def _mixed(large: DataFrame, groups: DataFrame, work: Workspace, name: str) -> DataFrame:
    """The rows of large in buckets of several components, with c, and top, the bucket's component of most members."""
    named = work.table(_named(large, groups), f"{name}_named")
    shares = named.groupBy("b", "k", "c").agg(F.count("*").alias("m"))
    mixed = shares.groupBy("b", "k").agg(F.max_by("c", F.struct("m", "c")).alias("top"), F.count("*").alias("parts")).filter("parts > 1").select("b", "k", "top")
    return work.table(named.join(mixed, ["b", "k"]), f"{name}_rows")


def _rare_pairs(rows: DataFrame, sets: DataFrame, work: Workspace, similarity: float) -> DataFrame:
    """u < v of different components, one outside its bucket's largest, that can reach the similarity by their rarest shingles.

    Two sets of p and q shingles that reach it share at least `same` of them, so in any one order of
    all shingles they share one among the first p - same + 1 and q - same + 1. The order is by rarity
    among the members here: those that differ from all others by more than the similarity allows have
    shingles of their own there, and meet nobody.
    """
    of = rows.groupBy("vid", "c").agg(F.max(F.col("c") != F.col("top")).alias("out"))
    each = of.join(sets, "vid").select("vid", "c", "out", F.size("s").alias("size"), F.explode("s").alias("h")).withColumn("salt", F.pmod("vid", F.lit(SALTS)).cast("int"))
    each = work.table(each, "rare_each")
    # A shingle may be in a third of all members: its rows meet their count in SALTS places.
    shared = each.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    at = F.row_number().over(Window.partitionBy("vid").orderBy(F.coalesce("df", F.lit(1)), "h"))
    ranked = each.join(shared, ["h", "salt"], "left").withColumn("at", at)
    ranked = ranked.filter(F.col("df").isNotNull() & (F.col("at") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1))
    ranked = work.table(ranked.select("h", "vid", "c", "out", "size", "at"), "rare_ranked")
    same = F.ceil((F.col("x.size") + F.col("y.size")) * (similarity / (1 + similarity)) - 1e-9)
    within = (F.col("x.at") <= F.col("x.size") - same + 1) & (F.col("y.at") <= F.col("y.size") - same + 1)
    met = ranked.filter("out").alias("x").join(ranked.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.c") != F.col("y.c")) & within)
    return met.select(F.least("x.vid", "y.vid").alias("u"), F.greatest("x.vid", "y.vid").alias("v")).distinct()


def _between(large: DataFrame, groups: DataFrame, sets: DataFrame, work: Workspace, similarity: float) -> DataFrame:
    """groups (vid, c), with components joined that share a large bucket and hold a similar pair in it; large: b, k, vid, n."""
    rows = _mixed(large, groups, work, "large")
    if rows.isEmpty():
        return groups
    sizes = sets.select("vid", F.size("s").alias("size"))
    weights = rows.groupBy("vid").agg(F.sum("n").alias("w")).join(sizes, "vid")
    sized = work.table(rows.drop("n").join(weights, "vid"), "large_sized")
    first = Window.partitionBy("b", "k").orderBy(F.desc("w"), "vid")
    picked = sized.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= FIRST)
    picked = work.table(picked.select("b", "k", F.col("vid").alias("r"), F.col("c").alias("rc"), F.col("size").alias("rsize")), "large_picked")
    alike = F.least("size", "rsize") >= similarity * F.greatest("size", "rsize")
    met = sized.join(picked, ["b", "k"]).filter((F.col("c") != F.col("rc")) & alike)
    pairs = work.table(met.select(F.least("vid", "r").alias("u"), F.greatest("vid", "r").alias("v")).distinct(), "large_pairs")
    groups = _joined(groups, work.table(_verified(pairs, sets, similarity), "large_links"), work, "large")
    rows = _mixed(rows.select("b", "k", "vid"), groups, work, "rest")
    if rows.isEmpty():
        return groups
    pairs = work.table(_rare_pairs(rows, sets, work, similarity), "rare_pairs")
    return _joined(groups, work.table(_verified(pairs, sets, similarity), "rare_links"), work, "rare")


def near_copy_groups(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, work: Workspace | None = None) -> DataFrame:
    """doc_id, th, c of each distinct (doc_id, text): equal c, one group."""
    work = work or Workspace(spark, "near-copies")
    # Vertices are numbered as they are written, so no two share a number; the table keeps the numbers of tasks that are run again apart.
    rows = _scan(docs).dropDuplicates(["doc_id", "th"]).select("doc_id", "th", "fp", "bands", F.monotonically_increasing_id().alias("vid"))
    rows = work.table(rows, "rows")
    # Groups of fingerprints, as stars.
    prints = work.table(rows.groupBy("fp").agg(F.min("vid").alias("low"), F.count("*").alias("n")), "prints")
    of = connected_components(simhash_pivots.links(prints, work), work, "prints").withColumnRenamed("v", "fp")
    named = prints.join(of, "fp", "left").withColumn("g", F.coalesce("c", "fp")).select("fp", "low", "g")
    named = work.table(named, "named")
    hubs = work.table(named.groupBy("g").agg(F.min("low").alias("hub")), "hubs")
    hub_of = work.table(named.join(hubs, "g").select("fp", "hub"), "hub_of")
    stars = rows.select("vid", "fp").join(hub_of, "fp").filter("vid <> hub").select(F.least("vid", "hub").alias("u"), F.greatest("vid", "hub").alias("v"))
    stars = work.table(stars, "stars")
    # Candidates between different groups, by bands.
    pairs, large = _candidates(rows.select("vid", "bands"), work)
    pairs = work.table(pairs, "candidates")
    paired = work.table(pairs.select(F.explode(F.array("u", "v")).alias("vid")).distinct(), "paired")
    wanted = rows.select("doc_id", "th", "vid").join(paired, "vid")
    texts = join_same(row_keys(docs), wanted.hint("shuffle_hash"), ["doc_id", "th"])
    sets = work.table(_shingle_sets(texts).dropDuplicates(["vid"]), "sets")
    best = pairs.groupBy("v").agg(F.max_by("u", F.struct("n", "u")).alias("u")).select("u", "v")
    found = work.table(stars.unionByName(_verified(best, sets, similarity)).distinct(), "links_best")
    groups = work.table(_labels(found, work, "best"), "groups_best")
    left = pairs.join(groups.select(F.col("vid").alias("u"), F.col("c").alias("cu")), "u", "left").join(groups.select(F.col("vid").alias("v"), F.col("c").alias("cv")), "v", "left")
    left = left.filter(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")
    rest = work.table(_verified(left, sets, similarity), "links_rest")
    final = work.table(_labels(found.unionByName(rest).distinct(), work, "all"), "groups_all") if not rest.isEmpty() else groups
    final = _between(large, final, sets, work, similarity)
    return rows.join(final, "vid", "left").select("doc_id", "th", F.coalesce("c", "vid").alias("c"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs with the lowest doc_id of their group, with all their columns; of rows repeated whole, all."""
    work = Workspace(spark, "near-copies")
    groups = work.table(near_copy_groups(spark, docs, similarity, work), "groups")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    stay = work.table(groups.groupBy("c").agg(F.min(first).alias("k")).select("k.doc_id", "k.th"), "stay")
    (th,) = fresh(docs.columns, "th")
    keyed = docs.withColumn(th, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    return join_same(keyed, stay.withColumnRenamed("th", th).hint("shuffle_hash"), ["doc_id", th], "left_semi").drop(th)
