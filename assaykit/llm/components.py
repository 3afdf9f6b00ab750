"""Connected components by alternating large-star and small-star rounds on written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace


def _large_star(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = work.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
    return both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v").distinct()


def _small_star(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    least = work.table(edges.groupBy("v").agg(F.min("u").alias("m")), f"{name}-least")
    rest = edges.join(least, "v").filter("u != m").select(F.col("m"), F.col("u").alias("w"))
    return rest.unionByName(least.select("m", F.col("v").alias("w"))).select(F.least("m", "w").alias("u"), F.greatest("m", "w").alias("v")).distinct()


def connected_components(edges: DataFrame, work: Workspace, name: str, rounds: int = 100) -> DataFrame:
    """v, c: every vertex of an edge but the least of its component, and that least. edges: u < v, longs."""
    edges, before = work.table(edges.select("u", "v"), f"{name}-0"), None
    for r in range(1, rounds + 1):
        large = work.table(_large_star(edges, work, f"{name}-{r}l"), f"{name}-{r}l")
        edges = work.table(_small_star(large, work, f"{name}-{r}s"), f"{name}-{r}s")
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select("v", F.col("u").alias("c"))
