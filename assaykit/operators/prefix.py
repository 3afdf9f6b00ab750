"""Running totals of groups of any size: no window holds a whole group.

Approximate quantiles of a group's own order column part it into ranges; the ranges' totals, a few
for each group, give each range its offset; only a range is scanned in order.

Defined results: rows of one order value lie in one range, in no defined order among each other, so
give them one row first where that matters; a null value adds nothing; a null order comes first; a null
group is a group; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a group.
RANGES = 64


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of one name in which nulls equal each other."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(other, cond, how).drop(*(f"_right_{k}" for k in keys))


def running_totals(rows: DataFrame, by: list[str], order: str, totals: dict[str, str], ranges: int = RANGES) -> DataFrame:
    """rows with, for each name: column of totals, the sum of that column over the rows of the group that come before."""
    steps = F.array(*[F.lit(i / ranges).cast("double") for i in range(1, ranges)])
    cuts = rows.groupBy(*by).agg(F.array_distinct(F.percentile_approx(order, steps, F.lit(10_000))).alias("_cuts"))
    before: Column = F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    parted = same(rows, cuts, by).withColumn("_range", F.when(F.col(order).isNull() | F.col("_cuts").isNull(), -1).otherwise(before)).drop("_cuts")
    sums = parted.groupBy(*by, "_range").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_sum_{n}") for n, c in totals.items()])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most `ranges` + 1 rows of a group
    offsets = sums.select(*by, "_range", *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_from_{n}") for n in totals])
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = same(parted, offsets, [*by, "_range"])
    return out.withColumns({n: F.col(f"_from_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in totals.items()}).drop("_range", *(f"_from_{n}" for n in totals))
