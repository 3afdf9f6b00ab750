"""Exact interpolated percentiles without a buffer that holds a group's values.

An approximate pass brackets each percentile; a second pass counts what lies below the bracket and
the distinct values inside it, about 4 in ACCURACY of a group's rows, and finds the exact ranks
there by running totals over ranges of them. Groups of ACCURACY rows or fewer are bracketed by their least and greatest value.

Null values and NaN do not count; a group without values has null percentiles; null group keys are
a group of their own; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running_totals

ACCURACY = 10_000


def _same(by: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"_g{i}").eqNullSafe(F.col(c)) for i, c in enumerate(by)], F.lit(True))


def exact_quantiles(rows: DataFrame, by: list[str], column: str, at: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """by, and a column for each name in at, rounded to six places."""
    value = F.col(column).cast("double")
    data = rows.select(*by, F.when(~F.isnan(value), value).alias("_v"))
    margin, points = 2.0 / accuracy, list(at.values())
    sketch = lambda d: F.percentile_approx("_v", F.array(*[F.lit(min(max(p + d, 0.0), 1.0)) for p in points]), F.lit(accuracy))
    groups = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    bounds = data.groupBy(*groups).agg(F.count("_v").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), sketch(-margin).alias("_lo"), sketch(margin).alias("_hi"))
    few = F.col("_n") <= accuracy
    each = []
    for i, p in enumerate(points):
        low = F.when(few | F.lit(p - margin <= 0), F.col("_least")).otherwise(F.get("_lo", F.lit(i)))
        high = F.when(few | F.lit(p + margin >= 1), F.col("_most")).otherwise(F.get("_hi", F.lit(i)))
        each.append(F.struct(F.lit(i).alias("_i"), (F.lit(p) * (F.col("_n") - 1)).alias("_r"), low.alias("_low"), high.alias("_high")))
    keys = [f"_g{i}" for i in range(len(by))]
    brackets = bounds.select(*keys, "_n", F.array(*each).alias("_each"))
    near = data.filter("_v is not null").join(brackets, _same(by)).select(*keys, "_n", "_v", F.inline("_each")).filter("_v <= _high")
    inside = near.groupBy(*keys, "_i", "_r", "_n", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_x")).agg(F.count("*").alias("_c"))
    # What lies below the bracket has a null value and so comes first; the others are ranked range by range.
    upto = running_totals(inside, [*keys, "_i"], "_x", {"_before": "_c"}, ranges=16)
    ranked = upto.withColumn("_to", F.col("_before") + F.col("_c")).withColumn("_k", F.floor("_r"))
    at_rank = lambda k: F.max(F.when((k >= F.col("_to") - F.col("_c")) & (k < F.col("_to")), F.col("_x")))
    found = ranked.groupBy(*keys, "_i", "_r", "_k").agg(at_rank(F.col("_k")).alias("_a"), at_rank(F.least(F.col("_k") + 1, F.col("_n") - 1)).alias("_b"))
    missed = F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double")
    exact = F.when(F.col("_a").isNull() | F.col("_b").isNull(), missed).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_r") - F.col("_k")))
    found = found.select(*[F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)], "_i", exact.alias("_q"))
    wide = found.groupBy(*[f"_f{i}" for i in range(len(by))]).agg(*[F.round(F.max(F.when(F.col("_i") == i, F.col("_q"))), 6).alias(name) for i, name in enumerate(at)])
    same = reduce(Column.__and__, [F.col(f"_g{i}").eqNullSafe(F.col(f"_f{i}")) for i in range(len(by))], F.lit(True))
    return bounds.select(*keys).join(wide, same, "left").select(*[F.col(k).alias(c) for k, c in zip(keys, by)], *at)
