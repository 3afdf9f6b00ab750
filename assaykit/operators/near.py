"""Options of a vocabulary that lie one edit apart, by deletion neighbourhoods.

Two strings one substitution apart are equal without the character at one place, so each offers itself
without its k-th character, for every k, and equal offers meet. Two strings one insertion apart meet
where one's offer is the other itself. Nothing else is compared, so no list of all options is needed.

Defined results: nulls are no options; repeated options are one; the empty string is one edit from every
string of one character; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def near_pairs(values: DataFrame, column: str) -> DataFrame:
    """a < b of distinct values one edit apart."""
    words = values.select(F.col(column).alias("w")).filter("w is not null").distinct()
    places = F.when(F.length("w") > 0, F.sequence(F.lit(1), F.greatest(F.length("w"), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    without = lambda k: F.concat(F.substring("w", F.lit(1), k - 1), F.substring("w", k + 1, F.length("w")))
    offers = words.withColumn("k", F.explode(places)).select("w", "k", without(F.col("k")).alias("rest"))
    x, y = offers.alias("x"), offers.alias("y")
    swapped = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.rest") == F.col("y.rest")) & (F.col("x.w") < F.col("y.w"))).select(F.col("x.w").alias("a"), F.col("y.w").alias("b"))
    grown = offers.select("w", "rest").distinct().join(words.select(F.col("w").alias("rest")), "rest")
    grown = grown.select(F.least("w", "rest").alias("a"), F.greatest("w", "rest").alias("b"))
    return swapped.unionByName(grown).distinct()
