"""Gates: one row each of name, measured value, threshold, pass and the reason of a failure.

Defined results: a null value, or one that is no number, does not pass; a value at the threshold does;
a frame without a row gives no gate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(rows: DataFrame, name: str, value: Column, threshold: float, passes: Column, reason: str) -> DataFrame:
    """rows has one row; a null value does not pass."""
    ok = F.coalesce(passes & ~F.isnan(value.cast("double")), F.lit(False))
    return rows.select(
        F.lit(name).alias("gate"), F.round(value.cast("double"), 6).alias("value"), F.lit(float(threshold)).alias("threshold"), ok.alias("pass"),
        F.when(ok, "").otherwise(reason).alias("reason"),
    )


def at_most(rows: DataFrame, name: str, column: str, threshold: float, reason: str) -> DataFrame:
    return gate(rows, name, F.col(column), threshold, F.col(column) <= threshold, reason)


def at_least(rows: DataFrame, name: str, column: str, threshold: float, reason: str) -> DataFrame:
    return gate(rows, name, F.col(column), threshold, F.col(column) >= threshold, reason)
