"""Scores of predictions joined to their items.

`scored` has, for each item and model: ok (the prediction is the gold), conf (top probability),
brier, nll, and whatever it is grouped by. All metrics are partial aggregates: what is shuffled
is one row per group and task.

Defined results: a null ok, conf or brier counts in n and in no mean; rows without a confidence have a
bin of their own, null, which adds nothing to the calibration error; predictions that repeat an item are
rows of their own in means and one in coverage; a null group is a group; of equal probabilities the first
is the prediction; no rows give no groups, and one row of nulls where nothing is grouped by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.probs import argmax, bin15, brier, nll
from .quantiles import exact_quantiles


def score(items: DataFrame, predictions: DataFrame) -> DataFrame:
    """Items (item_id, gold_index, ...) with their predictions (item_id, model, probs, ...)."""
    rows = items.join(predictions, "item_id")
    return rows.select(
        "*", (argmax("probs") == F.col("gold_index")).alias("ok"), F.array_max("probs").alias("conf"),
        brier("probs", "gold_index").alias("brier"), nll("probs", "gold_index").alias("nll"),
    )


def _share(c: str):
    return F.avg(F.col(c).cast("double"))


def accuracy(scored: DataFrame, by: list[str]) -> DataFrame:
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.round(_share("ok"), 6).alias("accuracy"))


def macro_accuracy(scored: DataFrame, by: list[str], over: str = "template_id") -> DataFrame:
    """Mean of the accuracies of the templates."""
    each = scored.groupBy(*by, over).agg(_share("ok").alias("a"))
    return each.groupBy(*by).agg(F.count("*").alias("templates"), F.round(F.avg("a"), 6).alias("macro_accuracy"))


def majority(items: DataFrame, by: list[str], gold: str = "gold") -> DataFrame:
    """Share of the most frequent gold."""
    each = items.groupBy(*by, gold).agg(F.count("*").alias("n"))
    return each.groupBy(*by).agg(F.sum("n").alias("n"), F.round(F.max("n").cast("double") / F.sum("n").cast("double"), 6).alias("majority"))


def mean_of(scored: DataFrame, by: list[str], column: str, alias: str | None = None) -> DataFrame:
    return scored.groupBy(*by).agg(F.round(F.avg(column), 6).alias(alias or column))


def reliability(scored: DataFrame, by: list[str]) -> DataFrame:
    """n, mean confidence and accuracy of each of the 15 bins in use."""
    rows = scored.withColumn("bin", bin15("conf"))
    return rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("conf").alias("confidence"), _share("ok").alias("accuracy"))


def ece(scored: DataFrame, by: list[str]) -> DataFrame:
    """Expected calibration error over the bins."""
    bins = reliability(scored, by)
    gap = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")
    return bins.groupBy(*by).agg(F.sum("n").alias("n"), F.round(gap, 6).alias("ece"))


def summary(scored: DataFrame, by: list[str]) -> DataFrame:
    """n, accuracy, mean Brier score and calibration error from one aggregate by bin; null scores count in none of the means."""
    ok = F.col("ok").cast("double")
    bins = scored.groupBy(*by, bin15("conf").alias("bin")).agg(
        F.count("*").alias("n"), F.count(ok).alias("told"), F.sum(ok).alias("right"), F.avg("conf").alias("c"), F.sum("brier").alias("b"), F.count("brier").alias("nb")
    )
    gap = F.sum(F.col("n") * F.abs(F.try_divide("right", F.col("told")) - F.col("c"))) / F.sum("n")
    return bins.groupBy(*by).agg(
        F.sum("n").alias("n"), F.round(F.try_divide(F.sum("right"), F.sum("told")), 6).alias("accuracy"),
        F.round(F.try_divide(F.sum("b"), F.sum("nb")), 6).alias("brier"), F.round(gap, 6).alias("ece"),
    )


def quantiles(rows: DataFrame, by: list[str], column: str, at: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles."""
    return exact_quantiles(rows, by, column, at)


def coverage(items: DataFrame, predictions: DataFrame, by: list[str]) -> DataFrame:
    """How many of the items have a prediction; an item predicted more than once counts once."""
    rows = items.join(predictions.select("item_id").distinct().withColumn("_hit", F.lit(1)), "item_id", "left")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("_hit").alias("predicted"), F.round(F.count("_hit").cast("double") / F.count("*").cast("double"), 6).alias("coverage")
    )
