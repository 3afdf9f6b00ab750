"""A source's items for a window of dates: the same arguments give the same items."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .items import label_boxed, label_class, label_route, paper_humans, paper_topic, paper_type, trial_allocation, trial_healthy, trial_intervention, trial_phase, trial_purpose

Template = Callable[[DataFrame, int], DataFrame]


def templates(source: str, **answers: tuple[str, ...]) -> list[Template]:
    """A source's templates; purposes, kinds and routes are the answers of those whose options are no fixed list."""
    every: dict[str, list[Template]] = {
        "trials": [
            trial_phase, trial_allocation, trial_healthy,
            lambda r, seed: trial_purpose(r, seed, answers["purposes"]), lambda r, seed: trial_intervention(r, seed, answers["kinds"]),
        ],
        "labels": [label_class, label_boxed, lambda r, seed: label_route(r, seed, answers["routes"])],
        "pubmed": [paper_type, paper_humans, paper_topic],
    }
    return every[source]


#: A record's id and date, by source.
KEYS = {"trials": ("nct_id", "first_posted"), "labels": ("set_id", "effective_date"), "pubmed": ("pmid", "entry_date")}


def in_window(records: DataFrame, key: str, date: str, start: str, end: str) -> DataFrame:
    """Records dated in [start, end] whose id has no earlier date; a null id or date is in no window."""
    dated = records.filter(F.col(key).isNotNull() & (F.col(date) <= F.lit(end).cast("date")))
    first = F.min(date).over(Window.partitionBy(key))
    return dated.withColumn("_first", first).filter(F.col("_first") >= F.lit(start).cast("date")).drop("_first")


def build(records: DataFrame, source: str, start: str, end: str, seed: int, makers: Sequence[Template]) -> DataFrame:
    """Items of all templates; they follow from the arguments alone, on any partitioning."""
    key, date = KEYS[source]
    fresh = in_window(records, key, date, start, end)
    return reduce(DataFrame.unionByName, [make(fresh, seed) for make in makers])
