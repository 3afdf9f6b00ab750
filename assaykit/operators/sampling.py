"""Seeded samples by hash order: the same rows on any partitioning and in any engine.

Defined results: rows stand by the hash of their id, then by the id; rows that share an id are rows of
their own, in no defined order among each other; a null id has the hash of the seed alone; a null group
is a group; a group with fewer rows than asked for is taken whole; no rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import bucket


def _ranked(df: DataFrame, by: list[str], id_: str, seed: int, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(id_)), 256), F.col(id_))
    return df.withColumn(name, F.row_number().over(w))


def cap(df: DataFrame, by: list[str], n: int, seed: int, id_: str = "item_id") -> DataFrame:
    """At most n rows of each group, the first in hash order.

    Rows beyond the n-th cannot be reached by a hash prefix that already holds n of them, but a
    group is ranked whole here; Spark keeps a running top n of each group before the shuffle
    (window group limit).
    """
    return _ranked(df, by, id_, seed, "_rank").filter(F.col("_rank") <= n).drop("_rank")


def balanced(df: DataFrame, by: list[str], label: str, seed: int, id_: str) -> DataFrame:
    """As many rows of each label, in each group, as its rarest label there has."""
    sizes = df.groupBy(*by, label).count()
    least = sizes.groupBy(*by).agg(F.min("count").alias("_least"), F.count("*").alias("_labels"))
    ranked = _ranked(df, [*by, label], id_, seed, "_rank").join(least, by)
    return ranked.filter((F.col("_labels") > 1) & (F.col("_rank") <= F.col("_least"))).drop("_rank", "_least", "_labels")


def stratified(df: DataFrame, by: str, spread: str, n: int, seed: int, id_: str = "item_id") -> DataFrame:
    """n rows of each `by`, dealt in turn from its `spread` values; adds their order as pick."""
    ranked = _ranked(df, [by, spread], id_, seed, "_turn").filter(F.col("_turn") <= n)  # later turns can't be among the first n picks
    w = Window.partitionBy(by).orderBy("_turn", spread, id_)
    return ranked.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= n).drop("_turn")


def fifth(record_id: Column | str) -> Column:
    """0 to 4 by record: every item of a record has the same."""
    return bucket(record_id) % 5


def half(item_id: Column | str) -> Column:
    return bucket(F.lit("half"), item_id) % 2


def distractors(options: Column | str, gold: Column, n: Column | int, *salt: Column) -> Column:
    """The first n wrong options in hash order."""
    wrong = F.filter(options, lambda o: o["key"] != gold)
    ranked = F.transform(wrong, lambda o: F.struct(F.sha2(F.concat_ws("|", *salt, o["key"]), 256).alias("h"), o.alias("o")))
    return F.transform(F.slice(F.array_sort(ranked), F.lit(1), F.lit(n) if isinstance(n, int) else n), lambda r: r["o"])
