"""Variants of items that probe a model: shuffled options, more candidates, none of the above."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_order, stable_id

NOTA = "None of the above"


def shuffled(items: DataFrame, seed: int) -> DataFrame:
    """A second seeded permutation of the options; parent_id is the item varied."""
    rows = items.withColumn("parent_id", F.col("item_id")).withColumn("options", hash_order("options", F.lit(f"shuffle{seed}"), F.col("item_id")))
    return rows.withColumn("variant", F.lit("shuffle")).withColumn("item_id", stable_id("parent_id", "variant", F.lit(str(seed))))


def none_of_the_above(items: DataFrame) -> DataFrame:
    """The gold option gives way to a last option that denies all others, which becomes the gold."""
    nota = F.struct(F.lit("nota").alias("key"), F.lit(NOTA).alias("label"), F.lit(None).cast("string").alias("description"))
    kept = F.filter("options", lambda o: o["key"] != F.col("gold"))
    rows = items.withColumn("parent_id", F.col("item_id")).withColumn("options", F.array_append(kept, nota)).withColumn("gold", F.lit("nota"))
    return rows.withColumn("variant", F.lit("nota")).withColumn("item_id", stable_id("parent_id", "variant"))


def candidate_counts(items: DataFrame, counts: tuple[int, ...], seed: int) -> DataFrame:
    """For each k up to the number of options: the gold and k - 1 distractors, in seeded order."""
    rows = items.withColumn("parent_id", F.col("item_id"))
    # Options are hashed once; each k takes a prefix of the wrong ones and sorts by the second hash.
    digest = lambda salt, o: F.sha2(F.concat_ws("|", F.lit(f"{salt}{seed}"), F.col("parent_id"), o["key"]), 256)
    placed = lambda o: F.struct(digest("order", o).alias("at"), o.alias("o"))
    wrong = F.transform(F.filter("options", lambda o: o["key"] != F.col("gold")), lambda o: F.struct(digest("k", o).alias("h"), placed(o).alias("p")))
    right = F.transform(F.filter("options", lambda o: o["key"] == F.col("gold")), placed)
    rows = rows.withColumn("_wrong", F.transform(F.array_sort(wrong), lambda r: r["p"])).withColumn("_right", right)
    rows = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in counts]))).filter(F.size("options") >= F.col("k"))
    chosen = F.array_sort(F.concat("_right", F.slice("_wrong", F.lit(1), F.col("k") - 1)))
    rows = rows.withColumn("options", F.transform(chosen, lambda r: r["o"])).drop("_wrong", "_right")
    return rows.withColumn("variant", F.concat(F.lit("k"), F.col("k").cast("string"))).withColumn("item_id", stable_id("parent_id", "variant"))


def flip_rate(base: DataFrame, varied: DataFrame, by: list[str]) -> DataFrame:
    """Share of items whose predicted content changes: both have parent_id and content."""
    both = base.select("parent_id", *by, "content").join(varied.select("parent_id", *by, F.col("content").alias("other")), ["parent_id", *by])
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg((F.col("content") != F.col("other")).cast("double")), 6).alias("flip_rate"))


def abstention(base: DataFrame, nota: DataFrame, by: list[str]) -> DataFrame:
    """detection: share of NOTA variants answered so; false_rejection: share of plain items answered so."""
    rows = base.select(*by, F.lit(False).alias("varied"), "content").unionByName(nota.select(*by, F.lit(True).alias("varied"), "content"))
    said = (F.col("content") == "nota").cast("double")
    return rows.groupBy(*by).agg(
        F.round(F.avg(F.when(F.col("varied"), said)), 6).alias("detection"), F.round(F.avg(F.when(~F.col("varied"), said)), 6).alias("false_rejection")
    )
