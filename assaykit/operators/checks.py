"""Invariants as queries that return the offending rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digests listed together, about.
MOST_LISTED = 4096


def split_leaks(items: DataFrame) -> DataFrame:
    """Records that stand in more than one split."""
    by = ["source", "source_record_id"]
    return items.groupBy(*by).agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def stale(items: DataFrame, start: Column) -> DataFrame:
    return items.filter((F.col("tier") == "fresh") & (F.col("record_date") < start))


def unpredicted(items: DataFrame, predictions: DataFrame) -> DataFrame:
    return items.join(predictions.select("item_id").distinct(), "item_id", "left_anti")


def unknown_predictions(items: DataFrame, predictions: DataFrame) -> DataFrame:
    return predictions.join(items.select("item_id").distinct(), "item_id", "left_anti")


def rebuild_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two builds has."""
    return a.exceptAll(b).withColumn("only", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only", F.lit("second")))


def content_hash(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """Order-free digest of a column's values: SHA-256 of the sorted values' own digests, folded by prefix so that no task holds a group whole.

    The prefix has two hex digits up to a million rows, and one more for each 16 times as many, so a
    list stays at some thousands. Null values are left out; an empty table gives no rows.
    """
    digits, n = 2, rows.count()
    while n > MOST_LISTED << 4 * digits:
        digits += 1
    digest = F.sha2(F.col(column).cast("string"), 256)
    parts = rows.groupBy(*by, F.substring(digest, 1, digits).alias("_p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(digest)), ""), 256).alias("_h"))
    return parts.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_h"))), lambda s: s["_h"]), ""), 256).alias("sha256"))


def tree_difference(a: DataFrame, b: DataFrame, key: str, keep: Callable[[DataFrame], DataFrame], digits: int = 2, levels: int = 3) -> DataFrame:
    """Rows that only one of two builds has, with `only`, found by a tree of hashes.

    A row lies under the prefixes of its key's digest. Sums of row digests are compared prefix by prefix,
    each level only under the prefixes that differed above; rows are compared only where the last level
    differs. Each level reads the rows and shuffles one sum per prefix and task; equal builds shuffle no row.
    Rows repeated count as often as they stand; keys may repeat or be null; both builds have one schema.
    keep(df) writes a frame and reads it again.
    """
    columns = a.columns
    here, below = fresh_names(columns, "_k", "_h")

    def marked(rows: DataFrame) -> DataFrame:
        whole = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
        return rows.select(*columns, F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256).alias(here), whole.alias(below))

    def sums(rows: DataFrame, n: int, name: str) -> DataFrame:
        low = F.col(below).bitwiseAND(F.lit((1 << 31) - 1))
        high = F.shiftrightunsigned(F.col(below), 31)
        return rows.groupBy(F.substring(here, 1, n).alias("p")).agg(F.struct(F.count("*").alias("n"), F.sum(low).alias("l"), F.sum(high).alias("h")).alias(name))

    left, right, found = marked(a), marked(b), None
    for level in range(1, levels + 1):
        n = digits * level
        x, y = (rows if found is None else rows.join(found, F.substring(here, 1, n - digits) == F.col("prefix"), "left_semi") for rows in (left, right))
        both = sums(x, n, "x").join(sums(y, n, "y"), "p", "full")
        found = keep(both.filter(~F.col("x").eqNullSafe(F.col("y"))).select(F.col("p").alias("prefix")))
        if found.isEmpty():
            break
    x, y = (rows.join(found, F.substring(here, 1, n) == F.col("prefix"), "left_semi").select(*columns) for rows in (left, right))
    return rebuild_difference(x, y)


def fresh_names(taken: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that clash with none taken."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """file (below path), bytes, sha256 of each file that a sink wrote; markers of the writer are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").split("://")[-1].lstrip("/")
    name = F.expr(f"substring_index(path, '{root}/', -1)")
    return files.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).filter(~F.element_at(F.split("file", "/"), -1).rlike(r"^[_.]"))


def changed_files(told: DataFrame, now: DataFrame) -> DataFrame:
    """file, why: what a manifest and the files of today differ in (missing, new, changed)."""
    both = told.select("file", F.col("sha256").alias("a")).join(now.select("file", F.col("sha256").alias("b")), "file", "full")
    why = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").otherwise("changed")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("file", why.alias("why"))
