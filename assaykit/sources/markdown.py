"""Tables in Markdown files.

A file is one row while its lines are told apart, so a file has to fit a task; files of any number are
read in parallel.

Defined results: a table begins at a line of cells above a line of dashes and ends before the first line
that is none of cells; cells that a row lacks are empty, more than the header names are left out; an
escaped bar is a bar; lines inside a fenced block are no table; a file without tables gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS, DASHES, FENCE, HEADING = r"^\s*\|.*\|\s*$", r"^\s*\|(\s*:?-+:?\s*\|)+\s*$", r"^\s*(```|~~~)", r"^\s{0,3}#{1,6}\s+"


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """file, section (the heading above), line (of the header), row (from 1), fields (header -> cell) of each row of each table."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "value"))
    order = Window.partitionBy("file").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = text.withColumn("fenced", F.sum(F.col("value").rlike(FENCE).cast("int")).over(so_far) % 2 == 1)
    cells = F.transform(F.split(F.regexp_replace(F.regexp_replace("value", r"^\s*\|", ""), r"\|\s*$", ""), r"(?<!\\)\|", -1), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))
    lines = lines.withColumn("inside", F.col("value").rlike(CELLS) & ~F.col("fenced"))
    lines = lines.withColumn("head", F.col("inside") & ~F.col("value").rlike(DASHES) & F.coalesce(F.lead("value").over(order).rlike(DASHES), F.lit(False)))
    last = lambda cond, value: F.last(F.when(cond, value), ignorenulls=True).over(so_far)
    lines = lines.withColumns(
        {
            "line": last(F.col("head"), F.col("at")), "names": last(F.col("head"), cells), "out": last(~F.col("inside"), F.col("at")),
            "section": last(F.col("value").rlike(HEADING) & ~F.col("fenced"), F.trim(F.regexp_replace("value", HEADING, ""))), "cells": cells,
        }
    )
    rows = lines.filter(F.col("inside") & (F.col("line") > F.coalesce("out", F.lit(-1))) & (F.col("at") > F.col("line") + 1))
    fields = F.map_from_entries(F.transform("names", lambda n, i: F.struct(F.when(F.array_position("names", n) == i + 1, n).otherwise(F.concat(n, F.lit(" "), (i + 1).cast("string"))), F.coalesce(F.get("cells", i), F.lit("")))))
    return rows.select("file", "section", F.col("line").cast("int").alias("line"), (F.col("at") - F.col("line") - 1).cast("int").alias("row"), fields.alias("fields"))
