"""A living build: records that land in a folder, batch by batch, and the items that follow from all of them.

Each micro-batch writes the records that no earlier batch holds to a folder of its own number. A batch
that runs again after a failure writes the same folder again, so nothing is kept twice. The items are
built from all records together: an early date that lands late still takes its record out of the window,
and any order of landings gives the items of one build.

Defined results: rows that are equal in every column are one record; rows with a null id are kept as the
build keeps them; a landing without new records writes an empty batch; no landing, no records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_digest", F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256))


def records(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """All records so far."""
    try:
        return spark.read.schema(f"{schema}, _digest string, batch long").parquet(store).drop("_digest", "batch")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def land(spark: SparkSession, landing: str, schema: str, store: str, checkpoint: str) -> StreamingQuery:
    """Takes in what is new in the landing folder (JSON lines) and ends when it is read."""

    def keep(batch: DataFrame, number: int) -> None:
        new, here = _digest(batch).dropDuplicates(["_digest"]), batch.sparkSession
        try:
            known = here.read.schema("_digest string, batch long").parquet(store).filter(F.col("batch") != number).select("_digest")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            new = new.join(known, "_digest", "left_anti")
        new.write.mode("overwrite").parquet(f"{store}/batch={number}")

    stream = spark.readStream.schema(schema).json(landing)
    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rebuild(spark: SparkSession, store: str, schema: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The items of all records so far."""
    return make(records(spark, store, schema))
