"""Folders for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; it goes when the driver ends.

    A session that names none gets a temporary one, if it is local, and is refused otherwise.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.gettempdir()
    root = f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return root


def keeper(spark: SparkSession, label: str) -> Callable[[DataFrame], DataFrame]:
    """Writes frames to a scratch folder, one after another, and reads them again: lineage is cut, and a lost executor costs a read."""
    root, written = scratch_dir(spark, label), []

    def keep(df: DataFrame) -> DataFrame:
        at = f"{root}/{len(written)}"
        written.append(at)
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    return keep
