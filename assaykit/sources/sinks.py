"""Writers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_not_measured
from .shipping import ship


def write_items(items: DataFrame, path: str) -> None:
    """JSON lines in a folder for each source, in item order within a file; the number of files follows the data."""
    rows = items.withColumn("of", F.col("source")).repartitionByRange("source", "item_id").sortWithinPartitions("source", "item_id")
    rows.write.mode("overwrite").partitionBy("of").json(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Parquet by model and source; a large pair is spread over several files by item."""
    predictions.repartitionByRange("model", "source", "item_id").write.mode("overwrite").partitionBy("model", "source").parquet(path)


def write_summary(rows: DataFrame, path: str) -> None:
    """A summary is a few rows: one JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_audit(sample: DataFrame, path: str) -> None:
    """JSON lines for the people who judge the sample; a sample is small by its size for each source."""
    sample.coalesce(1).write.mode("overwrite").json(path)


def write_files(rows: DataFrame, path: str) -> str:
    """One file for each row (file, body), written by the tasks; a file that a task run again writes is the same. Returns the folder."""
    spark = rows.sparkSession

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        for batch in batches:
            for name, body in zip(batch.column("file").to_pylist(), batch.column("body").to_pylist()):
                with files.open_output_stream(f"{root}/{name}") as f:
                    f.write((body or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column("file")], names=["file"])

    ship(spark)
    rows.select("file", "body").mapInArrow(put, "file string").write.format("noop").mode("overwrite").save()
    return path


def to_markdown(rows: DataFrame, reason: str = "no value", most: int = 10_000) -> str:
    """A Markdown table of a summary; nulls become a marker."""
    cells = rows.select(*[or_not_measured(F.col(c), reason).alias(c) for c in rows.columns]).limit(most + 1).collect()
    if len(cells) > most:
        raise ValueError(f"more than {most} rows are no summary")
    line = lambda values: "| " + " | ".join(str(v).replace("|", "\\|") for v in values) + " |"
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *map(line, cells)])


def session_log_name(n: int) -> str:
    return f"session_{n:03d}.log"
