"""Which rows may train a model, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str = "doc_id") -> Column:
    """CRC-32 of the doc_id as text, modulo 4; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4


HELD_OUT = 2


def sample_by(rows: DataFrame, column: str, expected: int) -> tuple[DataFrame, dict]:
    """About `expected` rows of each value of the column, or all if it has fewer; and the share drawn of each value.

    Rows are drawn by a hash of doc_id, so that the same table gives the same sample.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(column).count().collect()}
    rates = {value: min(1.0, expected / n) for value, n in counts.items()}
    unit = F.pmod(F.xxhash64("doc_id", F.lit(column)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for value, share in rates.items():
        rate = F.when(F.col(column) == value, F.lit(share)).otherwise(rate)
    return rows.filter(unit < rate), rates
