"""Rendering, normalising and cutting of item texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letter(i: Column) -> Column:
    """A, B, ... for 0, 1, ..."""
    return F.char(i + 65)


def render_options(options: Column | str) -> Column:
    """Lettered lines."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(letter(i), F.lit(". "), o["label"])), "\n")


def sentences(text: Column | str) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def reorder_sentences(text: Column | str, *salt: Column | str) -> Column:
    """The text's sentences in the order of their hashes: the same words, another order."""
    ranked = F.transform(sentences(text), lambda s, i: F.struct(F.sha2(F.concat_ws("|", *salt, i.cast("string"), s), 256).alias("h"), s.alias("s")))
    return F.array_join(F.transform(F.array_sort(ranked), lambda r: r["s"]), " ")


def without(text: Column, answer: Column) -> Column:
    """The text with every occurrence of the answer taken out."""
    return F.when(F.length(answer) > 0, F.replace(text, answer, F.lit(""))).otherwise(text)


def claim_id(n: Column) -> Column:
    """C001, C002, ..."""
    return F.format_string("C%03d", n)


def session_log(n: Column) -> Column:
    """session_001.log, session_002.log, ..."""
    return F.format_string("session_%03d.log", n)


def or_not_measured(value: Column, reason: str) -> Column:
    """A cell that is never null."""
    return F.coalesce(value.cast("string"), F.lit(f"NOT MEASURED — {reason}"))


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
