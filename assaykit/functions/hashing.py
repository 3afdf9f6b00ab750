"""Stable identities and orders that depend on the row alone, never on its partition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by a bar; a null part is skipped."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def bucket(*parts: Column | str) -> Column:
    """The first 32 bits of the stable id, as a long."""
    return F.conv(F.substring(stable_id(*parts), 1, 8), 16, 10).cast("long")


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1)."""
    return bucket(*parts).cast("double") / F.lit(4294967296.0).cast("double")


def hash_order(options: Column | str, *salt: Column | str) -> Column:
    """The options in the order of their keys' hashes under the salt: a seeded permutation."""
    ranked = F.transform(options, lambda o: F.struct(F.sha2(F.concat_ws("|", *salt, o["key"]), 256).alias("h"), o.alias("o")))
    return F.transform(F.array_sort(ranked), lambda r: r["o"])
