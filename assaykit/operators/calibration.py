"""One temperature for each question type, and one confidence threshold, both exact.

The mean negative log-likelihood is convex in the inverse temperature. Each turn is one aggregate of
first and second derivatives for all question types at once; Newton's step is taken where it stays in
the bracket, else the bracket is halved.

Defined results: rows without logits, or whose gold is null or no option's place, count in nothing; a
type without other rows has no row; the optimum is sought between the bounds and is a bound where the
loss still falls there; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.probs import array_total, scaled_softmax
from .prefix import running_totals, same

#: Bounds of the temperature; slope at which a search ends; turns of a search.
COLDEST, HOTTEST, FLAT, TURNS = 0.05, 20.0, 1e-12, 80


def slopes(rows: DataFrame, by: list[str], betas: DataFrame) -> DataFrame:
    """by, beta, loss, g, h: mean loss and its derivatives at inverse temperatures (by, beta); rows have logits and gold_index."""
    gold = F.get("logits", F.col("gold_index"))
    told = rows.withColumn("_gold", gold).filter("_gold is not null").select(*by, "logits", "_gold", F.array_max("logits").alias("_top"))
    met = same(told, betas, by)
    w = met.withColumn("_w", F.transform("logits", lambda z: F.exp(F.col("beta") * (z - F.col("_top")))))
    s0 = array_total("_w")
    s1 = array_total(F.zip_with("_w", "logits", lambda a, z: a * z))
    s2 = array_total(F.zip_with("_w", "logits", lambda a, z: a * z * z))
    each = w.select(*by, "beta", s0.alias("_s0"), (s1 / s0).alias("_mean"), (s2 / s0).alias("_square"), "_gold", "_top")
    return each.groupBy(*by, "beta").agg(
        F.avg(F.log("_s0") + F.col("beta") * (F.col("_top") - F.col("_gold"))).alias("loss"),
        F.avg(F.col("_mean") - F.col("_gold")).alias("g"), F.avg(F.col("_square") - F.col("_mean") * F.col("_mean")).alias("h"),
    )


class _Search:
    """One type's bracket of inverse temperatures."""

    def __init__(self):
        self.low, self.high, self.at, self.loss, self.slope, self.done = 1 / HOTTEST, 1 / COLDEST, 1.0, None, None, False

    def bounds(self, low: tuple, high: tuple) -> None:
        for beta, (loss, g, _), ends in ((self.low, low, low[1] >= 0), (self.high, high, high[1] <= 0)):
            if ends and not self.done:
                self.at, self.loss, self.slope, self.done = beta, loss, g, True

    def turn(self, loss: float, g: float, h: float) -> None:
        self.loss, self.slope = loss, g
        if abs(g) <= FLAT or self.high - self.low <= 1e-12 * self.high:
            self.done = True
            return
        if g > 0:
            self.high = self.at
        else:
            self.low = self.at
        step = self.at - g / h if h > 0 else self.low
        self.at = step if self.low < step < self.high else (self.low + self.high) / 2


def fit_temperatures(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, t, loss, slope: the temperature of least mean loss of each group. Groups are question types, of which there are a few."""
    spark = rows.sparkSession
    keys = T.StructType([rows.schema[c] for c in by])
    frame = lambda pairs: spark.createDataFrame([(*k, b) for k, b in pairs], T.StructType([*keys, T.StructField("beta", T.DoubleType())]))
    found: dict[tuple, _Search] = {tuple(r): _Search() for r in rows.select(*by).distinct().collect()}

    def look(pairs: list[tuple[tuple, float]]) -> dict[tuple, tuple]:
        return {(tuple(r[: len(by)]), r["beta"]): (r["loss"], r["g"], r["h"]) for r in slopes(rows, by, frame(pairs)).collect()} if pairs else {}

    ends = look([(k, b) for k, s in found.items() for b in (s.low, s.high)])
    found = {k: s for k, s in found.items() if (k, s.low) in ends}
    for k, s in found.items():
        s.bounds(ends[k, s.low], ends[k, s.high])
    for _ in range(TURNS):
        going = [(k, s.at) for k, s in found.items() if not s.done]
        if not going:
            break
        seen = look(going)
        for k, at in going:
            found[k].turn(*seen[k, at])
    else:
        raise RuntimeError("temperatures did not settle")
    out = T.StructType([*keys, *(T.StructField(n, T.DoubleType()) for n in ("t", "loss", "slope"))])
    return spark.createDataFrame([(*k, 1 / s.at, s.loss, s.slope) for k, s in found.items()], out)


def apply_temperature(rows: DataFrame, temperatures: DataFrame, by: list[str]) -> DataFrame:
    """rows with probs at their group's temperature; a group without one is left out."""
    return same(rows, temperatures.select(*by, "t"), by).withColumn("probs", scaled_softmax("logits", F.col("t")))


def best_threshold(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, t, right: the confidence from which on answers are best trusted, over all cut points.

    rows: conf, ok. right is the share of rows with (conf >= t) = ok. Every confidence that occurs is
    tried, and infinity, which trusts none; of equals the lowest is taken. Null conf or ok count in nothing.
    """
    told = rows.filter("conf is not null and ok is not null")
    values = told.groupBy(*by, "conf").agg(F.sum(F.col("ok").cast("long")).alias("_good"), F.sum((~F.col("ok")).cast("long")).alias("_bad"))
    every = values.groupBy(*by).agg(F.sum("_good").alias("_goods"), F.sum("_bad").alias("_bads")).filter("_goods is not null")
    cut = same(running_totals(values, by, "conf", {"_good_before": "_good", "_bad_before": "_bad"}), every, by)
    tried = cut.select(*by, F.col("conf").alias("t"), (F.col("_goods") - F.col("_good_before") + F.col("_bad_before")).alias("_right"))
    none = every.select(*by, F.lit(float("inf")).alias("t"), F.col("_bads").alias("_right"))
    best = tried.unionByName(none).groupBy(*by).agg(F.max_by(F.struct("t", "_right"), F.struct("_right", -F.col("t"))).alias("_b"))
    return same(best, every, by).select(*by, F.col("_b.t").alias("t"), (F.col("_b._right") / (F.col("_goods") + F.col("_bads"))).alias("right"))
