"""Temperatures and thresholds against plain searches."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from assaykit.operators import calibration

SCHEMA = "qtype string, logits array<double>, gold_index int"


def loss(rows, beta):
    return float(np.mean([np.log(np.exp(beta * (np.array(z) - max(z))).sum()) + beta * (max(z) - z[g]) for z, g in rows]))


def sample(seed, scale, n=300):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        z = [rng.gauss(0, 1) for _ in range(4)]
        p = np.exp(np.array(z) - max(z))
        out.append(([scale * v for v in z], rng.choices(range(4), weights=p)[0]))
    return out


def test_the_optimum_is_flat_and_least(spark):
    data = {"sharp": sample(1, 3.0), "soft": sample(2, 0.4), "three": sample(3, 1.0)}
    df = spark.createDataFrame([(q, z, g) for q, rows in data.items() for z, g in rows], SCHEMA).repartition(3)
    got = {r.qtype: r for r in calibration.fit_temperatures(df, ["qtype"]).collect()}
    for q, rows in data.items():
        r = got[q]
        assert abs(r.slope) < 1e-6 and abs(r.loss - loss(rows, 1 / r.t)) < 1e-9
        assert all(loss(rows, b) >= r.loss - 1e-12 for b in (0.9 / r.t, 1.1 / r.t, 0.999 / r.t, 1.001 / r.t))
    assert 2.2 < got["sharp"].t < 4 and 0.25 < got["soft"].t < 0.6


def test_bounds_and_rows_without_gold(spark):
    rows = [("up", [0.0, 5.0], 0), ("down", [5.0, 0.0], 0), ("none", [1.0], None), ("none", None, 0), ("none", [1.0], 3), (None, [0.0, 1.0], 1), (None, [0.0, 1.0], 0), (None, [0.0, 1.0], 1)]
    got = {r.qtype: r.t for r in calibration.fit_temperatures(spark.createDataFrame(rows, SCHEMA), ["qtype"]).collect()}
    assert set(got) == {"up", "down", None}
    assert math.isclose(got["up"], calibration.HOTTEST) and math.isclose(got["down"], calibration.COLDEST) and math.isclose(1 / got[None], math.log(2), rel_tol=1e-6)
    assert calibration.fit_temperatures(spark.createDataFrame([], SCHEMA), ["qtype"]).collect() == []


def brute_threshold(rows):
    cuts = sorted({c for c, _ in rows}) + [math.inf]
    return max(((sum((c >= t) == ok for c, ok in rows), -t) for t in cuts))


def test_threshold_over_all_cut_points(spark):
    rng = random.Random(5)
    data = {g: [(round(rng.random(), 2 if g == "ties" else 9), rng.random() < 0.6) for _ in range(400)] for g in ("a", "ties", "b")}
    data["wrong"] = [(0.5, False), (0.7, False)]
    df = spark.createDataFrame([(g, c, ok) for g, rows in data.items() for c, ok in rows] + [("a", None, True), ("a", 0.1, None)], "g string, conf double, ok boolean")
    for part in (df, df.repartition(5)):
        got = {r.g: (r.t, r.right) for r in calibration.best_threshold(part, ["g"]).collect()}
        for g, rows in data.items():
            n, t = brute_threshold(rows)
            assert got[g] == (-t, n / len(rows))
    plan = calibration.best_threshold(df, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert calibration.best_threshold(df.filter(F.lit(False)), []).count() == 0
