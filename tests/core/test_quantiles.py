import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators.build import in_window
from assaykit.operators.quantiles import exact_quantiles

AT = {"p00": 0.0, "p05": 0.05, "p50": 0.5, "p999": 0.999, "p100": 1.0}


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_against_numpy(spark, accuracy):
    rng = np.random.default_rng(1)
    data = [("a", float(v)) for v in rng.normal(size=3000)] + [("ties", float(v)) for v in rng.integers(0, 4, 2000)] + [(None, float(v)) for v in range(7)] + [("one", 2.5), ("none", None), ("one", float("nan"))]
    got = {r.g: r for r in exact_quantiles(spark.createDataFrame(data, "g string, v double").repartition(5), ["g"], "v", AT, accuracy).collect()}
    assert set(got) == {"a", "ties", None, "one", "none"} and got["none"].p50 is None
    for g in ("a", "ties", None, "one"):
        values = [v for k, v in data if k == g and v is not None and v == v]
        for name, p in AT.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), abs=2e-6), (g, name)


def test_no_groups_and_no_rows(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert [tuple(r) for r in exact_quantiles(df, [], "v", {"m": 0.5}).collect()] == [(50.0,)]
    assert exact_quantiles(df.withColumn("g", F.lit(1)).limit(0), ["g"], "v", {"m": 0.5}).count() == 0


def test_window_leaves_out_records_seen_before_it(spark):
    rows = [("a", "2024-05-01"), ("a", "2026-01-01"), ("b", "2025-02-01"), ("b", "2025-03-01"), ("c", "2027-01-01"), (None, "2025-02-01"), ("d", None)]
    df = spark.createDataFrame(rows, "id string, d string").withColumn("d", F.col("d").cast("date"))
    assert sorted(r.id for r in in_window(df, "id", "d", "2025-01-01", "2026-12-31").collect()) == ["b", "b"]
