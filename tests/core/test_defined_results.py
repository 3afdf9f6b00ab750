"""What the docstrings of metrics, gates and samples say of nulls, ties and repeated rows."""

from pyspark.sql import functions as F

from assaykit.operators import gates, metrics, sampling

SCORED = "g string, ok boolean, conf double, brier double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_metrics_of_nulls(spark):
    df = spark.createDataFrame([("a", True, 0.9, 0.1), ("a", None, 0.9, None), ("a", False, None, 0.5), (None, True, 1.0, 0.0), ("b", None, None, None)], SCORED)
    assert rows(metrics.accuracy(df, ["g"])) == sorted([("a", 3, 0.5), (None, 1, 1.0), ("b", 1, None)], key=str)
    assert rows(metrics.mean_of(df, ["g"], "brier")) == sorted([("a", 0.3), (None, 0.0), ("b", None)], key=str)
    got = {r.g: r for r in metrics.summary(df, ["g"]).collect()}
    assert (got["a"].n, got["a"].accuracy, got["a"].brier) == (3, 0.5, 0.3) and got["b"].accuracy is None
    none = df.filter(F.lit(False))
    assert metrics.accuracy(none, ["g"]).count() == 0 and rows(metrics.accuracy(none, [])) == [(0, None)]


def test_gates_at_the_threshold_and_without_a_number(spark):
    df = spark.createDataFrame([(1.0, float("nan"), None)], "v double, n double, w double")
    assert gates.at_least(df, "g", "v", 1.0, "no").first()["pass"] and gates.at_most(df, "g", "v", 1.0, "no").first()["pass"]
    assert not gates.at_least(df, "g", "n", 1.0, "no").first()["pass"]
    assert not gates.at_most(df, "g", "n", 1.0, "no").first()["pass"] and not gates.at_most(df, "g", "w", 1.0, "no").first()["pass"]
    assert gates.at_most(df.filter("v > 2"), "g", "v", 1.0, "no").count() == 0


def test_samples_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([("x", "s"), ("x", "s"), (None, "s"), ("y", None), ("z", None)], "item_id string, source string")
    assert sampling.cap(df, ["source"], 5, 1).count() == 5 and sampling.cap(df.limit(0), ["source"], 5, 1).count() == 0
    one = rows(sampling.cap(df, ["source"], 1, 1))
    assert len(one) == 2 and one == rows(sampling.cap(df.repartition(4), ["source"], 1, 1))
