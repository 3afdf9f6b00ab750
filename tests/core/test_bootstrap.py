"""Exact resamples against a version that draws one by one, and running totals against plain windows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import bootstrap
from assaykit.operators.prefix import running_totals


def brute_mean(group, values, b):
    """Draw j takes the rank that the digest's word names; for groups of one leaf."""
    values = sorted(values)
    words = b"".join(hashlib.sha256(f"draw|{group}|0|{b}|{k}".encode()).digest() for k in range(len(values) // 8 + 1))
    return sum(values[int.from_bytes(words[4 * j : 4 * j + 4], "big") % len(values)] for j in range(len(values))) / len(values)


def test_small_groups_equal_draws_one_by_one(spark):
    rng = random.Random(1)
    data = [("a", rng.random()) for _ in range(57)] + [("b", float(rng.randrange(3))) for _ in range(90)] + [("c", 1.0)] * 5 + [("d", None), ("a", None)]
    got = {(r.g, r.b): r.mean for r in bootstrap.exact_means(spark.createDataFrame(data, "g string, v double"), "g", "v", n=20).collect()}
    values = {g: [v for h, v in data if h == g and v is not None] for g in "abc"}
    assert set(got) == {(g, b) for g in "abc" for b in range(20)}
    assert all(got[g, b] == pytest.approx(brute_mean(g, values[g], b), abs=1e-12) for g, b in got)


@pytest.mark.parametrize("size", [1, 16, 17, 40, 163, 1000])
def test_every_resample_has_exactly_the_size(size):
    leaves = -(-size // 16)
    draws = np.stack([bootstrap.leaf_draws("g", size, k, 50, leaf=16) for k in range(leaves)])
    assert (draws.sum(axis=0) == size).all() and (draws >= 0).all()


def test_leaves_get_their_share():
    size, n = 1000, 4000
    draws = np.stack([bootstrap.leaf_draws("share", size, k, n, leaf=16) for k in range(63)])
    mass = np.array([16] * 62 + [8])
    assert np.abs(draws.mean(axis=1) - mass).max() < 6 * np.sqrt(16 / n)
    spread = draws.var(axis=1) / (mass * (1 - mass / size))
    assert 0.85 < spread.min() and spread.max() < 1.15
    # Two leaves of a multinomial number move against each other a little.
    assert abs(np.cov(draws[0], draws[40])[0, 1] + 16 * 16 / size) < 1.5


def test_large_groups_do_not_depend_on_partitions_and_have_the_right_spread(spark):
    df = spark.range(9000).select(F.lit("g").alias("g"), (F.col("id") % 97 / 97.0).alias("v"))
    a, b = ({r.b: r.mean for r in bootstrap.exact_means(d, "g", "v", n=400, leaf=512).collect()} for d in (df, df.repartition(7, "v")))
    # Sums of leaves may be added in another order.
    assert len(a) == 400 and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    means, values = np.array(list(a.values())), np.arange(9000) % 97 / 97
    assert abs(means.mean() - values.mean()) < 5 * values.std() / np.sqrt(9000 * 400)
    assert 0.85 < means.std() / (values.std() / np.sqrt(9000)) < 1.15


def test_names_that_clash_and_empty_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("x", None)], "c string, at double")
    got = bootstrap.exact_means(df, "c", "at", n=3)
    assert got.columns == ["c", "b", "mean"] and {r.c for r in got.collect()} == {None}
    assert bootstrap.exact_means(df.limit(0), "c", "at").count() == 0


def test_running_totals_equal_a_window(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), rng.random() ** 3, rng.randrange(5)) for _ in range(3000)] + [("a", None, 7), ("only", 1.0, None)]
    df = spark.createDataFrame(data, "g string, x double, n int")
    got = [(r.g, r.x, r.n, r.before) for r in running_totals(df, ["g"], "x", {"before": "n"}, ranges=8).collect()]
    want = [(g, x, n, sum(m or 0 for h, y, m in data if h == g and x is not None and (y is None or y < x))) for g, x, n in data]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    plan = running_totals(df, ["g"], "x", {"before": "n"})._jdf.queryExecution().toString()
    assert "_range" in plan.split("Window")[1]


def test_poisson_rows_are_summed_in_the_tasks(spark, monkeypatch):
    rows = [(None if k % 7 == 0 else k % 3, None if k == 11 else f"i{k // 4}", None if k % 13 == 0 else k / 8) for k in range(2500)]
    df = spark.createDataFrame(rows, "g int, item_id string, v double")
    want = {}
    for g, i, v in rows:
        if v is not None:
            for b in range(20):
                h = hashlib.sha256(("poisson|%d" % (b // 8) + ("" if i is None else f"|{i}")).encode()).hexdigest()
                w = sum(int(h[b % 8 * 8 :][:8], 16) / 2**32 >= step for step in bootstrap.POISSON_STEPS)
                s = want.setdefault((g, b), [0.0, 0])
                s[0], s[1] = s[0] + w * v, s[1] + w
    means = bootstrap.poisson_means(df, "g", "v", n=20)
    assert {(r.g, r.b): round(r["mean"], 9) for r in means.collect()} == {k: round(s / w, 9) for k, (s, w) in want.items()}
    # No row is multiplied by replicates on its way.
    assert "explode" not in means._jdf.queryExecution().optimizedPlan().toString().lower()
