"""The grouped fit against a plain one in NumPy, row by row."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from assaykit.operators import screen

SCHEMA = "template_id string, split string, gold string, state string, label string, x int"


def brute_fit(rows, places, steps):
    """rows: (text, label). Weights by the same steps, one template, dense."""
    labels = sorted({y for _, y in rows})
    x = np.zeros((len(rows), places + 1))
    for i, (text, _) in enumerate(rows):
        at = {int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) % places for w in re.findall(r"[^\W_]+", (text or "").lower())}
        for p in at:
            x[i, p] = 1 / np.sqrt(len(at))
        x[i, -1] = 1
    y = np.eye(len(labels))[[labels.index(y) for _, y in rows]]
    w = ahead = before = np.zeros((len(labels), places + 1))
    for k in range(1, steps + 1):
        s = x @ ahead.T
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        decay = screen.PENALTY * ahead
        decay[:, -1] = 0
        w = ahead - screen.RATE * ((p - y).T @ x / len(rows) + decay)
        ahead, before = w + (k - 1) / (k + 2) * (w - before), w
    return labels, w, x


def texts(seed, n, labels):
    rng = random.Random(seed)
    return [(" ".join(rng.choices([f"{y}{k}" for k in range(6)] + ["the", "of", "and", "Zug", "né"], k=rng.randrange(0, 9))), y) for y in rng.choices(labels, k=n)]


def test_weights_equal_a_plain_fit(spark):
    data = {"two": texts(1, 80, ["no", "yes"]), "three": texts(2, 120, ["a", "b", "c"])}
    df = spark.createDataFrame([(t, y, s) for t, rows in data.items() for s, y in rows], "template_id string, label string, state string")
    dev = df.select("template_id", "label", screen.hashed_words("state", 64).alias("x")).repartition(5)
    labels, weights = screen.fit(dev, places=64, steps=15)
    for t, rows in data.items():
        names, want, _ = brute_fit(rows, 64, 15)
        assert labels[t] == names and np.abs(weights[t] - want).max() < 1e-9


def test_scores_and_templates_without_a_fit(spark):
    dev, test = texts(3, 100, ["no", "yes"]), texts(4, 60, ["no", "yes", "other"])
    rows = [("good", "dev", y, s) for s, y in dev] + [("good", "test", y, s) for s, y in test]
    rows += [("one", "dev", "yes", "a b"), ("one", "test", "yes", "a"), ("none", "test", "no", None), ("good", "dev", None, "z"), ("untested", "dev", "yes", "x"), ("untested", "dev", "no", "y")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = {r.template_id: (r.n, r.bow) for r in screen.bag_of_words(df, places=128).collect()}
    names, w, _ = brute_fit(dev, 128, screen.STEPS)
    _, _, x = brute_fit(test, 128, 0)
    said = [names[k] for k in (x @ w.T).argmax(axis=1)]
    assert got["good"] == (60, pytest.approx(np.mean([s == y for s, (_, y) in zip(said, test)]), abs=1e-6))
    assert got["one"] == (1, None) and got["none"] == (1, None) and "untested" not in got


def test_no_rows_and_no_label_twice(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert screen.bag_of_words(empty).collect() == []
    single = spark.createDataFrame([("t", "dev", "yes", "a", "", 0), ("t", "test", "no", "a", "", 0)], SCHEMA)
    assert [tuple(r) for r in screen.bag_of_words(single).collect()] == [("t", 1, None)]


def test_a_word_that_tells_all_is_dropped(spark):
    rng = random.Random(9)
    rows = [("leak", s, y, f"{y}word " + " ".join(rng.choices("abcdef", k=5))) for s in ("dev", "test") for y in rng.choices(["no", "yes"], k=60)]
    rows += [("fair", s, rng.choice(["no", "yes"]), " ".join(rng.choices("abcdef", k=5))) for s in ("dev", "test") for _ in range(60)]
    bow = screen.bag_of_words(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA))
    dropped = {r.template_id: r.dropped for r in screen.drop_rule(bow.selectExpr("template_id", "double(null) as regex", "bow")).collect()}
    assert dropped == {"leak": True, "fair": False}


def test_words_hashed_together_have_the_places_of_the_column(spark):
    rows = [(k, t) for k, t in enumerate(["b a b", None, "", "Ünï 漢字 x1, y-z", *(" ".join(f"w{k * j % 97}" for j in range(60)) for k in range(2300))])]
    df = spark.createDataFrame(rows, "k int, state string")
    got = screen.hash_together(df.select("k", screen.distinct_words("state").alias("words")), "words", 64)
    assert got.exceptAll(df.select("k", screen.hashed_words("state", 64).alias("x"))).count() == 0 and got.count() == len(rows)
    # Features of a slice of a batch.
    lists = pa.array([[9], [1, 2], [], [3]], pa.list_(pa.int32())).slice(1)
    assert screen.Rows(lists).at.tolist() == [1, 2, 3] and screen.Rows(lists).row.tolist() == [0, 0, 2]
