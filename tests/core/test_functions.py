"""Hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from assaykit.functions import probs as P
from assaykit.functions import text as X
from assaykit.functions.hashing import hash_order, stable_id, unit


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, column):
    return one.select(column.alias("v")).first().v


def doubles(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


@pytest.mark.parametrize(("probs", "gold", "want"), [((0.7, 0.3), 0, 0.18), ((1, 0), 0, 0), ((1, 0), 1, 2)])
def test_brier(one, probs, gold, want):
    assert value(one, P.brier(doubles(*probs), F.lit(gold))) == pytest.approx(want)


def test_softmax_is_shift_invariant(one):
    for z in ((0, 1), (1000, 1001)):
        assert value(one, P.softmax(doubles(*z))) == pytest.approx([0.268941, 0.731059], abs=1e-6)
    assert value(one, P.scaled_softmax(doubles(0, 1), F.lit(1.0))) == pytest.approx([0.268941, 0.731059], abs=1e-6)
    assert value(one, P.scaled_softmax(doubles(0, 2), F.lit(2.0))) == pytest.approx([0.268941, 0.731059], abs=1e-6)


def test_bins(one):
    assert [value(one, P.bin15(F.lit(c))) for c in (0.0, 1 / 15 - 1e-9, 0.9, 1.0)] == [0, 0, 13, 14]


def test_expected_level_min_k_and_residual(one):
    assert value(one, P.expected_level(doubles(0.2, 0.3, 0.5))) == pytest.approx(1.3)
    assert value(one, P.min_k(doubles(*range(-10, 0)))) == -9.5
    topk = F.create_map(F.lit("A"), F.lit(0.6), F.lit("B"), F.lit(0.2))
    assert value(one, P.residual_fill(F.array(*map(F.lit, "ABCD")), topk)) == pytest.approx([0.6, 0.2, 0.1, 0.1])
    over = F.create_map(F.lit("A"), F.lit(0.8), F.lit("B"), F.lit(0.4))
    assert value(one, P.residual_fill(F.array(*map(F.lit, "ABC")), over)) == pytest.approx([0.8, 0.4, 0.0])


def test_ties_take_the_first(one):
    assert value(one, P.argmax(doubles(0.4, 0.4, 0.2))) == 0


def test_mass_nll_and_divergence(one):
    assert value(one, P.label_mass(doubles(0, 0), F.lit(math.log(4.0)))) == pytest.approx(0.5)
    assert value(one, P.nll(doubles(0.25, 0.75), F.lit(1))) == pytest.approx(-math.log(0.75))
    assert value(one, P.kl(doubles(0.5, 0.5), doubles(0.5, 0.5))) == pytest.approx(0)


def test_text(one):
    options = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(k.upper()).alias("label"), F.lit(None).cast("string").alias("description")) for k in ("x", "y")])
    assert value(one, X.render_options(options)) == "A. X\nB. Y"
    assert sorted(value(one, X.reorder_sentences(F.lit("One. Two! Three?"), F.lit("s"))).split()) == ["One.", "Three?", "Two!"]
    assert value(one, X.without(F.lit("a cat sat"), F.lit("cat "))) == "a sat"
    assert value(one, X.claim_id(F.lit(7))) == "C007"
    assert value(one, X.or_not_measured(F.lit(None).cast("double"), "no GPU")) == "NOT MEASURED — no GPU"
    keys = F.transform(hash_order(options, F.lit("1")), lambda o: o["key"])
    assert sorted(value(one, keys)) == ["x", "y"]


def test_hashes(one):
    import hashlib

    assert value(one, stable_id(F.lit("a"), F.lit("b"))) == hashlib.sha256(b"a|b").hexdigest()
    assert value(one, unit(F.lit("a"), F.lit("b"))) == int(hashlib.sha256(b"a|b").hexdigest()[:8], 16) / 2**32
