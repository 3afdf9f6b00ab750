"""Arithmetic on arrays of logits, probabilities and token log-probabilities; doubles throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0).cast("double")


def array_total(xs: Column | str) -> Column:
    return F.aggregate(xs, _zero(), lambda a, x: a + x)


def log_sum_exp(logits: Column | str) -> Column:
    top = F.array_max(logits)
    return top + F.log(array_total(F.transform(logits, lambda z: F.exp(z - top))))


def softmax(logits: Column | str) -> Column:
    """Shifted by the maximum, so large logits do not overflow."""
    top = F.array_max(logits)
    total = array_total(F.transform(logits, lambda z: F.exp(z - top)))
    return F.transform(logits, lambda z: F.exp(z - top) / total)


def scaled_softmax(logits: Column | str, temperature: Column) -> Column:
    return softmax(F.transform(logits, lambda z: z / temperature))


def label_mass(logits: Column | str, lse_vocab: Column | str) -> Column:
    """Full-vocabulary probability of the option tokens."""
    return F.exp(log_sum_exp(logits) - F.col(lse_vocab) if isinstance(lse_vocab, str) else log_sum_exp(logits) - lse_vocab)


def argmax(probs: Column | str) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def brier(probs: Column | str, gold: Column | str) -> Column:
    """Sum over the options of (p - 1[gold])^2; gold is a 0-based index."""
    g = F.col(gold) if isinstance(gold, str) else gold
    parts = F.transform(probs, lambda p, i: F.pow(p - F.when(i == g, 1.0).otherwise(0.0).cast("double"), F.lit(2)))
    return array_total(parts)


def nll(probs: Column | str, gold: Column | str) -> Column:
    """Null where the gold is null or no option's index."""
    g = F.col(gold) if isinstance(gold, str) else gold
    p = F.get(probs, g)
    return F.when(p.isNotNull(), -F.log(F.greatest(p, F.lit(1e-12))))


def expected_level(probs: Column | str) -> Column:
    """Mean 0-based level."""
    return array_total(F.transform(probs, lambda p, i: p * i))


def min_k(logprobs: Column | str, share: float = 0.2) -> Column:
    """Mean of the lowest ceil(share * n) token log-probabilities; null where there are no tokens."""
    k = F.ceil(F.size(logprobs) * F.lit(share).cast("double")).cast("int")
    return F.try_divide(array_total(F.slice(F.array_sort(logprobs), F.lit(1), F.greatest(k, F.lit(0)))), k)


def residual_fill(keys: Column | str, topk: Column | str) -> Column:
    """Probabilities in the order of keys; those missing from the map share what is left of 1, at least nought."""
    topk = F.col(topk) if isinstance(topk, str) else topk
    keys = F.col(keys) if isinstance(keys, str) else keys
    found = F.transform(keys, lambda k: F.element_at(topk, k))
    given = array_total(F.transform(found, lambda p: F.coalesce(p, _zero())))
    missing = F.size(F.filter(found, lambda p: p.isNull()))
    return F.transform(found, lambda p: F.coalesce(p, F.greatest(1.0 - given, _zero()) / missing))


def kl(p: Column | str, q: Column | str, floor: float = 1e-9) -> Column:
    """Divergence of q from p; both are floored."""
    low = F.lit(floor).cast("double")
    return array_total(F.zip_with(p, q, lambda a, b: a * F.log(F.greatest(a, low) / F.greatest(b, low))))


def bin15(confidence: Column | str) -> Column:
    """Equal-width bin 0 to 14; confidence 1 is in bin 14."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.least(F.lit(14), F.floor(c * F.lit(15.0).cast("double")).cast("int"))
