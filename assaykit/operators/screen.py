"""Template screens: what a keyword rule or a bag of words already answers.

The bag of words is a softmax regression for each template, all fitted at once. A row's features are its
distinct words, hashed to a fixed number of places and scaled to length 1. Each of a fixed number of
accelerated gradient steps is one pass over the dev rows: every task sums its own gradients, and only
sums by (template, label, place) are shuffled. Weights are a few numbers a template: templates times
labels times places, whatever the number of rows.

Defined results: labels are those of a template's dev rows; a template with fewer than two of them, or
without dev rows, has a null score; a test row with another label is answered wrongly; a null label is
no row; a null text has no words; ties go to the first label in order; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bucket

DROP_AT = 0.95
#: Places of hashed words; gradient steps, their length and the penalty on weights.
PLACES, STEPS, RATE, PENALTY = 4096, 20, 1.0, 1e-3
#: Templates that are fitted in one pass.
TOGETHER = 64
#: Rows whose words are hashed together.
SLICE = 1000


def keyword_rule(text: Column | str, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The answer of the first pattern that matches."""
    text = F.col(text) if isinstance(text, str) else text
    out = F.lit(otherwise)
    for pattern, answer in reversed(rules):
        out = F.when(text.rlike(pattern), answer).otherwise(out)
    return out


def distinct_words(text: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def hashed_words(text: str, places: int = PLACES) -> Column:
    """Places of the distinct words, in order."""
    return F.array_sort(F.array_distinct(F.transform(distinct_words(text), lambda w: (bucket(w) % places).cast("int"))))


def hash_together(rows: DataFrame, words: str, places: int = PLACES) -> DataFrame:
    """rows with x, what hashed_words gives, instead of the words; a slice of rows hashes each word once."""
    others = [c for c in rows.columns if c != words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                told = part.column(words).flatten().dictionary_encode()
                place = np.array([int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "big") % places for w in told.dictionary.to_pylist()], dtype=np.int64)
                row = np.repeat(np.arange(part.num_rows), _sizes(part.column(words)))
                both = np.unique(row * places + place[np.asarray(told.indices)])
                ends = np.searchsorted(both, np.arange(part.num_rows + 1) * places)
                x = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(both % places, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), x], names=[*others, "x"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others) + ", x array<int>")


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return np.asarray(pc.list_value_length(lists), dtype=np.int64)


class Rows:
    """A batch's features of one template, as one list of places and where each row begins."""

    def __init__(self, lists: pa.ListArray):
        sizes = _sizes(lists)
        self.at = np.asarray(lists.flatten(), dtype=np.int64)
        self.row, self.n = np.repeat(np.arange(len(lists)), sizes), len(lists)
        self.scale = (1 / np.sqrt(np.maximum(sizes, 1)))[self.row]

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Rows by labels; the last weight of a label stands for all rows."""
        return np.stack([np.bincount(self.row, weights=w[self.at] * self.scale, minlength=self.n) + w[-1] for w in weights], axis=1)

    def gradient(self, weights: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Sum over the rows of the log loss's gradient."""
        s = self.scores(weights)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(self.n), labels] -= 1
        return np.stack([np.append(np.bincount(self.at, weights=r[self.row] * self.scale, minlength=weights.shape[1] - 1), r.sum()) for r in p.T])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str], Rows]]:
    """template, labels, features: the rows of one template of each batch."""
    for batch in batches:
        templates = batch.column("template_id").dictionary_encode("encode")
        of = np.asarray(templates.indices)
        for k, template in enumerate(templates.dictionary.to_pylist()):
            here = pa.array(np.flatnonzero(of == k))
            yield template, batch.column("label").take(here).to_pylist(), Rows(batch.column("x").take(here))


def _gradients(dev: DataFrame, labels: dict[str, list[str]], weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sums over all dev rows."""
    held = dev.sparkSession.sparkContext.broadcast((labels, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (names, w), sums = held.value, {}
        for template, told, rows in _batches(batches):
            place = {name: k for k, name in enumerate(names[template])}
            g = rows.gradient(w[template], np.array([place[x] for x in told]))
            sums[template] = sums[template] + g if template in sums else g
        for template, g in sums.items():
            k, p = np.nonzero(g)
            yield pa.RecordBatch.from_arrays([pa.array([template] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(p, pa.int32()), pa.array(g[k, p])], names=["template_id", "k", "p", "g"])

    summed = dev.mapInArrow(run, "template_id string, k int, p int, g double").groupBy("template_id", "k", "p").agg(F.sum("g").alias("g"))
    table = summed.toArrow().to_pydict()
    held.destroy()
    out = {t: np.zeros_like(w) for t, w in weights.items()}
    for template, k, p, g in zip(*(table[c] for c in ("template_id", "k", "p", "g"))):
        out[template][k, p] = g
    return out


def fit(dev: DataFrame, places: int = PLACES, steps: int = STEPS) -> tuple[dict[str, list[str]], dict[str, np.ndarray]]:
    """Labels and weights of each template with two labels or more; dev: template_id, label, x."""
    counts: dict[str, dict[str, int]] = {}
    for template, label, n in dev.groupBy("template_id", "label").count().collect():  # templates and their labels
        counts.setdefault(template, {})[label] = n
    labels = {t: sorted(c) for t, c in sorted(counts.items()) if len(c) > 1}
    weights = {t: np.zeros((len(names), places + 1)) for t, names in labels.items()}
    for lo in range(0, len(labels), TOGETHER):
        some = list(labels)[lo : lo + TOGETHER]
        rows = dev.filter(F.col("template_id").isin(some))
        names, w = {t: labels[t] for t in some}, {t: weights[t] for t in some}
        ahead, before = dict(w), dict(w)
        for step in range(1, steps + 1):
            sums = _gradients(rows, names, ahead)
            for t in some:
                penalty = PENALTY * ahead[t]
                penalty[:, -1] = 0
                w[t] = ahead[t] - RATE * (sums[t] / sum(counts[t].values()) + penalty)
                ahead[t] = w[t] + (step - 1) / (step + 2) * (w[t] - before[t])
            before = dict(w)
        weights.update(w)
    return labels, weights


def bag_of_words(items: DataFrame, text: str = "state", label: str = "gold", places: int = PLACES, steps: int = STEPS) -> DataFrame:
    """template_id, n, bow: accuracy on the n test items of a regression fitted on each template's dev items."""
    rows = items.select("template_id", "split", F.col(label).alias("label"), distinct_words(text).alias("words")).filter("label is not null")
    hashed = lambda split: hash_together(rows.filter(F.col("split") == split).select("template_id", "label", "words"), "words", places)
    dev = hashed("dev").persist()
    labels, weights = fit(dev, places, steps)
    dev.unpersist()
    held = items.sparkSession.sparkContext.broadcast((labels, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, w = held.value
        for template, told, features in _batches(batches):
            said = [names[template][k] for k in features.scores(w[template]).argmax(axis=1)] if template in names else [None] * len(told)
            right = [None if s is None else float(s == t) for s, t in zip(said, told)]
            yield pa.RecordBatch.from_arrays([pa.array([template] * len(told), pa.string()), pa.array(right, pa.float64())], names=["template_id", "right"])

    told = hashed("test").mapInArrow(run, "template_id string, right double")
    return told.groupBy("template_id").agg(F.count("*").alias("n"), F.round(F.avg("right"), 6).alias("bow"))


def drop_rule(screen: DataFrame, threshold: float = DROP_AT) -> DataFrame:
    """screen: template_id, regex, bow. Adds dropped: either reaches the threshold; a missing score is no score."""
    none = F.lit(-1.0).cast("double")
    return screen.withColumn("dropped", F.greatest(F.coalesce("regex", none), F.coalesce("bow", none)) >= threshold)
