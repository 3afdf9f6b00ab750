"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's probability is logistic in the distinct words that it holds, each by itself and by
its first letters, so that an unseen word counts by the forms that it shares. A document's is the noisy-or
of its evident sentences, those that reach EVIDENT by themselves: one minus the product of their
complements. A document without an evident sentence has the probability of its strongest one. So a
document reaches EVIDENT if one of its sentences does, and any number of sentences without evidence
adds nothing. Only documents are labelled; the gradient of the document's likelihood falls on each
sentence by its own probability, so the training finds the sentences that explain the label. The first
rounds take the noisy-or of all sentences, as no sentence is evident yet; the others take the score's own
form. Weights are fitted to a bounded sample of labelled documents. Every feature of the sample is
considered; an L1 penalty leaves most at nought.

A sentence ends at `.`, `!` or `?` or a line's end. A document without words is one empty
sentence.

Defined results: a null or empty text gets the score of one empty sentence; a text of any
length is scored whole; equal texts score equally; without labelled training rows every score
is 0; rows repeated get a row each; an empty table gives no rows; labels that repeat a doc_id
count as toxic if any does, null labels are ignored; columns other than doc_id, text and the
label are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._training import HELD_OUT, fold, sample_by

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
PREFIXES = (4, 5, 6)
KNOWN_WORDS = 400_000
#: Labelled documents of each class that are read to fit the weights, about, and the share of a class needed to act.
SAMPLE_DOCS, THRESHOLD = 1500, 0.3
ROUNDS, RATE, PENALTY = 250, 0.3, 3e-4
#: From which probability on sentences combine, and rounds before they have to reach it.
EVIDENT, WARM = THRESHOLD, 120


def features(word: str) -> list[str]:
    """The word and its beginnings, marked by a dash."""
    return [word] + [word[:n] + "-" for n in PREFIXES if len(word) > n]


def logistic(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


@dataclass
class ToxicityModel:
    """weights are of features; a word's sum is remembered, in a table of bounded size."""

    bias: float
    weights: dict[str, float]
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def values(self, words: list[str]) -> list[float]:
        got = list(map(self.known.get, words))
        if None in got:
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
            weight = self.weights.get
            new = {w: sum(weight(f, 0.0) for f in features(w)) for w, v in zip(words, got) if v is None}
            got = [new[w] if v is None else v for w, v in zip(words, got)]
            if len(new) <= KNOWN_WORDS:
                self.known.update(new)
        return got

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of each sentence, in code points."""
        out = []
        for m in SENTENCE.finditer(text):
            words = list(dict.fromkeys(WORD.findall(m.group().lower())))
            out.append((m.start(), m.end(), logistic(self.bias + sum(self.values(words)))))
        return out

    def score(self, text: str | None, threshold: float = THRESHOLD) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability and the sentences that reach the threshold by themselves."""
        text = text or ""
        base = logistic(self.bias)
        if base < min(threshold, EVIDENT) and not any(self.values(WORD.findall(text.lower()))):  # no sentence has more than the bias
            return base, []
        found = self.sentences(text) or [(0, len(text), base)]
        log_none = sum(math.log1p(-min(p, 1 - 1e-12)) for *_, p in found if p >= EVIDENT)
        return -math.expm1(log_none) if log_none else max(p for *_, p in found), [s for s in found if s[2] >= threshold]


def fit(texts: list[str], labels: list[int], rows_each: list[float], rounds: int = ROUNDS) -> ToxicityModel:
    """rows_each: how many rows a sampled one stands for."""
    y, each = np.array(labels, dtype=float), np.array(rows_each, dtype=float)
    if not len(y):
        return ToxicityModel(-50.0, {})
    # Sentences as rows of a sparse matrix of words, and words as rows of one of features.
    numbers: dict[str, int] = {}
    rows, sentences_of = [], []
    for text in texts:
        found = SENTENCE.findall(text) or [""]
        sentences_of.append(len(found))
        rows += [np.fromiter((numbers.setdefault(w, len(numbers)) for w in dict.fromkeys(WORD.findall(t.lower()))), dtype=np.int32) for t in found]
    n, doc_of = len(y), np.repeat(np.arange(len(y)), sentences_of)
    row, word = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    index: dict[str, int] = {}
    kinds = [[index.setdefault(f, len(index)) for f in features(w)] for w in numbers]
    of, col = np.repeat(np.arange(len(kinds)), [len(k) for k in kinds]), np.array([f for k in kinds for f in k], dtype=np.int64)
    words = list(index)
    share = each / each.sum()
    rate = float((share * y).sum())
    bias = np.log(max(rate, 1e-4)) - np.log(max(len(doc_of) / n, 1.0)) - 2.0
    w, sq_w, sq_b = np.zeros(len(words)), np.full(len(words), 1e-8), 1e-8
    first = np.cumsum(sentences_of) - sentences_of
    for k in range(rounds):
        if k == WARM:
            sq_b = 1e-8  # the bias of one sentence among all is another than that of evident ones
        p = sentence_probabilities(bias, w, (of, col, len(kinds)), (row, word, len(doc_of)))
        g = share[doc_of] * sentence_gradient(p, y, doc_of, first, k >= WARM)
        each_word = np.bincount(word, weights=g[row], minlength=len(kinds))
        gw, gb = np.bincount(col, weights=each_word[of], minlength=len(words)), g.sum()
        sq_w, sq_b = sq_w + gw**2, sq_b + gb**2
        step = RATE / np.sqrt(sq_w)
        w = w - step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * PENALTY, 0)
        bias -= RATE / np.sqrt(sq_b) * gb
    return ToxicityModel(float(bias), {words[i]: float(w[i]) for i in np.flatnonzero(w)})


def sentence_probabilities(bias: float, w: np.ndarray, features_of: tuple, words_of: tuple) -> np.ndarray:
    """features_of: words and their features, and how many words; words_of: sentences and their words, and how many sentences."""
    (of, col, n_words), (row, word, n_rows) = features_of, words_of
    of_word = np.bincount(of, weights=w[col], minlength=n_words)
    z = bias + np.bincount(row, weights=of_word[word], minlength=n_rows)
    return np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-9)


def document_parts(p: np.ndarray, doc_of: np.ndarray, first: np.ndarray, gated: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each document's probability, and which sentences take part in it: all, or the evident ones, or the first of the strongest."""
    part = np.ones(len(p), dtype=bool)
    if gated:
        top = np.maximum.reduceat(p, first)
        at = np.flatnonzero(p == top[doc_of])
        strongest = np.zeros(len(p), dtype=bool)
        strongest[at[np.unique(doc_of[at], return_index=True)[1]]] = True
        part = np.where((top >= EVIDENT)[doc_of], p >= EVIDENT, strongest)
    none = np.bincount(doc_of, weights=np.where(part, np.log1p(-p), 0.0), minlength=len(first))
    return np.clip(-np.expm1(none), 1e-9, 1 - 1e-12), part


def sentence_gradient(p: np.ndarray, y: np.ndarray, doc_of: np.ndarray, first: np.ndarray, gated: bool) -> np.ndarray:
    """d(-log likelihood of its document)/d(logit) of each sentence: p for a clean document, -p (1 - P) / P for a toxic one, 0 for sentences that take no part."""
    doc, part = document_parts(p, doc_of, first, gated)
    return np.where(part, np.where(y == 1, -(1 - doc) / doc, 1.0)[doc_of] * p, 0.0)


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> ToxicityModel:
    """Fits on about sample_docs labelled documents of each class outside the held-out fold."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    drawn, rates = sample_by(known, "toxic", sample_docs)
    # The drawn labels are bounded by the sample's size.
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in sample.toLocalIterator())
    return fit([t for _, t, _ in rows], [y for *_, y in rows], [1 / rates[y] for *_, y in rows])


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, spans: the offending sentences as start:end, in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [], []
            for text in batch.column("text"):
                p, bad = model.score(text.as_py(), threshold)
                scores.append(p)
                spans.append(",".join(f"{a}:{b}" for a, b, _ in bad))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, pa.string())], names=["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, spans string")


def find_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans."""
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
