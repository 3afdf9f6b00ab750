import math
import random
import zlib

import numpy as np
import pytest

from assaykit.llm.noisy_or import EVIDENT, ToxicityModel, document_parts, find_toxicity, fit, sentence_gradient

from .conftest import table

CLEAN = [f"word{i}ish" for i in range(60)]
BAD = ["vilest", "rotten", "grubbyx", "grubbyz"]


def documents(n, seed):
    r, out = random.Random(seed), []
    for i in range(n):
        toxic = r.random() < 0.3
        sentences = [" ".join(r.choices(CLEAN, k=8)).capitalize() for _ in range(r.randrange(2, 9))]
        if toxic:
            k = r.randrange(len(sentences))
            sentences[k] += " " + r.choice(BAD)
        out.append((i, ". ".join(sentences) + ".", int(toxic)))
    return out


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_noisy_or_of_evident_sentences():
    model = ToxicityModel(-2.0, {"bad": 3.0, "worse": 4.0, "weak": 1.0})
    p = lambda z: 1 / (1 + math.exp(-z))
    score, spans = model.score("All is well. This is bad! Fine")
    assert abs(score - p(1)) < 1e-9 and [(a, b) for a, b, _ in spans] == [(12, 25)]
    # Evident ones combine; weak ones add nothing to them.
    assert abs(model.score("Bad. Worse. Weak. Weak.")[0] - (1 - (1 - p(1)) * (1 - p(2)))) < 1e-9
    # Without an evident one, the strongest stands for the document.
    assert p(-1) < EVIDENT and abs(model.score("fine. weak. " * 1000)[0] - p(-1)) < 1e-9
    assert abs(model.score("fine. well")[0] - p(-2)) < 1e-9
    assert abs(model.score(None)[0] - p(-2)) < 1e-9 and model.score("")[0] == model.score(None)[0]


def test_length_alone_makes_nothing_toxic():
    """20,000 clean sentences, nearly all alike, or all of different known clean words, score as one does."""
    rows = documents(600, 2)
    model = fit([t for _, t, _ in rows], [y for *_, y in rows], [1.0] * len(rows))
    r = random.Random(1)
    for text in ("Word1ish word2ish word3ish. " * 20_000, " ".join(" ".join(r.choices(CLEAN, k=8)).capitalize() + "." for _ in range(20_000))):
        score, spans = model.score(text)
        assert score < 0.3 and not spans


@pytest.mark.parametrize("gated", [False, True])
def test_gradient_equals_differences(gated):
    rng = np.random.default_rng(3)
    sizes = np.array([1, 3, 5, 2, 4, 6])
    doc_of, first = np.repeat(np.arange(6), sizes), np.cumsum(sizes) - sizes
    y = np.array([0, 1, 1, 0, 1, 0])
    z = rng.normal(-1.2, 1.2, sizes.sum())
    z[first[2] : first[2] + 5] = -4 + rng.random(5)

    def loss(z):
        doc, _ = document_parts(1 / (1 + np.exp(-z)), doc_of, first, gated)
        return -np.where(y == 1, np.log(doc), np.log1p(-doc)).sum()

    got = sentence_gradient(1 / (1 + np.exp(-z)), y, doc_of, first, gated)
    step = 1e-6
    want = [(loss(z + step * e) - loss(z - step * e)) / (2 * step) for e in np.eye(len(z))]
    assert np.abs(got - want).max() < 1e-5
    assert not gated or (got == 0).any()


def test_learns_sentences_from_document_labels(spark):
    rows = documents(900, 1)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    rows = [(i, t) for i, t, _ in rows]
    got = {r.doc_id: r for r in find_toxicity(spark, table(spark, rows), labels).collect()}
    truth = {i: y for i, _, y in documents(900, 1)}
    test = [i for i in truth if held(i)]
    assert all(got[i].held_out == held(i) and 0 <= got[i].score <= 1 for i in truth)
    assert sum(got[i].predicted == truth[i] for i in test) >= 0.98 * len(test)
    texts = dict(rows)
    for i in test:
        if truth[i] and got[i].predicted:
            spans = [tuple(map(int, s.split(":"))) for s in got[i].spans.split(",")]
            assert any(any(b in texts[i][x:y] for b in BAD) for x, y in spans)


def test_unseen_word_counts_by_its_beginning():
    rows = documents(600, 2)
    model = fit([t for _, t, _ in rows], [y for *_, y in rows], [1.0] * len(rows))
    assert model.score("Some word1ish words with grubbyq inside.")[0] > 0.3 > model.score("Some word1ish words.")[0]


def test_odd_rows_and_no_labels(spark, odd, empty):
    df, rows = odd
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = find_toxicity(spark, df, none).collect()
    assert len(got) == len(rows) and all(r.score < 1e-6 and r.predicted == 0 for r in got)
    some = spark.createDataFrame([(1, 0), (2, 1), (3, None), (5, 1), (None, 1), (12, 1), (12, 0)], "doc_id long, toxic int")
    assert find_toxicity(spark, df, some).count() == len(rows)
    assert find_toxicity(spark, empty, some).count() == 0
