import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest

from assaykit.llm import periodic_runs
from assaykit.llm.queries import op11_periodic_runs


def brute_runs(words, least=12):
    """Every period by itself, word by word; of one stretch the smallest period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words and (h := crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        digest("".join("%d,%d,%d\n" % r for r in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def texts_with_runs(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        size, letters = rng.choice([0, 1, 5, 11, 12, 13, 30, 60, 150]), rng.choice(["a", "ab", "abc", "abcdefghij"])
        words = [rng.choice(letters) for _ in range(size)]
        if size > 20 and rng.random() < 0.6:
            period, start = rng.randrange(1, size // 2), rng.randrange(size // 2)
            for i in range(start + period, size):
                words[i] = words[i - period]
            if rng.random() < 0.5:
                words[rng.randrange(size)] = "zz"
        yield words


def test_runs_equal_brute_force_in_any_grouping():
    docs = list(texts_with_runs(5, 300))
    codes = {w: k for k, w in enumerate("abcdefghij")} | {"zz": 30}
    words = np.array([codes[w] for d in docs for w in d], dtype=np.int64)
    runs = periodic_runs.runs_of(words, np.array([len(d) for d in docs]))
    for k, d in enumerate(docs):
        assert [tuple(r[1:]) for r in runs.tolist() if r[0] == k] == brute_runs(d)


def test_small_blocks_find_the_same(monkeypatch):
    words = np.array([k % 3 for k in range(200)] + [0] * 50, dtype=np.int64)
    sizes = np.array([120, 130])
    whole = periodic_runs.runs_of(words, sizes)
    monkeypatch.setattr(periodic_runs, "BLOCK", 7)
    assert (periodic_runs.runs_of(words, sizes) == whole).all()


def test_overlapping_runs_and_the_least_length():
    words = np.array([0] * 12 + [1] * 11 + [0, 1] * 6, dtype=np.int64)
    runs = periodic_runs.runs_of(words, np.array([len(words)])).tolist()
    assert [0, 0, 12, 1] in runs and not any(r[1] == 12 and r[3] == 1 for r in runs)
    # The last 1 of the ones, then 0 1 0 1 ...: 13 words of period 2.
    assert [0, 22, 13, 2] in runs


def test_query_rows_equal_brute_force(spark, tmp_path):
    rows = [(k, "\t".join(words) if k % 2 else " \n".join(words)) for k, words in enumerate(texts_with_runs(9, 150))]
    rows += [(1000, None), (1001, ""), (1002, " \n\x0b "), (1003, "a a " * 40), (1003, "a a " * 40), (None, "x y " * 30), (1004, "é ü " * 3000)]
    at = str(tmp_path)
    spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, period long, runs string").write.parquet(f"{at}/documents.parquet")
    got = sorted((tuple(r) for r in op11_periodic_runs(spark, at).collect()), key=repr)
    assert got == sorted(((d, *brute_row(d, t)) for d, t in rows), key=repr)


def test_damage_repeats_the_tail():
    chosen = [d for d in range(300) if crc32(str(d).encode()) % 10 == 0]
    assert chosen and all(periodic_runs.repeated_places(50, d) is None for d in range(300) if d not in chosen)
    assert periodic_runs.repeated_places(0, chosen[0]) is None


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "go " + "on and " * 6 + "stop"), (2, None)], "doc_id long, text string")
    runs = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.find_runs(docs).collect()}
    assert runs == {1: [(1, 12, 2)], 2: []}
    assert {r.doc_id: r.text for r in periodic_runs.collapse_runs(docs).collect()} == {1: "go on and stop", 2: ""}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.run_digests(empty).count() == 0


@pytest.mark.parametrize("n", [200_000])
def test_one_long_text(n):
    rng = random.Random(1)
    words = np.array([rng.randrange(3) for _ in range(n)] + [7] * 1000, dtype=np.int64)
    runs = periodic_runs.runs_of(words, np.array([len(words)]))
    assert [0, n, 1000, 1] in runs.tolist() and (runs[:, 2] >= np.maximum(12, 2 * runs[:, 3])).all()
