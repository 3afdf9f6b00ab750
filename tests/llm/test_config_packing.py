import itertools
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers

from assaykit.llm._vocab import tokenizer
from assaykit.llm.config_packing import cover, pack, plan, price

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, got):
    library = tokenizer(PATH)
    want = []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) % 1024 if len(ids) > 1024 else 0
        starts = ([0] if first else []) + list(range(first, len(ids), 1024))
        want += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences), sum(r.length for r in got)


def test_odd_rows(spark, odd):
    df, rows = odd
    check(rows, pack(spark, df, PATH).collect())


def test_empty_table(spark, empty):
    assert pack(spark, empty, PATH).count() == 0


def test_real_documents_fill_their_sequences(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    n, tokens = check([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], pack(spark, df, PATH).collect())
    assert n <= 1.02 * -(-tokens // 1024)


def test_plan_places_every_piece_once():
    r = random.Random(2)
    for _ in range(20):
        counts = {r.randrange(1, 33): r.randrange(1, 60) for _ in range(r.randrange(1, 20))}
        seen, used = defaultdict(int), defaultdict(int)
        for length, low, high, first, offset in plan(counts, 32):
            assert low == seen[length] and offset + length <= 32
            seen[length] = high
            for s in range(first, first + high - low):
                used[s] += length
        assert seen == counts and max(used.values()) <= 32
        assert sum(used.values()) == sum(k * n for k, n in counts.items())


def test_pricing_finds_the_best_configuration():
    r = random.Random(3)
    for _ in range(30):
        values = np.array([-np.inf] + [r.random() if r.random() < 0.6 else -np.inf for _ in range(12)])
        best = [0.0] * 13
        for room in range(1, 13):
            best[room] = max([best[room - 1], *(best[room - k] + values[k] for k in range(1, room + 1))])
        config = price(values, 12)
        assert sum(k * n for k, n in config.items()) <= 12
        assert abs(sum(values[k] * n for k, n in config.items()) - best[12]) < 1e-9


def configurations(lengths, capacity):
    """Every maximal or smaller multiset of lengths that fits."""
    if not lengths:
        return [{}]
    k, rest = lengths[0], lengths[1:]
    return [{**c, k: n} if n else c for n in range(capacity // k + 1) for c in configurations(rest, capacity - n * k)]


def exact_program(counts, capacity):
    """The program's optimum in fractions: dual simplex by vertex enumeration over three lengths."""
    lengths = sorted(counts)
    rows = [[Fraction(c.get(k, 0)) for k in lengths] for c in configurations(lengths, capacity) if c]
    walls = [(r, Fraction(1)) for r in rows] + [([Fraction(int(i == j)) for j in range(len(lengths))], Fraction(0)) for i in range(len(lengths))]
    best = Fraction(0)
    for chosen in itertools.combinations(walls, len(lengths)):
        y = solve([c for c, _ in chosen], [b for _, b in chosen])
        if y and min(y) >= 0 and all(sum(a * v for a, v in zip(r, y)) <= 1 for r in rows):
            best = max(best, sum(counts[k] * v for k, v in zip(lengths, y)))
    return best


def solve(a, b):
    m = [[*r, v] for r, v in zip(a, b)]
    for i in range(len(m)):
        pivot = next((r for r in range(i, len(m)) if m[r][i]), None)
        if pivot is None:
            return None
        m[i], m[pivot] = m[pivot], m[i]
        m[i] = [v / m[i][i] for v in m[i]]
        m = [r if j == i else [x - r[i] * y for x, y in zip(r, m[i])] for j, r in enumerate(m)]
    return [r[-1] for r in m]


def test_the_program_is_bounded_by_its_exact_optimum():
    r = random.Random(5)
    for _ in range(12):
        capacity = r.randrange(8, 13)
        counts = {k: r.randrange(1, 40) for k in r.sample(range(2, capacity), 3)}
        histogram = np.zeros(capacity + 1, dtype=np.int64)
        for k, n in counts.items():
            histogram[k] = n
        found, total, bound = cover(histogram, capacity)
        covered = {k: sum(c.get(k, 0) * t for c, t in found) for k in counts}
        assert all(abs(covered[k] - n) < 1e-6 for k, n in counts.items()) and all(sum(k * n for k, n in c.items()) <= capacity for c, _ in found)
        best = float(exact_program(counts, capacity))
        assert bound <= best + 1e-6 and best - 1e-6 <= total <= 1.25 * best


def test_the_gap_closes_and_the_program_places_most_pieces():
    """Lengths of a wide spread: the program is solved to within a hundredth, and what it places needs no best fit."""
    r = np.random.Generator(np.random.PCG64(4))
    histogram = np.bincount(np.minimum(1023, r.lognormal(5.5, 0.9, 20_000).astype(int) + 1), minlength=1025)
    found, total, bound = cover(histogram, 1024)
    assert total <= 1.01 * bound
    full = sum(int(t + 1e-6) * sum(c.values()) for c, t in found if sum(k * n for k, n in c.items()) == 1024)
    assert full >= 0.8 * histogram.sum()
    used = sum(high - low for _, low, high, _, offset in plan({k: int(n) for k, n in enumerate(histogram) if n}) if offset == 0)
    assert used <= 1.001 * -(-int(histogram @ np.arange(1025)) // 1024)
