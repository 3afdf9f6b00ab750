import random
import re

import pytest
import xxhash

from assaykit.llm._common import Workspace
from assaykit.llm.components import connected_components
from assaykit.llm import simhash_pivots
from assaykit.llm.simhash_pivots import block_masks, discarded, fingerprints, links, simhash_dedup


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(prints, radius=4):
    """Least index that each reaches."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_match_brute_force_across_chunks(monkeypatch):
    import assaykit.llm.simhash_pivots as m

    texts = ["", None, "one", "a b c", "A  b\tC d", "é É ü x y", " ".join(f"w{i % 37}" for i in range(900)), "a b c d " * 50]
    want = [fingerprint(t) for t in texts]
    assert fingerprints(texts).tolist() == want
    monkeypatch.setattr(m, "CHUNK_BYTES", 16)
    assert fingerprints(texts).tolist() == want


def near_prints(seed, centres, around, alone):
    r, out = random.Random(seed), []
    for _ in range(centres):
        c = r.getrandbits(64)
        for _ in range(around):
            x = c
            for _ in range(r.randrange(0, 7)):
                x ^= 1 << r.randrange(64)
            out.append(x)
    out += [r.getrandbits(64) for _ in range(alone)]
    chain = r.getrandbits(64)
    for _ in range(30):  # a chain of links whose ends are far apart
        for b in r.sample(range(64), 4):
            chain ^= 1 << b
        out.append(chain)
    return sorted(set(out))


@pytest.mark.parametrize(("small", "few"), [(32, 256), (4, 256), (4, 0)])
def test_links_reach_what_all_pairs_reach(spark, small, few):
    prints = near_prints(small + few, 4, 60, 150)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    work = Workspace(spark, "t")
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = links(df, work, small=small, few=few)
    groups = {r.v: r.c for r in connected_components(found, work, "c").collect()}
    want = components(prints)
    mine = [groups.get(p, p) for p in signed]
    pairs = set(zip(mine, want))
    assert len(pairs) == len(set(mine)) == len(set(want))


def test_every_close_pair_shares_a_block_key():
    r = random.Random(4)
    for n in (10, 10**5, 10**8):
        masks = [m & (1 << 64) - 1 for m in block_masks(n, 4)]
        for _ in range(300):
            a = r.getrandbits(64)
            b = a
            for i in r.sample(range(64), 4):
                b ^= 1 << i
            assert any(a & m == b & m for m in masks)


def test_components_of_chains_and_stars(spark):
    r = random.Random(6)
    edges = {(i, i + 1) for i in range(0, 200)} | {(300, 300 + i) for i in range(1, 80)} | {tuple(sorted(r.sample(range(500, 700), 2))) for _ in range(150)}
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    work = Workspace(spark, "t")
    got = {r.v: r.c for r in connected_components(spark.createDataFrame(list(edges), "u long, v long"), work, "c").collect()}
    assert got == {v: find(v) for v in parent if find(v) != v}


def test_odd_rows(spark, odd):
    df, rows = odd
    prints = [fingerprint(t) for _, t in rows]
    of = components(prints)
    low = {}
    for (doc_id, _), c in zip(rows, of):
        low[c] = min((x for x in (low.get(c), doc_id) if x is not None), default=None)
    want = [(doc_id, f"{p:016x}", low[c]) for (doc_id, _), p, c in zip(rows, prints, of)]
    assert sorted(map(tuple, simhash_dedup(spark, df).collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark, empty):
    assert simhash_dedup(spark, empty).count() == 0


def test_pivots_discard_before_bits_are_compared(spark):
    """Of random pairs nearly all go by the table; of pairs within the radius none does."""
    r = random.Random(6)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    far, close = [], []
    for _ in range(4000):
        a = r.getrandbits(64)
        far.append((signed(a), signed(r.getrandbits(64))))
        b = a
        for bit in r.sample(range(64), r.randrange(5)):
            b ^= 1 << bit
        close.append((signed(a), signed(b)))
    got = discarded(spark.createDataFrame(far, "u long, v long")).first()
    assert got.by_pivots > 0.99 * got.n and got.linked == 0
    got = discarded(spark.createDataFrame(close, "u long, v long")).first()
    assert (got.by_pivots, got.by_bits, got.linked) == (0, 0, 4000)


def test_no_link_passes_by_the_pivots(spark, monkeypatch):
    """With a table that denies every pair, nothing is linked: neither in small buckets nor in dense ones, nor by shared points."""
    prints = near_prints(3, 4, 60, 50)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    monkeypatch.setattr(simhash_pivots, "pivot_bound", lambda radius: -1)
    for small, few in ((32, 256), (4, 0), (4, 256)):
        assert simhash_pivots.links(df, Workspace(spark, "t"), small=small, few=few).count() == 0
