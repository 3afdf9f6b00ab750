import random
from collections import defaultdict

import numpy as np

from assaykit.llm._common import Workspace
from assaykit.llm import shingle_links
from assaykit.llm.shingle_links import _between, bands, drop_near_copies, near_copy_groups, shingles
from assaykit.llm.simhash_pivots import fingerprints

from .conftest import table


def brute(rows):
    """Groups of all pairs of similarity 0.8 or fingerprints within 4 bits."""
    sets, prints = [set(shingles(t).tolist()) for _, t in rows], fingerprints([t for _, t in rows]).tolist()
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)) or (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[find(i)].append(doc_id)
    return groups.values()


def near_rows(seed, groups=12, each=14, alone=60):
    r, out = random.Random(seed), []
    for _ in range(groups):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randrange(30, 200))]
        for _ in range(each):
            copy = list(words)
            for _ in range(r.randrange(0, 1 + len(words) // 40)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            out.append(" ".join(copy))
    out += [" ".join(f"w{r.randrange(3000)}" for _ in range(80)) for _ in range(alone)]
    r.shuffle(out)
    return [(i, t) for i, t in enumerate(dict.fromkeys(out))]


def test_groups_are_those_of_all_pairs(spark):
    rows = near_rows(7)
    want = sorted(sorted(g) for g in brute(rows))
    got = defaultdict(list)
    for r in near_copy_groups(spark, table(spark, rows)).collect():
        got[r.c].append(r.doc_id)
    assert sorted(map(sorted, got.values())) == want
    kept = drop_near_copies(spark, table(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in want)


def test_bands_of_equal_sets_are_equal():
    hashes = shingles("a b c d e f g h i j")
    assert bands(hashes) == bands(np.unique(np.concatenate([hashes, hashes]))) and len(bands(hashes)) == 20 and bands(hashes[:0]) == []


def test_odd_rows(spark, odd, empty):
    df, rows = odd
    kept = drop_near_copies(spark, df)
    assert kept.columns == df.columns
    left = kept.collect()
    assert len(left) <= len(rows)
    assert sum(r.doc_id == 1 for r in left) == 1 and not any(r.doc_id == 6 for r in left)
    assert drop_near_copies(spark, empty).count() == 0


def test_copies_that_resemble_only_the_hub(spark):
    """400 edited copies of one text, each similar to it and to few or none of the others, which large buckets hold."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows = [(1000, " ".join(words))]
    for i in range(400):
        copy = list(words)
        for at in range(0, 400, 50):
            copy[at + r.randrange(4, 46)] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    sets = [set(shingles(t).tolist()) for _, t in rows]
    like = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(1, 60) for b in range(a)]
    assert min(len(sets[0] & s) / len(sets[0] | s) for s in sets) >= 0.8 and sum(x >= 0.8 for x in like) < 0.2 * len(like)
    want = sorted(sorted(g) for g in brute(rows))
    got = defaultdict(list)
    for g in near_copy_groups(spark, table(spark, rows)).collect():
        got[g.c].append(g.doc_id)
    assert sorted(map(sorted, got.values())) == want


def test_a_large_bucket_is_compared_whole(spark):
    """Members of one large bucket, most of them unlike all others; the similar pairs are among those that come last."""
    r = random.Random(5)
    texts = [" ".join(f"v{r.randrange(10**6)}" for _ in range(60)) for _ in range(300)]
    for i in range(0, 80, 2):
        texts[i + 1] = texts[i] + " end"
    rows = [(i, t) for i, t in enumerate(texts)]
    large = spark.createDataFrame([(0, 1, i, i) for i in range(300)], "b int, k long, vid long, n long")
    sets = spark.createDataFrame([(i, shingles(t).view(np.int64).tolist()) for i, t in rows], "vid long, s array<long>")
    none = spark.createDataFrame([], "vid long, c long")
    got = _between(large, none, sets, Workspace(spark, "test"), 0.8).collect()
    assert sorted((g.vid, g.c) for g in got) == [(i + 1, i) for i in range(0, 80, 2)]


def test_rare_shingles_meet_every_similar_pair(spark):
    rng = np.random.default_rng(5)
    base = list(range(60))
    texts = [sorted(set(rng.choice(base, rng.integers(40, 60), replace=False).tolist()) | {1000 + int(x) for x in rng.integers(0, 40, rng.integers(0, 12))}) for _ in range(90)]
    rows = spark.createDataFrame([(0, 1, i, i // 3, 0) for i in range(90)], "b int, k long, vid long, c long, top long")
    sets = spark.createDataFrame(list(enumerate(texts)), "vid long, s array<long>")
    got = {(r.u, r.v) for r in shingle_links._rare_pairs(rows, sets, Workspace(spark, "rare"), 0.8).collect()}
    near = {(i, j) for i in range(90) for j in range(i + 1, 90) if i // 3 != j // 3 and len(set(texts[i]) & set(texts[j])) >= 0.8 * len(set(texts[i]) | set(texts[j]))}
    assert near and near <= got
