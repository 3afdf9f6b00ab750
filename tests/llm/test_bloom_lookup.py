import hashlib
import random
import re
import time
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from assaykit.llm._common import Workspace
from assaykit.llm.bloom_lookup import CELLS, EVERY, LONG_WORD, LOWEST, WINDOW, compare_with_edits, paragraph_hashes, recover, with_next

from .conftest import table


def parts(text):
    """Parts between the places where a window of units says so, and line ends."""
    units = []
    for unit in re.findall(r"[ \t\r]*[^ \t\r\n]+|\n|[ \t\r]+", text):
        units += list(unit) if len(unit) > LONG_WORD else [unit]
    part = ""
    for k, unit in enumerate(units):
        part += unit
        seed = 42
        for u in units[max(0, k - WINDOW + 1) : k + 1]:
            seed = xxhash.xxh64_intdigest(u.encode(), seed)
        signed = seed - (1 << 64) if seed >> 63 else seed
        if signed % EVERY == 0 or "\n" in part or "\x01" in part:
            yield from re.split("[\n\x01]", part)
            part = ""
    yield part


def keys(text):
    return set(Counter(p for p in (x.strip(" \t\r") for x in parts(text)) if p).items())


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, got):
    """rows: in order, one document each."""
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.n_chars), []).append(r)
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = by[doc_id, len(text)].pop()
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - likeness(keys(text), keys(edited))) < 1e-9
        assert abs(r.near_next - likeness(keys(text), keys(following))) < 1e-9
    assert not any(by.values())


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = compare_with_edits(spark, docs).collect()
    check(rows, got)
    prints = {}
    for r in got:
        prints.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_odd_rows(spark, odd, empty):
    df, rows = odd
    got = compare_with_edits(spark, df).collect()
    assert len(got) == len(rows)
    twice = [r for r in got if r.doc_id == 6]
    assert len(twice) == 2 and twice[0] == twice[1]
    distinct = [(i, t or "") for i, t in rows if i is not None and i not in (6, 7)]
    by = {r.doc_id: r for r in got}
    for doc_id, text in distinct:
        assert by[doc_id].n_chars == len(text)
    assert by[3].fingerprint == by[4].fingerprint == "" and by[3].near_edited == 1.0
    assert by[2**40].near_next >= 0
    assert compare_with_edits(spark, empty).count() == 0


def test_one_document_is_its_own_next(spark):
    check([(4, "one line\ntwo lines\n")], compare_with_edits(spark, table(spark, [(4, "one line\ntwo lines\n")])).collect())


def test_large_differences_are_retried_until_they_peel(spark):
    sizes = [(0, 0), (0, 5), (3, 0), (10, 9), (60, 80), (400, 700), (0, 3000)]
    rows = []
    for i, (a, b) in enumerate(sizes):
        shared = [10**9 * i + k for k in range(50)]
        rows.append((i, 0, 0, shared + [10**12 + 10**6 * i + k for k in range(a)], shared + [10**13 + 10**6 * i + k for k in range(b)]))
    pairs = spark.createDataFrame(rows, "did long, th long, which int, one array<long>, other array<long>")
    assert max(a + b for a, b in sizes) > CELLS
    got = {r.did: (r.plus, r.minus) for r in recover(pairs, Workspace(spark, "t"), 4).collect()}
    assert {i: got.get(i, (0, 0)) for i in range(len(sizes))} == dict(enumerate(sizes))


LATIN, GREEK = "etaoinshrdlumcwfgypb", "αεηικλμνοπρστυ"
SCRIPTS = {
    "latin": (LATIN, " "), "cyrillic": ("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфё", " "), "greek": (GREEK, " "), "chinese": ("".join(map(chr, range(0x4E00, 0x5600))), ""),
    "digits": ("0123456789", ""), "spaced digits": ("0123456789", " "), "letters without blanks": (LATIN, ""), "emoji": ("".join(map(chr, range(0x1F600, 0x1F640))), ""),
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_an_insertion_into_one_line_changes_few_parts(spark, script):
    """A few characters put at the start or inside of a line of 2,500 characters, in any script."""
    letters, blank = SCRIPTS[script]
    r = random.Random(8)
    rows = []
    for i in range(40):
        words = ["".join(r.choices(letters, k=r.randrange(2, 9))) for _ in range(500)]
        at = 0 if i % 2 else r.randrange(len(words))
        rows.append((blank.join(words), blank.join([*words[:at], "".join(r.choices(letters, k=5)), *words[at:]])))
    df = spark.createDataFrame(rows, "a string, b string").select(paragraph_hashes("a").alias("a"), paragraph_hashes("b").alias("b"))
    near = df.select((F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).alias("n"))
    least, middle = near.agg(F.min("n"), F.percentile("n", F.lit(0.5))).first()
    assert middle > 0.9 and least > 0.8


def test_a_long_word_takes_linear_time(spark):
    text = "".join(random.Random(1).choices(LATIN, k=300_000))
    df = spark.createDataFrame([(text,)], "a string")
    began = time.perf_counter()
    assert df.select(F.size(paragraph_hashes("a"))).first()[0] > 20_000
    assert time.perf_counter() - began < 20


def shuffled(spark):
    """Bytes of all shuffles written so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    executors = sc.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_shuffles_stay_near_the_size_of_the_texts(spark, sf):
    """Texts move once, neighbours' beginnings not at all, and keys once for both comparisons."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    before = shuffled(spark)
    compare_with_edits(spark, docs).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 1.45 * size


@pytest.mark.parametrize("n, partitions", [(1, 3), (2, 1), (50, 2), (700, 1), (700, 3)])
def test_every_document_stands_with_its_next(spark, n, partitions):
    """Stretches of any number, ids out of order, shared by different texts or repeated whole, and a null id."""
    r = random.Random(n)
    ids = [None, *(r.randrange(-(10**12), 10**12) for _ in range(n - 1))]
    rows = [(i, f"text {k} of {i}") for i in ids for k in range(1 + (r.random() < 0.1))]
    again = [row for row in rows if r.random() < 0.1]
    df = table(spark, rows + again).repartition(4)
    th = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - ((h >> 63) << 64)
    order = sorted(((LOWEST if i is None else i), th(t), t) for i, t in rows)
    expected = {(i, h): (t, order[(k + 1) % len(order)][2], 1 + again.count((None if i == LOWEST else i, t))) for k, (i, h, t) in enumerate(order)}
    got = with_next(df, partitions).collect()
    assert len(got) == len(expected)
    assert {(g.did, g.th): (g.text, g.next_text, g.copies) for g in got} == expected
