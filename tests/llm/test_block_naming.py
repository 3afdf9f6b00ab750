import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from assaykit.llm.block_naming import drop_exact_copies, exact_dedup

from .conftest import table


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        top = max(ids, key=lambda i: (i is not None, i or 0))
        kept = False
        for i in sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True):
            out.append((i, top, len(ids), i == top and not kept, hashlib.sha256(text.encode()).hexdigest()))
            kept = kept or i == top
    return sorted(out, key=str)


def test_odd_rows_match_brute_force(spark, odd):
    df, rows = odd
    got = sorted(map(tuple, exact_dedup(spark, df, block_chars=64).collect()), key=str)
    assert got == brute(rows)


def test_colliding_handles_do_not_merge(spark):
    rows = [(i, f"text {i % 7} " + "z" * (i % 3) * 50) for i in range(60)]
    got = exact_dedup(spark, table(spark, rows), block_chars=8, handle=lambda b: F.pmod(F.xxhash64(b), F.lit(5)).cast("long"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_texts_that_differ_in_one_place_or_in_length(spark):
    base = "abcdefgh" * 20
    rows = [(1, base), (2, base[:-1]), (3, base + "x"), (4, "X" + base[1:]), (5, base), (6, base[:80] + "Y" + base[81:]), (7, base * 2)]
    got = sorted(map(tuple, exact_dedup(spark, table(spark, rows), block_chars=8).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark, empty):
    assert exact_dedup(spark, empty).count() == 0
    assert drop_exact_copies(spark, empty).count() == 0


def test_stage_keeps_one_whole_row_of_each_text(spark, odd):
    df, rows = odd
    kept = drop_exact_copies(spark, df)
    assert kept.columns == df.columns
    top = {}
    for doc_id, text in rows:
        top[text or ""] = max((top.get(text or "", None), doc_id), key=lambda i: (i is not None, i or 0))
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str) == sorted(((i, t) for t, i in top.items()), key=str)
