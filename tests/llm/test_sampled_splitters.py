import zlib
from collections import Counter, defaultdict

import pytest

from assaykit.llm.sampled_splitters import shard_by_bytes, write_shards

from .conftest import table


def check(rows, got, shards=8):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(spark, odd):
    df, rows = odd
    check(rows, shard_by_bytes(spark, df).collect())


def test_empty_table(spark, empty):
    assert shard_by_bytes(spark, empty).count() == 0


@pytest.mark.parametrize("hot", [0, 700])
def test_sizes_are_near_equal_and_groups_stay_together(spark, hot):
    rows = [(i, "hot text " * 20 if i < hot else f"text {i % 1500} " * (1 + i % 40)) for i in range(3000)]
    got = shard_by_bytes(spark, table(spark, rows)).collect()
    check(rows, got)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    total = sum(sizes.values())
    assert len(sizes) == 8 and max(sizes.values()) < 1.03 * total / 8 and min(sizes.values()) > 0.97 * total / 8
    where, bytes_ = defaultdict(set), Counter()
    for r in got:
        where[r.text_crc32].add(r.shard)
        bytes_[r.text_crc32] += r["size"]
    assert all(len(s) == 1 for k, s in where.items() if bytes_[k] <= total / 8)


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(50)]
    docs = table(spark, rows)
    write_shards(docs, shard_by_bytes(spark, docs, shards=2), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == rows
