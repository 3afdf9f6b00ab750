"""Paged source, living build, hash tree, file manifests, tokenizer adapters, distractors by join."""

import json

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assaykit.operators import checks, items, metrics, tokens
from assaykit.sources import paged, sinks
from assaykit.sources.scratch import keeper
from assaykit.streaming import living


def pages(spark, folder):
    spark.dataSource.register(paged.PagedSource)
    return sorted(((r.place, r.token, r.record and json.loads(r.record) if not r.broken else r.record, r.missing, r.broken) for r in spark.read.format("pages").option("path", str(folder)).load().collect()), key=repr)


def test_pages_are_read_along_their_tokens(spark, tmp_path):
    put = lambda token, body: (tmp_path / f"page-{token}.json").write_text(body if isinstance(body, str) else json.dumps(body))
    put("", {"records": [{"i": 1}, {"i": 2}], "nextPageToken": "zz"})
    put("zz", {"records": [], "nextPageToken": "lost"})
    put("b", {"records": [{"i": 5}], "nextPageToken": "c"})
    put("c", {"records": [{"i": 6, "é": None}]})
    (tmp_path / "notes.txt").write_text("x")
    assert pages(spark, tmp_path) == [(0, "", {"i": 1}, False, False), (0, "", {"i": 2}, False, False), (2, "lost", None, True, False), (3, "b", {"i": 5}, False, False), (4, "c", {"i": 6, "é": None}, False, False)]
    put("lost", {"records": [{"i": 4}], "nextPageToken": "b"})
    assert [(p, t, r["i"]) for p, t, r, *_ in pages(spark, tmp_path)] == [(0, "", 1), (0, "", 2), (2, "lost", 4), (3, "b", 5), (4, "c", 6)]
    put("c", "{broken")
    assert pages(spark, tmp_path)[-1] == (4, "c", "{broken", False, True)


def test_pages_of_one_partition_and_the_chain_left_out(spark, tmp_path):
    put = lambda token, body: (tmp_path / f"page-{token}.json").write_text(body if isinstance(body, str) else json.dumps(body))
    assert [tuple(r) for r in paged.read_pages(spark, str(tmp_path)).collect()] == [("", None, True, False)]
    tokens = ["", *(f"t{k:04}" for k in range(1, 3 * paged.FILES))]
    for token, onward in zip(tokens, [*tokens[1:], "lost"]):
        put(token, {"records": [{"i": token}, {"i": token}], "nextPageToken": onward})
    put("t0007", {"records": [{"i": 1}], "nextPageToken": "gone"})
    put("z", "{broken")
    put("zz", {"records": None, "nextPageToken": "gone"})
    rows = paged.read_pages(spark, str(tmp_path))
    assert rows.select("token", "record", "missing", "broken").exceptAll(spark.read.format("pages").option("path", str(tmp_path)).load().drop("place")).count() == 0
    assert sorted(r.token for r in rows.filter("missing").collect()) == ["gone", "lost"] and rows.count() == 2 * len(tokens) - 1 + 1 + 2
    # Pages share partitions, and planning opens none of them.
    reader, opened = paged.PagedReader(str(tmp_path), "captured"), []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(paged, "_text", lambda *a: opened.append(a))
        assert len(reader.partitions()) == 4 and not opened


def test_chains_that_loop_or_have_no_beginning():
    assert paged.chain({"": "a", "a": "b", "b": "a"}) == [("", False), ("a", False), ("b", False)]
    assert paged.chain({}) == [("", True)]
    assert paged.chain({"x": "y", "y": "x"}) == [("", True), ("x", False), ("y", False)]
    assert paged.chain({"": None, "q": None, "k": None}) == [("", False), ("k", False), ("q", False)]


SCHEMA = "id string, day string, v int"


def test_living_build_in_any_order_equals_one_build(spark, tmp_path):
    first, second = [("a", "2024-01-05", 1), ("b", "2024-02-01", 2), ("b", "2024-02-01", 2)], [("a", "2023-12-01", 9), ("c", "2024-03-01", None), ("b", "2024-02-01", 2), (None, "2024-01-09", 4)]
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)

    def make(records):
        early = records.groupBy("id").agg(F.min("day").alias("since")).filter("since >= '2024-01-01'")
        return records.join(early, "id")

    want = sorted(map(tuple, make(frame(first + second).distinct()).collect()), key=repr)
    for k, order in enumerate(((first, second), (second, first))):
        root = tmp_path / str(k)
        for n, rows in enumerate(order):
            frame(rows).write.json(f"{root}/landing/{n}")
            living.land(spark, f"{root}/landing/*", SCHEMA, f"{root}/store", f"{root}/progress").awaitTermination()
        # The same files once more, under a checkpoint that has seen none.
        living.land(spark, f"{root}/landing/*", SCHEMA, f"{root}/store", f"{root}/other").awaitTermination()
        assert sorted(map(tuple, living.rebuild(spark, f"{root}/store", SCHEMA, make).collect()), key=repr) == want
    assert living.records(spark, f"{tmp_path}/nowhere", SCHEMA).count() == 0


def test_a_tree_of_hashes_finds_what_differs(spark):
    base = spark.range(20000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("v"), F.lit(None).cast("string").alias("_k"))
    changed = base.withColumn("v", F.when(F.col("k") == "4711", 99).otherwise(F.col("v"))).filter("k <> '17'").unionByName(base.filter("k = '5'")).unionByName(spark.createDataFrame([(None, 1, "x")], "k string, v long, _k string")).repartition(3)
    got = sorted((r.k, r.v, r.only) for r in checks.tree_difference(base, changed, "k", keeper(spark, "t")).fillna("null", ["k"]).collect())
    assert got == [("17", 3, "first"), ("4711", 0, "first"), ("4711", 99, "second"), ("5", 5, "second"), ("null", 1, "second")]
    assert checks.tree_difference(base, base.repartition(5, "v"), "k", keeper(spark, "t")).count() == 0


def test_one_changed_row_leads_to_few_rows(spark):
    base = spark.range(1_000_000).select("id", (F.col("id") % 11).alias("v"))
    seen = []
    keep = keeper(spark, "t")
    found = checks.tree_difference(base, base.withColumn("v", F.when(F.col("id") == 777_777, 50).otherwise(F.col("v"))), "id", lambda df: seen.append(keep(df)) or seen[-1])
    assert sorted((r.id, r.v, r.only) for r in found.collect()) == [(777_777, 777_777 % 11, "first"), (777_777, 50, "second")]
    assert [s.count() for s in seen] == [1, 1, 1]


def test_manifests_name_a_file_whose_byte_changed(spark, tmp_path):
    spark.range(100).select(F.col("id").cast("string"), (F.col("id") % 3).alias("p")).write.partitionBy("p").text(f"{tmp_path}/out")
    told = checks.file_manifest(spark, f"{tmp_path}/out").collect()
    told = spark.createDataFrame(told)
    assert told.count() >= 3 and not told.filter("file like '%_SUCCESS%' or bytes = 0").count()
    assert checks.changed_files(told, checks.file_manifest(spark, f"{tmp_path}/out")).count() == 0
    one = sorted((tmp_path / "out").rglob("part-*"))[0]
    body = bytearray(one.read_bytes())
    body[0] ^= 1
    one.write_bytes(body)
    # Hadoop's own sum beside the file would refuse it first.
    one.with_name(f".{one.name}.crc").unlink()
    (tmp_path / "out" / "p=1" / "part-more").write_text("x")
    got = {r.file: r.why for r in checks.changed_files(told, checks.file_manifest(spark, f"{tmp_path}/out")).collect()}
    assert got == {str(one.relative_to(tmp_path / "out")): "changed", "p=1/part-more": "new"}


def test_label_tokens_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    labels = ["A", "B", "Z", "yes", "Überzeugung", "xqzt", ""]
    df = spark.createDataFrame([(x,) for x in [*labels, "A", None]], "label string")
    got = {r.label: (r.variant, r.single) for r in tokens.label_tokens(df, "label", {"b": ("tokenizers", path)}).collect()}
    for x in labels:
        fits = [v for v in (f" {x}", x) if len(library.encode(v, add_special_tokens=False).ids) == 1]
        assert got[x] == ((fits or [None])[0], bool(fits))
    assert set(got) == set(labels)


def test_own_adapters_and_unknown_ones(spark):
    tokens.register("spaces")(lambda path: lambda texts: [t.split() for t in texts])
    with pytest.raises(ValueError):
        tokens.adapter("nothing", "x")
    assert tokens.adapter("spaces", "x")(["a b"]) == [["a", "b"]]


def test_distractors_are_others_of_the_group_and_differ_by_record(spark):
    rows = [(str(k), f"c{k % 40}" if k % 50 else None, "x" if k % 2 else None) for k in range(1, 400)] + [("tiny", "t0", "t"), ("tiny2", "t1", "t"), ("1", "c1", "x")]
    df = spark.createDataFrame(rows, "id string, gold string, grp string")
    got = items.ring_distractors(df, "id", "gold", ["grp"], 3, 7).collect()
    assert len(got) == len(rows)
    for r in got:
        pool = {g for _, g, h in rows if h == r.grp and g}
        assert r.gold is None and r.others == [] or len(r.others) == min(3, len(pool) - 1) and set(r.others) <= pool - {r.gold} and len(set(r.others)) == len(r.others)
    # Two records that share their first distractor seldom share the others.
    runs = {tuple(r.others) for r in got if len(r.others) == 3}
    assert len(runs) > 150


def test_files_are_written_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([("a.json", "1"), ("b.json", None)], "file string, body string")
    sinks.write_files(rows, str(tmp_path))
    assert {f.name: f.read_text() for f in tmp_path.iterdir()} == {"a.json": "1", "b.json": ""}


def test_an_item_predicted_twice_counts_once(spark):
    it = spark.createDataFrame([("a", "s"), ("b", "s")], "item_id string, source string")
    pred = spark.createDataFrame([("a",), ("a",)], "item_id string")
    assert [tuple(r) for r in metrics.coverage(it, pred, ["source"]).collect()] == [("s", 2, 1, 0.5)]


def test_parameters_from_a_file(spark, tmp_path):
    from assaykit.config import RunConfig, load_config

    put = lambda text: (tmp_path / "run.yaml").write_text(text) and str(tmp_path / "run.yaml")
    assert load_config(spark, put("# a run\nseed: 11\ndrop_at: 1\ncandidate_counts: [2, 3]\n\n")) == RunConfig(seed=11, drop_at=1.0, candidate_counts=(2, 3))
    assert load_config(spark, put('{"bins": 10}')) == RunConfig(bins=10)
    for text in ("sed: 1", "seed: x", "seed: 1.5", "seed", 'candidate_counts: ["a"]'):
        with pytest.raises(ValueError):
            load_config(spark, put(text))


def test_short_passages_meet_by_their_characters(spark):
    from assaykit.operators import passages

    texts = [(1, "ab cd"), (2, "b c"), (3, "xb cy\nz"), (4, ""), (5, None), (6, "🙂a b"), (6, "🙂a b")]
    asked = [(1, "b c"), (2, "b"), (3, "y\nz"), (4, ""), (5, None), (6, "🙂a"), (7, "ab"), (8, "zz zz")]
    frame = passages.holders(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, passage string"))
    assert sorted(map(tuple, frame.collect())) == sorted((d, i) for d, t in texts for i, p in asked if t is not None and p is not None and p in t)
    assert "NestedLoop" not in passages.holders(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(1, "b c")], "item_id long, passage string"))._jdf.queryExecution().executedPlan().toString()
