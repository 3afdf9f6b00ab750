import pytest
from pyspark.sql import functions as F

from assaykit.operators import board, bootstrap, calibration, checks, gates, metrics, probes, sampling, screen
from assaykit.operators import items as I
from assaykit.schema import ITEM, validated


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def item(**change):
    base = {
        "item_id": "i", "tier": "fresh", "source": "s", "source_record_id": "r", "record_date": None, "split": "test", "template_id": "t", "qtype": "choice", "state": "text",
        "options": [("a", "A", None), ("b", "B", None)], "gold": "a",
    }
    return base | change


def items_df(spark, *items):
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL(ITEM)
    return spark.createDataFrame([tuple(i.get(f.name) for f in schema.fields) for i in items], schema)


@pytest.mark.parametrize(
    ("change", "fault"),
    [
        ({}, None), ({"gold": "z"}, "gold"), ({"qtype": "score", "options": [("a", "A", None)]}, "levels"), ({"state": None}, "state"), ({"item_id": None}, "item_id"),
        ({"qtype": "noul"}, "noul"), ({"split": "other"}, "split"), ({"tier": "old"}, "tier"), ({"options": None}, "gold"),
    ],
)
def test_validation(spark, change, fault):
    good, bad = validated(items_df(spark, item(**change)))
    assert (good.count(), bad.count()) == ((1, 0) if fault is None else (0, 1))
    assert fault is None or fault in bad.first().faults


def scored(spark, values):
    return spark.createDataFrame(values, "template_id string, ok boolean, conf double, gold string")


def test_macro_and_micro(spark):
    df = scored(spark, [("x", i < 9, 0.9, "g") for i in range(10)] + [("y", False, 0.9, "g")] * 2)
    df = df.withColumn("m", F.lit("m"))
    assert rows(metrics.accuracy(df, ["m"])) == [("m", 12, 0.75)]
    assert rows(metrics.macro_accuracy(df, ["m"])) == [("m", 2, 0.45)]


def test_ece_and_majority(spark):
    df = scored(spark, [("x", i < 3, 0.9, "yes" if i < 3 else "no") for i in range(4)])
    assert rows(metrics.ece(df, ["template_id"])) == [("x", 4, 0.15)]
    ten = scored(spark, [("x", True, 0.9, "yes" if i < 7 else "no") for i in range(10)])
    assert rows(metrics.majority(ten, ["template_id"])) == [("x", 10, 0.7)]


def test_flip_rate(spark):
    a = spark.createDataFrame(list(enumerate("abcd")), "parent_id long, content string").withColumn("m", F.lit("m"))
    b = spark.createDataFrame(list(enumerate("accd")), "parent_id long, content string").withColumn("m", F.lit("m"))
    assert rows(probes.flip_rate(a, b, ["m"])) == [("m", 4, 0.25)]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("item_id"), (F.col("id") % 3).cast("string").alias("source"), (F.col("id") % 5).cast("string").alias("template_id"))
    for n in (1, 7):
        part = df.repartition(n)
        got = rows(sampling.cap(part, ["source"], 10, 1)), rows(sampling.stratified(part, "source", "template_id", 10, 1)), rows(sampling.balanced(part, ["source"], "template_id", 1, "item_id"))
        assert n == 1 or got == first
        first = got
    assert len(got[0]) == 30 and len({(r[1], r[2]) for r in got[1]}) == 15
    assert sampling.cap(df, ["source"], 1000, 1).count() == 500


def test_stale_leaks_and_rebuilds(spark):
    df = spark.createDataFrame([("s", "r", "dev", "fresh", "2024-01-01"), ("s", "r", "test", "fresh", "2025-01-01"), ("s", "q", "test", "established", "2020-01-01")], "source string, source_record_id string, split string, tier string, record_date string")
    assert rows(checks.split_leaks(df)) == [("s", "r", 2)]
    assert checks.stale(df.withColumn("record_date", F.to_date("record_date")), F.to_date(F.lit("2024-06-01"))).count() == 1
    assert checks.rebuild_difference(df, df.repartition(3)).count() == 0
    assert rows(checks.rebuild_difference(df, df.limit(2)).select("only")) == [("first",)]
    same = [checks.content_hash(df.repartition(n), ["source"], "split").first().sha256 for n in (1, 4)]
    assert same[0] == same[1]


def test_claims_go_on_from_the_ledger(spark):
    ledger = spark.createDataFrame([("C009",)], "id string")
    new = spark.createDataFrame([("b",), ("a",)], "claim string")
    assert rows(board.append_claims(ledger, new, "claim").select("id", "claim")) == [("C010", "a"), ("C011", "b")]


def test_gates_fail_on_nulls(spark):
    df = spark.createDataFrame([(0.05, None)], "v double, w double")
    assert gates.at_most(df, "g", "v", 0.05, "no").first()["pass"] is True
    assert tuple(gates.at_least(df, "g", "w", 0.0, "no").first()) == ("g", None, 0.0, False, "no")


def test_drop_rule_and_keywords(spark):
    df = spark.createDataFrame([("a", 0.95, None), ("b", 0.9, 0.9), ("c", None, None)], "template_id string, regex double, bow double")
    assert rows(screen.drop_rule(df).select("template_id", "dropped")) == [("a", True), ("b", False), ("c", False)]
    rule = screen.keyword_rule("t", [("one", "1"), ("two", "2")], "0")
    assert [r[0] for r in spark.createDataFrame([("two one",), ("two",), ("x",)], "t string").select(rule).collect()] == ["1", "2", "0"]


def test_intervals_hold_the_mean_and_agree(spark):
    df = spark.range(300).select(F.lit("t").alias("g"), F.col("id").cast("string").alias("item_id"), (F.col("id") % 4 == 0).alias("ok"))
    for means in (bootstrap.exact_means(df, "g", "ok", n=200), bootstrap.poisson_means(df, "g", "ok", n=200)):
        _, low, high = bootstrap.interval(means, ["g"]).first()
        assert 0.18 < low < 0.25 < high < 0.32


def test_temperature_recovers_a_scale(spark):
    import math

    out = []
    for i in range(400):
        p = 0.5 + (i % 40) / 100
        z = math.log(p / (1 - p))
        out.append(("q", [3 * z, 0.0], 0 if (i * 37 % 100) / 100 < p else 1))
    df = spark.createDataFrame(out, "qtype string, logits array<double>, gold_index int")
    assert abs(calibration.fit_temperatures(df, ["qtype"]).first().t - 3.0) <= 0.5


def test_templates_hide_the_answer_and_drop_unanswerable_records(spark):
    df = spark.createDataFrame(
        [("n1", "Title A", "Title A: a Phase 2 trial", "more", ["c"], "Phase 2", "RANDOMIZED", ["DRUG"], True), ("n2", "T", "s", None, ["c"], None, None, ["DRUG", "DEVICE"], None)],
        "nct_id string, title string, brief_summary string, detailed_description string, conditions array<string>, phase string, allocation string, intervention_types array<string>, healthy_volunteers boolean",
    ).withColumn("first_posted", F.to_date(F.lit("2025-01-02")))
    phase = I.trial_phase(df, 1).collect()
    assert [r.source_record_id for r in phase] == ["n1"] and "Phase 2" not in phase[0].state and "Title A" not in phase[0].state
    assert {o.key for o in phase[0].options} == {"Phase 1", "Phase 2", "Phase 3", "Phase 4"}
    assert [r.gold for r in I.trial_allocation(df, 1).collect()] == ["yes"]
    assert [r.source_record_id for r in I.trial_intervention(df, 1, ("DRUG", "DEVICE")).collect()] == ["n1"]
    assert I.trial_phase(df, 1).first().item_id != I.trial_phase(df, 2).first().item_id


def test_content_hash_equals_its_sql_at_every_length_of_prefix(spark, monkeypatch):
    import duckdb

    from assaykit.plans import base_sql

    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("v"))
    for listed, digits in ((4096, 2), (1, 3), (11, 3), (12, 2)):
        monkeypatch.setattr(checks, "MOST_LISTED", listed)
        monkeypatch.setattr(base_sql, "MOST_LISTED", listed)
        con = duckdb.connect()
        con.sql("CREATE VIEW t AS SELECT i % 3 AS g, CAST(i AS VARCHAR) AS v FROM range(3000) r(i)")
        parts = f"SELECT g, {base_sql.prefix('sha256(v)', 't')} AS p, sha256(string_agg(sha256(v), '' ORDER BY sha256(v))) AS h FROM t GROUP BY ALL"
        assert con.sql(f"SELECT max(len(p)) FROM ({parts})").fetchall() == [(digits,)]
        want = dict(con.sql(f"SELECT g, sha256(string_agg(h, '' ORDER BY p)) FROM ({parts}) GROUP BY g").fetchall())
        assert {r.g: r.sha256 for r in checks.content_hash(df, ["g"], "v").collect()} == want
