"""Nulls, empty arrays, tiny groups and repeated ids: each has a defined result and fails no job."""

import json

from pyspark.sql import functions as F

from assaykit.functions import probs as P
from assaykit.operators import bootstrap, metrics, passages
from assaykit.operators import items as I
from assaykit.operators.checks import split_leaks
from assaykit.sources import loaders, readers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_scores_without_tokens_or_gold(spark):
    df = spark.createDataFrame([([], 0), ([0.5, 0.5], -1), ([0.5, 0.5], 7), ([0.5, 0.5], None), (None, 0), ([1.0, 0.0], 1)], "p array<double>, g int")
    got = df.select(P.min_k("p").alias("m"), P.nll("p", "g").alias("n")).collect()
    assert [r.m for r in got] == [None, 0.5, 0.5, 0.5, None, 0.0]
    assert [r.n is None for r in got] == [True, True, True, True, True, False]


def test_replicates_without_weight_are_left_out(spark):
    df = spark.createDataFrame([("one", "a", 1.0), ("two", "b", 0.0), ("two", "c", 1.0), ("none", "d", None)], "g string, item_id string, v double")
    means = bootstrap.poisson_means(df, "g", "v")
    assert means.filter("g = 'one'").count() == 1000 and 300 < means.filter("g = 'one' and mean is null").count() < 440
    assert rows(bootstrap.interval(means, ["g"])) == [("one", 1.0, 1.0), ("two", 0.0, 1.0)]
    assert bootstrap.poisson_means(df.limit(0), "g", "v").count() == 0
    weights = bootstrap.poisson_means(df.filter("g = 'two'"), "g", "v", n=13)
    assert sorted(r.b for r in weights.collect()) == list(range(13))


def test_summary_is_its_parts(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("t"), (F.col("id") % 3 == 0).alias("ok"), (F.col("id") % 100 / 100).alias("conf"), (F.col("id") % 7 / 7).alias("brier"))
    want = metrics.accuracy(df, ["t"]).join(metrics.mean_of(df, ["t"], "brier"), "t").join(metrics.ece(df, ["t"]).drop("n"), "t")
    assert rows(metrics.summary(df, ["t"])) == rows(want)


def test_labels_without_a_class(spark):
    schema = "set_id string, effective_date date, sections map<string,string>, pharm_class array<string>"
    df = spark.createDataFrame([("a", None, {"x": "t"}, ["c0"]), ("b", None, {"x": "t"}, []), ("c", None, None, None)] + [(f"d{i}", None, {"x": "t"}, [f"c{i}"]) for i in range(9)], schema)
    got = I.label_class(df, 1).collect()
    assert {r.source_record_id for r in got} == {"a", *(f"d{i}" for i in range(9))}
    assert all(len({o.key for o in r.options}) == len(r.options) == 4 and r.gold in {o.key for o in r.options} for r in got)
    few = I.label_class(df.filter("set_id in ('a', 'b')"), 1).collect()
    assert [[o.key for o in r.options] for r in few] == [["c0"]]


def test_ids_in_two_splits_make_one_item_a_row_and_never_train(spark):
    schema = "id string, question string, choices array<string>, answer_idx int, split string"
    df = spark.createDataFrame([("1", "q", ["x", "y"], 0, "train"), ("1", "q", ["x", "y"], 0, "test"), ("2", "q", ["x"], 0, "train"), (None, "q", ["x"], 0, "test"), ("3", "q", ["x"], None, "test"), ("4", "q", None, 0, "train")], schema)
    out = loaders.choice_items(df, "s", "t", 1)
    assert [(r.source_record_id, r.split == "test") for r in out.orderBy("source_record_id").collect()] == [("1", True), ("1", True), ("2", False)]
    assert split_leaks(out).count() == 0


def test_published_records_and_what_is_none(spark, tmp_path):
    study = {
        "protocolSection": {
            "identificationModule": {"nctId": "NCT1", "briefTitle": "T"}, "statusModule": {"studyFirstPostDateStruct": {"date": "2025-02-03"}, "lastUpdatePostDateStruct": {"date": "2025-02"}},
            "descriptionModule": {"briefSummary": "S"}, "conditionsModule": {"conditions": ["c"]}, "designModule": {"phases": ["PHASE2"], "designInfo": {"allocation": "RANDOMIZED", "primaryPurpose": "TREATMENT"}},
            "armsInterventionsModule": {"interventions": [{"type": "DRUG"}, {"type": "DRUG"}]}, "eligibilityModule": {"healthyVolunteers": False, "eligibilityCriteria": "E"},
        },
        "hasResults": False,
    }
    two = json.loads(json.dumps(study))
    two["protocolSection"]["designModule"]["phases"] = ["PHASE1", "PHASE2"]
    two["protocolSection"]["identificationModule"]["nctId"] = "NCT2"
    (tmp_path / "t.jsonl").write_text("\n".join([json.dumps(study), json.dumps(two), "{broken", json.dumps({"protocolSection": {}})]))
    good, bad = readers.scan_trials(spark, str(tmp_path / "t.jsonl"))
    got = {r.nct_id: r for r in good.collect()}
    assert set(got) == {"NCT1", "NCT2"} and bad.count() == 2
    r = got["NCT1"]
    assert (r.phase, r.allocation, str(r.first_posted), r.last_updated, r.intervention_types, r.healthy_volunteers) == ("Phase 2", "RANDOMIZED", "2025-02-03", None, ["DRUG"], False)
    assert got["NCT2"].phase is None and [x.gold for x in I.trial_phase(good, 1).collect()] == ["Phase 2"]
    label = {"set_id": "s1", "effective_time": "20250301", "indications_and_usage": ["for a", "b"], "openfda": {"pharm_class_epc": ["K"], "route": ["ORAL"]}}
    (tmp_path / "l.jsonl").write_text("\n".join([json.dumps(label), json.dumps({"set_id": "s2", "effective_time": "x"}), "nothing"]))
    good, bad = readers.scan_labels(spark, str(tmp_path / "l.jsonl"))
    got = {r.set_id: r for r in good.collect()}
    assert str(got["s1"].effective_date) == "2025-03-01" and got["s1"].sections == {"indications_and_usage": "for a\nb"} and got["s2"].effective_date is None and bad.count() == 1
    assert [r.gold for r in I.label_boxed(good, 1).collect()] == ["no", "no"]
    (tmp_path / "v.jsonl").write_text('{"item_id":"1","verdict":"A"}\n{"item_id"')
    for scan in (readers.read_verdicts, readers.scan_teacher, readers.scan_choices, readers.scan_normalised_trials, readers.scan_normalised_labels):
        good, bad = scan(spark, str(tmp_path / "v.jsonl"))
        assert (good.count(), bad.count()) == (1, 1)


def test_passages_are_found_wherever_they_stand(spark):
    texts = [(1, "xone two three four five six sevenx"), (2, "one two three four five six  seven"), (3, "a b"), (4, None), (5, ""), (6, "two three four"), (6, "two three four")]
    asked = [(1, "one two three four five six seven"), (2, "two"), (3, "wo three fo"), (4, ""), (5, None), (6, "one  two")]
    got = passages.holders(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, passage string"))
    want = [(d, i) for d, t in texts for i, p in asked if t is not None and p is not None and p in t]
    assert rows(got) == sorted(want, key=str) and {(1, 1), (6, 3), (5, 4)} <= set(want)
