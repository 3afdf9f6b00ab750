"""Metrics, intervals, calibration and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import probs as P
from ..functions.hashing import bucket, unit
from ..functions.text import or_not_measured
from ..operators import bootstrap, calibration, metrics, near
from ..operators.sampling import half
from ..sources.adapters import Tables
from ..sources.scratch import keeper
from . import base_sql as S
from .registry import query


@query(f"SELECT model, template_id, count(*) AS n, round({S.share('ok')}, 6) AS accuracy FROM scored GROUP BY ALL", "scored")
def a01_accuracy_micro(t: Tables) -> DataFrame:
    return metrics.accuracy(t.scored, ["model", "template_id"])


@query(
    f"SELECT model, count(*) AS templates, round(avg(a), 6) AS macro_accuracy FROM (SELECT model, template_id, {S.share('ok')} AS a FROM scored GROUP BY ALL) GROUP BY model", "scored"
)
def a02_accuracy_macro(t: Tables) -> DataFrame:
    return metrics.macro_accuracy(t.scored, ["model"])


@query(
    """SELECT template_id, CAST(sum(n) AS BIGINT) AS n, round(CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS majority
    FROM (SELECT template_id, gold, count(*) AS n FROM items GROUP BY ALL) GROUP BY template_id""",
    "items",
)
def a03_majority(t: Tables) -> DataFrame:
    return metrics.majority(t.items, ["template_id"])


@query("SELECT grp, round(avg(brier), 6) AS brier FROM logit_scored GROUP BY grp", "logit_scored")
def a04_brier(t: Tables) -> DataFrame:
    return metrics.mean_of(t.logit_scored, ["grp"], "brier")


_BINS = f"SELECT model, least(14, CAST(floor(conf * 15e0) AS INTEGER)) AS bin, count(*) AS n, avg(conf) AS confidence, {S.share('ok')} AS accuracy FROM scored GROUP BY ALL"


@query(f"SELECT model, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece FROM ({_BINS}) GROUP BY model", "scored")
def a05_ece(t: Tables) -> DataFrame:
    return metrics.ece(t.scored, ["model"])


@query(
    """SELECT model, round(min(label_mass), 6) AS low, round(avg(label_mass), 6) AS mean, round(quantile_cont(label_mass, 0.05), 6) AS p05,
    round(quantile_cont(label_mass, 0.5), 6) AS p50 FROM predictions GROUP BY model""",
    "predictions",
)
def a06_label_mass(t: Tables) -> DataFrame:
    m = F.col("label_mass")
    ends = t.predictions.groupBy("model").agg(F.round(F.min(m), 6).alias("low"), F.round(F.avg(m), 6).alias("mean"))
    return ends.join(metrics.quantiles(t.predictions, ["model"], "label_mass", {"p05": 0.05, "p50": 0.5}), "model")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def a07_latency(t: Tables) -> DataFrame:
    return metrics.quantiles(t.read("events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


_ONE = "(SELECT template_id, source, item_id, CASE WHEN ok THEN 1e0 ELSE 0e0 END AS v FROM scored WHERE model = 'm-mid')"
_INTERVAL = "round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high"


@query(f"SELECT template_id, {_INTERVAL} FROM {S.exact_means(_ONE, 'template_id')} GROUP BY template_id", "scored")
def a08_bootstrap_interval(t: Tables) -> DataFrame:
    """Resamples of exactly the group's size."""
    rows = t.scored.filter("model = 'm-mid'")
    return bootstrap.interval(bootstrap.exact_means(rows, "template_id", "ok"), ["template_id"])


_BRIERS = "(SELECT template_id, brier AS v FROM scored WHERE model = 'm-large')"


@query(f"SELECT template_id, {_INTERVAL} FROM {S.exact_means(_BRIERS, 'template_id')} GROUP BY template_id", "scored")
def a08_bootstrap_brier(t: Tables) -> DataFrame:
    """The same of a score whose values hardly repeat."""
    return bootstrap.interval(bootstrap.exact_means(t.scored.filter("model = 'm-large'"), "template_id", "brier"), ["template_id"])


@query(f"SELECT source, {_INTERVAL} FROM {S.poisson_means(_ONE, 'source')} GROUP BY source", "scored")
def a08_bootstrap_poisson(t: Tables) -> DataFrame:
    """The same by source, where groups are small."""
    rows = t.scored.filter("model = 'm-mid'")
    return bootstrap.interval(bootstrap.poisson_means(rows, "source", "ok"), ["source"])


@query(
    """SELECT source, split, qtype, template_id, count(*) AS n, CAST(grouping(source) * 8 + grouping(split) * 4 + grouping(qtype) * 2 + grouping(template_id) AS BIGINT) AS level
    FROM items GROUP BY GROUPING SETS ((source, split, qtype, template_id), (source), ())""",
    "items",
)
def a12_manifest_counts(t: Tables) -> DataFrame:
    c = [F.col(x) for x in ("source", "split", "qtype", "template_id")]
    return t.items.groupingSets([c, c[:1], []], *c).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query(
    f"""SELECT source, sha256(string_agg(h, '' ORDER BY p)) AS sha256 FROM (
    SELECT source, {S.prefix('sha256(item_id)', 'items')} AS p, sha256(string_agg(sha256(item_id), '' ORDER BY sha256(item_id))) AS h FROM items GROUP BY ALL) GROUP BY source""",
    "items",
)
def a13_content_hash(t: Tables) -> DataFrame:
    from ..operators.checks import content_hash

    return content_hash(t.items, ["source"], "item_id")


@query("SELECT source, source_record_id, count(DISTINCT split) AS splits FROM items GROUP BY ALL HAVING count(DISTINCT split) > 1", "items")
def a14_split_leaks(t: Tables) -> DataFrame:
    from ..operators.checks import split_leaks

    return split_leaks(t.items)


@query(
    f"SELECT model, template_id, count(*) AS n, CAST(sum(CASE WHEN supported THEN 1 ELSE 0 END) AS BIGINT) AS supported, round({S.share('supported')}, 6) AS coverage FROM scored GROUP BY ALL", "scored"
)
def a15_coverage_supported(t: Tables) -> DataFrame:
    s = F.col("supported").cast("int")
    return t.scored.groupBy("model", "template_id").agg(F.count("*").alias("n"), F.sum(s).cast("long").alias("supported"), F.round(F.avg(s.cast("double")), 6).alias("coverage"))


_MINK = "(SELECT vec_id, list_sort(list_transform(embedding, lambda x: -abs(CAST(x AS DOUBLE)))) AS lp FROM embeddings)"


@query(f"SELECT vec_id, round(list_sum(lp[1:13]) / 13, 6) AS score FROM {_MINK}")
def a16_min_k(t: Tables) -> DataFrame:
    lp = F.transform("embedding", lambda x: -F.abs(x.cast("double")))
    return t.read("embeddings").select("vec_id", F.round(P.min_k(lp), 6).alias("score"))


@query(
    """SELECT label, round(avg(a) - avg(b), 6) AS gap FROM (
    SELECT label, list_sum(list_sort(list_transform(embedding[1:32], lambda x: -abs(CAST(x AS DOUBLE))))[1:7]) / 7 AS a,
           list_sum(list_sort(list_transform(embedding[33:64], lambda x: -abs(CAST(x AS DOUBLE))))[1:7]) / 7 AS b FROM embeddings) GROUP BY label"""
)
def a17_contamination_gap(t: Tables) -> DataFrame:
    """Item tokens against those of its control, matched by item."""
    half_ = lambda a: P.min_k(F.transform(F.slice("embedding", a, 32), lambda x: -F.abs(x.cast("double"))))
    items = t.read("embeddings").select("vec_id", "label", half_(1).alias("a"))
    controls = t.read("embeddings").select("vec_id", half_(33).alias("b"))
    return items.join(controls, "vec_id").groupBy("label").agg(F.round(F.avg("a") - F.avg("b"), 6).alias("gap"))


_SM = "list_transform(logits, lambda z: exp((z - list_max(logits)) / t) / list_sum(list_transform(logits, lambda y: exp((y - list_max(logits)) / t))))"
_HALF = S.bucket("'half'", "item_id")
_FITTED = S.temperatures(f"(SELECT * FROM logits WHERE {_HALF} % 2 = 0)")


@query(
    f"SELECT qtype, round(t, 5) AS t, round(avg(-ln(greatest({_SM}[gold_index + 1], 1e-12))), 6) AS loss FROM logits JOIN {_FITTED} b USING (qtype) WHERE {_HALF} % 2 = 0 GROUP BY ALL", "logits"
)
def a21_temperature(t: Tables) -> DataFrame:
    """The temperature of least loss of each question type, and that loss."""
    best = calibration.fit_temperatures(t.logits.filter(half("item_id") == 0), ["qtype"])
    return best.select("qtype", F.round("t", 5).alias("t"), F.round("loss", 6).alias("loss"))


@query(
    f"""SELECT qtype, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(acc - c)) / sum(n), 6) AS ece FROM (
    SELECT qtype, least(14, CAST(floor(list_max(probs) * 15e0) AS INTEGER)) AS bin, count(*) AS n, avg(list_max(probs)) AS c,
           {S.share('list_position(probs, list_max(probs)) - 1 = gold_index')} AS acc
    FROM (SELECT l.*, {_SM} AS probs FROM logits l JOIN {_FITTED} b USING (qtype) WHERE {_HALF} % 2 = 1)
    GROUP BY ALL) GROUP BY qtype""",
    "logits",
)
def a21_ece_after_temperature(t: Tables) -> DataFrame:
    best = calibration.fit_temperatures(t.logits.filter(half("item_id") == 0), ["qtype"])
    rows = calibration.apply_temperature(t.logits.filter(half("item_id") == 1), best, ["qtype"])
    rows = rows.withColumn("ok", P.argmax("probs") == F.col("gold_index")).withColumn("conf", F.array_max("probs"))
    return metrics.ece(rows, ["qtype"])


@query(
    """SELECT template_id, round(avg(CASE WHEN k = 0 THEN 1e0 ELSE 0e0 END), 6) AS missing_rate FROM (
    SELECT template_id, CAST('0x' || substr(sha256('topk|' || item_id), 1, 8) AS BIGINT) % 4 AS k FROM items) GROUP BY template_id""",
    "items",
)
def a22_missing_options(t: Tables) -> DataFrame:
    """How often the top-k map lacks an option."""
    topk = F.when(bucket(F.lit("topk"), "item_id") % 4 == 0, F.create_map(F.lit("A"), F.lit(0.6))).otherwise(F.create_map(F.lit("A"), F.lit(0.6), F.lit("B"), F.lit(0.3)))
    missing = F.filter(F.array(F.lit("A"), F.lit("B")), lambda k: ~F.map_contains_key("topk", k))
    return t.items.withColumn("topk", topk).groupBy("template_id").agg(F.round(F.avg((F.size(missing) > 0).cast("double")), 6).alias("missing_rate"))


@query(
    """SELECT event_type, count(*) AS n, round(count(*) / sum(value) * 3600, 4) AS items_per_hour, round(avg(value), 6) AS seconds_per_item FROM events GROUP BY event_type"""
)
def a23_throughput(t: Tables) -> DataFrame:
    return t.read("events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.count("*") / F.sum("value") * 3600, 4).alias("items_per_hour"), F.round(F.avg("value"), 6).alias("seconds_per_item")
    )


@query("SELECT CAST(max(coalesce(cutoff, created)) AS VARCHAR) AS start FROM (SELECT CASE WHEN s_suppkey % 3 <> 0 THEN CAST(DATE '2024-01-01' + CAST(s_suppkey % 200 AS INTEGER) AS DATE) END AS cutoff, CAST(DATE '2024-03-01' + CAST(s_suppkey % 100 AS INTEGER) AS DATE) AS created FROM supplier)")
def a24_window_start(t: Tables) -> DataFrame:
    """Documented cutoffs where known, creation dates elsewhere; the latest counts."""
    k = F.col("s_suppkey")
    day = lambda d, n: F.date_add(F.lit(d).cast("date"), n.cast("int"))
    rows = t.read("supplier").select(F.when(k % 3 != 0, day("2024-01-01", k % 200)).alias("cutoff"), day("2024-03-01", k % 100).alias("created"))
    return rows.agg(F.max(F.coalesce("cutoff", "created")).cast("string").alias("start"))


@query("SELECT o_custkey, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_seen FROM orders GROUP BY o_custkey")
def a25_first_seen(t: Tables) -> DataFrame:
    return t.read("orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).cast("string").alias("first_seen"))


@query("SELECT template_id, split, count(*) AS n, count(*) >= 500 AS on_target FROM items GROUP BY ALL", "items")
def a26_template_targets(t: Tables) -> DataFrame:
    return t.items.groupBy("template_id", "split").agg(F.count("*").alias("n"), (F.count("*") >= 500).alias("on_target"))


@query("SELECT item_id, round(list_sum(list_transform(probs, lambda p, i: p * (i - 1))), 6) AS expected_level FROM logit_scored WHERE qtype = 'score'", "logit_scored")
def a27_expected_level(t: Tables) -> DataFrame:
    return t.logit_scored.filter("qtype = 'score'").select("item_id", F.round(P.expected_level("probs"), 6).alias("expected_level"))


@query(f"SELECT model, bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM ({_BINS})", "scored")
def a28_reliability(t: Tables) -> DataFrame:
    return metrics.reliability(t.scored, ["model"]).withColumns({c: F.round(c, 6) for c in ("confidence", "accuracy")})


@query(
    f"""SELECT model, source, round(max(whole) - max(part), 6) AS marginal FROM (
    SELECT s.model, x.source, avg(CASE WHEN s.ok THEN 1e0 ELSE 0e0 END) AS whole, avg(CASE WHEN s.source <> x.source THEN CASE WHEN s.ok THEN 1e0 ELSE 0e0 END END) AS part
    FROM scored s CROSS JOIN (SELECT DISTINCT source FROM items) x GROUP BY ALL) GROUP BY ALL""",
    "scored",
)
def a29_source_ablation(t: Tables) -> DataFrame:
    """Accuracy on all sources less that without one, from sums by source; null for a model that has one source."""
    each = t.scored.groupBy("model", "source").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("double")).alias("s"))
    whole = each.groupBy("model").agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"))
    out = each.join(whole, "model")
    return out.select("model", "source", F.round(F.col("s_all") / F.col("n_all") - F.try_divide(F.col("s_all") - F.col("s"), F.col("n_all") - F.col("n")), 6).alias("marginal"))


_SIDE = lambda m: f"max(CASE WHEN model = '{m}' THEN CASE WHEN ok THEN 1e0 ELSE 0e0 END END)"
_PAIR = f"(SELECT item_id, template_id, {_SIDE('m-large')} - {_SIDE('m-small')} AS v FROM scored GROUP BY ALL)"


@query(f"SELECT template_id, {_INTERVAL}, quantile_cont(mean, 0.025) > 0 AS better FROM {S.exact_means(_PAIR, 'template_id')} GROUP BY template_id", "scored")
def a30_paired_difference(t: Tables) -> DataFrame:
    """An item that one of the two models did not answer is no pair."""
    ok = lambda m: F.max(F.when(F.col("model") == m, F.col("ok").cast("double")))
    rows = t.scored.groupBy("item_id", "template_id").agg((ok("m-large") - ok("m-small")).alias("v"))
    means = bootstrap.exact_means(rows, "template_id", "v")
    low, high = F.percentile("mean", F.lit(0.025)), F.percentile("mean", F.lit(0.975))
    return means.groupBy("template_id").agg(F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), (low > 0).alias("better"))


@query(
    f"""SELECT template_id, round(abs(a - b) * 100, 6) AS points, abs(a - b) * 100 <= 2 AS agrees FROM (
    SELECT template_id, avg(CASE WHEN model = 'm-mid' THEN CASE WHEN ok THEN 1e0 ELSE 0e0 END END) AS a, avg(CASE WHEN model = 'm-small' THEN CASE WHEN ok THEN 1e0 ELSE 0e0 END END) AS b
    FROM scored GROUP BY template_id)""",
    "scored",
)
def a31_harness_agreement(t: Tables) -> DataFrame:
    each = t.scored.groupBy("template_id", "model").agg(F.avg(F.col("ok").cast("double")).alias("a"))
    ours, theirs = each.filter("model = 'm-mid'").drop("model"), each.filter("model = 'm-small'").select("template_id", F.col("a").alias("b"))
    points = F.abs(F.col("a") - F.col("b")) * 100
    return ours.join(theirs, "template_id").select("template_id", F.round(points, 6).alias("points"), (points <= 2).alias("agrees"))


_RUN = f"""(SELECT item_id, template_id, gold_index, p, CASE WHEN {S.bucket("'again'", 'item_id')} % 9 = 0 THEN greatest(0e0, p - 0.2e0 * {S.unit("'drift'", 'item_id')}) ELSE p END AS q FROM scored WHERE model = 'm-mid')"""


@query(
    f"""SELECT template_id, count(*) AS n, round(max(abs(p - q)), 6) AS worst, round(avg(abs(p - q)), 6) AS mean,
    round(avg(CASE WHEN (CASE WHEN gold_index = 0 THEN p >= 1e0 - p ELSE p > 1e0 - p END) <> (CASE WHEN gold_index = 0 THEN q >= 1e0 - q ELSE q > 1e0 - q END) THEN 1e0 ELSE 0e0 END), 6) AS changed
    FROM {_RUN} GROUP BY template_id""",
    "scored",
)
def a33_run_drift(t: Tables) -> DataFrame:
    """Two runs of one model: the second, as written to files and read again, drifts on some items."""
    gold = F.element_at("probs", F.col("gold_index") + 1)
    first = t.scored.filter("model = 'm-mid'").select("item_id", "template_id", "gold_index", gold.alias("p"))
    drift = F.when(bucket(F.lit("again"), "item_id") % 9 == 0, F.greatest(F.lit(0.0), F.col("p") - 0.2 * unit(F.lit("drift"), "item_id"))).otherwise(F.col("p"))
    second = keeper(t.spark, "second-run")(first.select("item_id", drift.alias("q")))
    both = first.join(second, "item_id")
    said = lambda c: F.when(F.col("gold_index") == 0, F.col(c) >= 1.0 - F.col(c)).otherwise(F.col(c) > 1.0 - F.col(c))
    gap = F.abs(F.col("p") - F.col("q"))
    return both.groupBy("template_id").agg(F.count("*").alias("n"), F.round(F.max(gap), 6).alias("worst"), F.round(F.avg(gap), 6).alias("mean"), F.round(F.avg((said("p") != said("q")).cast("double")), 6).alias("changed"))


_VOCABULARY = "(SELECT DISTINCT unnest([p_brand, p_type, p_name]) AS w, unnest(['p_brand', 'p_type', 'p_name']) AS kind FROM part)"


@query(f"SELECT a.kind, a.w AS a, b.w AS b FROM {_VOCABULARY} a JOIN {_VOCABULARY} b ON a.kind = b.kind AND a.w < b.w AND abs(len(a.w) - len(b.w)) <= 1 WHERE levenshtein(a.w, b.w) <= 1")
def a34_near_duplicate_options(t: Tables) -> DataFrame:
    """Pairs of options one edit apart, in each vocabulary of the parts."""
    each = [near.near_pairs(t.read("part"), c).select(F.lit(c).alias("kind"), "a", "b") for c in ("p_brand", "p_type", "p_name")]
    return each[0].unionByName(each[1]).unionByName(each[2])


_DEV = "(SELECT conf, ok, item_id FROM scored WHERE split = 'dev' AND template_id = 'quality' AND model = 'm-mid')"
_CUTS = f"""(SELECT conf AS t, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (ORDER BY conf ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + coalesce(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (ORDER BY conf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM {_DEV} UNION ALL SELECT CAST('Infinity' AS DOUBLE), count(*) FILTER (NOT ok) FROM {_DEV})"""


@query(
    f"""SELECT template_id, round(any_value(b.t), 9) AS threshold, round(avg(CASE WHEN (conf >= b.t) = ok THEN 1e0 ELSE 0e0 END), 6) AS transferred
    FROM scored CROSS JOIN (SELECT t FROM {_CUTS} ORDER BY a DESC, t LIMIT 1) b WHERE split = 'test' AND model = 'm-mid' GROUP BY template_id""",
    "scored",
)
def a35_threshold_transfer(t: Tables) -> DataFrame:
    """The confidence threshold that is best on one template's dev items, of all that there are, applied to the test items of all."""
    one = t.scored.filter("model = 'm-mid'")
    best = calibration.best_threshold(one.filter("split = 'dev' and template_id = 'quality'"), [])
    right = ((F.col("conf") >= F.col("t")) == F.col("ok")).cast("double")
    # One row: the best of all cut points.
    return one.filter("split = 'test'").crossJoin(F.broadcast(best.select("t"))).groupBy("template_id").agg(F.round(F.first("t"), 9).alias("threshold"), F.round(F.avg(right), 6).alias("transferred"))


@query(
    """SELECT template_id, round(avg(p * ln(greatest(p, 1e-9) / greatest(q, 1e-9)) + (1 - p) * ln(greatest(1 - p, 1e-9) / greatest(1 - q, 1e-9))), 6) AS kl FROM (
    SELECT a.template_id, a.p AS p, b.p AS q FROM scored a JOIN scored b USING (item_id, template_id) WHERE a.model = 'm-large' AND b.model = 'm-small') GROUP BY template_id""",
    "scored",
)
def a36_kl_to_teacher(t: Tables) -> DataFrame:
    teacher = t.scored.filter("model = 'm-large'").select("item_id", "template_id", F.col("probs").alias("teacher"))
    student = t.scored.filter("model = 'm-small'").select("item_id", "template_id", F.col("probs").alias("student"))
    return teacher.join(student, ["item_id", "template_id"]).groupBy("template_id").agg(F.round(F.avg(P.kl("teacher", "student")), 6).alias("kl"))


@query(f"SELECT model, round({S.share('label_mass >= 0.9e0 AND NOT ok')}, 6) AS confidently_wrong FROM scored GROUP BY model", "scored")
def a37_confidently_wrong(t: Tables) -> DataFrame:
    wrong = (F.col("label_mass") >= 0.9) & ~F.col("ok")
    return t.scored.groupBy("model").agg(F.round(F.avg(wrong.cast("double")), 6).alias("confidently_wrong"))


@query(
    f"SELECT model, template_id, round(avg(label_mass), 6) AS mass, round({S.share('ok')}, 6) AS accuracy, avg(label_mass) < 0.8e0 OR {S.share('ok')} < 0.5e0 AS alarm FROM scored GROUP BY ALL", "scored"
)
def a38_readout_alarm(t: Tables) -> DataFrame:
    """Readable mass, and accuracy against chance among the options."""
    mass, acc, chance = F.avg("label_mass"), F.avg(F.col("ok").cast("double")), F.avg(F.try_divide(F.lit(1.0), F.size("probs")))
    return t.scored.groupBy("model", "template_id").agg(F.round(mass, 6).alias("mass"), F.round(acc, 6).alias("accuracy"), ((mass < 0.8) | (acc < chance)).alias("alarm"))


@query("SELECT item_id, model, split, gold, ok FROM scored WHERE supported", "scored")
def j01_items_with_predictions(t: Tables) -> DataFrame:
    return t.scored.filter("supported").select("item_id", "model", "split", "gold", "ok")


_PRED = "(SELECT item_id FROM predictions WHERE model = 'm-mid' AND supported)"


@query(f"SELECT item_id, template_id FROM items WHERE item_id NOT IN (SELECT item_id FROM {_PRED})", "predictions")
def j02_unpredicted(t: Tables) -> DataFrame:
    from ..operators.checks import unpredicted

    return unpredicted(t.items, t.predictions.filter("model = 'm-mid' and supported")).select("item_id", "template_id")


@query(f"SELECT item_id FROM {_PRED} WHERE item_id NOT IN (SELECT item_id FROM items WHERE split = 'test')", "predictions")
def j03_unknown_predictions(t: Tables) -> DataFrame:
    from ..operators.checks import unknown_predictions

    return unknown_predictions(t.items.filter("split = 'test'"), t.predictions.filter("model = 'm-mid' and supported")).select("item_id")


@query(
    f"""SELECT source, count(*) AS n, count(p.item_id) AS predicted, round(CAST(count(p.item_id) AS DOUBLE) / count(*), 6) AS coverage
    FROM items i LEFT JOIN {_PRED} p USING (item_id) GROUP BY source""",
    "predictions",
)
def j04_coverage(t: Tables) -> DataFrame:
    return metrics.coverage(t.items, t.predictions.filter("model = 'm-mid' and supported"), ["source"])


@query(
    f"""SELECT model, source, coalesce(CAST(v AS VARCHAR), 'NOT MEASURED — no run') AS accuracy FROM
    (SELECT DISTINCT source FROM items) CROSS JOIN (SELECT DISTINCT model FROM predictions UNION ALL SELECT 'm-huge') m
    LEFT JOIN (SELECT model, source, CAST(round({S.share('ok')} * 1000) AS BIGINT) AS v FROM scored GROUP BY ALL) USING (model, source)""",
    "scored",
)
def j11_results_grid(t: Tables) -> DataFrame:
    """Accuracy in tenths of a per cent; no cell is empty."""
    models = t.predictions.select("model").distinct().unionByName(t.spark.createDataFrame([("m-huge",)], "model string"))
    grid = t.items.select("source").distinct().crossJoin(F.broadcast(models))  # sources by models: names, not rows
    done = t.scored.groupBy("model", "source").agg(F.round(F.avg(F.col("ok").cast("double")) * 1000).cast("long").alias("v"))
    return grid.join(done, ["model", "source"], "left").select("model", "source", or_not_measured(F.col("v"), "no run").alias("accuracy"))


@query(
    f"""SELECT count(*) AS n, round(avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END), 6) AS teacher FROM scored s WHERE model = 'm-large'
    AND item_id IN (SELECT item_id FROM scored WHERE model = (SELECT max_by(model, (a, model)) FROM (SELECT model, {S.share('ok')} AS a FROM scored WHERE model <> 'm-large' GROUP BY model)) AND supported)""",
    "scored",
)
def j12_teacher_on_same_items(t: Tables) -> DataFrame:
    """The teacher's accuracy on the items that the best baseline answered."""
    rest = t.scored.filter("model <> 'm-large'")
    best = rest.groupBy("model").agg(F.avg(F.col("ok").cast("double")).alias("a")).agg(F.max_by("model", F.struct("a", "model")).alias("model"))
    same = rest.filter("supported").join(F.broadcast(best), "model", "left_semi").select("item_id")
    return t.scored.filter("model = 'm-large'").join(same, "item_id", "left_semi").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("teacher"))


@query("SELECT item_id, round(ln(list_sum(list_transform(logits, lambda z: exp(z)))), 6) AS lse, round(exp(ln(list_sum(list_transform(logits, lambda z: exp(z)))) - 5e0), 6) AS mass FROM logits", "logits")
def x03_label_mass(t: Tables) -> DataFrame:
    rows = t.logits.withColumn("vocab", F.lit(5.0))
    return rows.select("item_id", F.round(P.log_sum_exp("logits"), 6).alias("lse"), F.round(P.label_mass("logits", "vocab"), 6).alias("mass"))


@query(
    """SELECT item_id, round(probs[1], 6) AS p0, round(conf, 6) AS top, CAST(list_position(probs, conf) - 1 AS INTEGER) AS pred, round(nll, 6) AS nll FROM logit_scored""", "logit_scored"
)
def x02_softmax(t: Tables) -> DataFrame:
    return t.logit_scored.select("item_id", F.round(F.element_at("probs", 1), 6).alias("p0"), F.round("conf", 6).alias("top"), P.argmax("probs").alias("pred"), F.round("nll", 6).alias("nll"))


@query(
    f"""SELECT item_id, round(a, 6) AS a, round(greatest(1e0 - a, 0e0) / 3, 6) AS b FROM (SELECT item_id, {S.unit("'top'", 'item_id')} AS a FROM items)""", "items"
)
def x05_residual_fill(t: Tables) -> DataFrame:
    rows = t.items.withColumn("topk", F.create_map(F.lit("A"), unit(F.lit("top"), "item_id")))
    keys = F.array(*[F.lit(k) for k in "ABCD"])
    filled = P.residual_fill(keys, "topk")
    return rows.select("item_id", F.round(F.element_at(filled, 1), 6).alias("a"), F.round(F.element_at(filled, 2), 6).alias("b"))
