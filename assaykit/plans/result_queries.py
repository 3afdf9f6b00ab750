"""Manifests, screens, grids and gates fed by what other operators made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import probs as P
from ..functions.text import or_not_measured
from ..operators import board, bootstrap, calibration, checks, gates, metrics, screen
from ..operators.sampling import half
from ..sources import sinks
from ..sources.adapters import Tables
from ..sources.scratch import scratch_dir
from . import base_sql as S
from .gate_queries import j15_audit_with_raw_fields
from .metric_queries import a31_harness_agreement
from .registry import query

RUN = RunConfig()
GROUP = ["source", "split", "qtype", "template_id"]
#: The rule that the screen tries first.
WORDS = r"\b(idiot|moron|scum)\b"


def screened_texts(t: Tables) -> DataFrame:
    docs = t.read("documents").select(F.col("doc_id").cast("string").alias("source_record_id"), F.col("text").alias("state"))
    return t.items.select("item_id", "template_id", "split", "gold", "source_record_id").join(docs, "source_record_id")


def template_screen(t: Tables) -> DataFrame:
    """template_id, n, regex, bow, dropped: what the keyword rule and the bag of words answer on the test items."""
    rows = screened_texts(t)
    right = (screen.keyword_rule(F.lower("state"), [(WORDS, "yes")], "no") == F.col("gold")).cast("double")
    each = rows.filter("split = 'test'").groupBy("template_id").agg(F.round(F.avg(right), 6).alias("regex"))
    return screen.drop_rule(each.join(screen.bag_of_words(rows), "template_id", "left"), RUN.drop_at)


_TEXTS = "(SELECT i.item_id, i.template_id, i.split, i.gold, d.text FROM items i JOIN documents d ON CAST(d.doc_id AS VARCHAR) = i.source_record_id)"
_RIGHT = f"CASE WHEN (CASE WHEN regexp_matches(lower(text), '{WORDS}') THEN 'yes' ELSE 'no' END) = gold THEN 1e0 ELSE 0e0 END"
_SCREEN = f"""(SELECT template_id, b.n, regex, bow, greatest(regex, coalesce(bow, -1e0)) >= {RUN.drop_at}e0 AS dropped FROM (
  SELECT template_id, round(avg({_RIGHT}), 6) AS regex FROM {_TEXTS} WHERE split = 'test' GROUP BY template_id) LEFT JOIN {S.bag_of_words(_TEXTS)} b USING (template_id))"""


@query(f"SELECT template_id, n, regex, bow, dropped FROM {_SCREEN}", "items")
def g0b_template_screen(t: Tables) -> DataFrame:
    """Dropped if the keyword rule or the bag of words reaches the threshold."""
    return template_screen(t).select("template_id", "n", "regex", "bow", "dropped")


@query(f"SELECT i.item_id, template_id, dropped FROM items i LEFT JOIN {_SCREEN} USING (template_id)", "items")
def j22_screened_items(t: Tables) -> DataFrame:
    """Items beside what the screen said of their template."""
    marks = template_screen(t).select("template_id", "dropped")
    return t.items.join(F.broadcast(marks), "template_id", "left").select("item_id", "template_id", "dropped")  # one row per template


def manifest(t: Tables) -> DataFrame:
    """n and content hash of each group, with the screen's mark."""
    counts = t.items.groupBy(*GROUP).agg(F.count("*").alias("n")).join(checks.content_hash(t.items, GROUP, "item_id"), GROUP)
    return counts.join(F.broadcast(template_screen(t).select("template_id", "dropped")), "template_id", "left").select(*GROUP, "n", "sha256", "dropped")


_HASHED = f"""(SELECT source, split, qtype, template_id, sha256(string_agg(h, '' ORDER BY p)) AS sha256, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT source, split, qtype, template_id, {S.prefix('sha256(item_id)', 'items')} AS p, count(*) AS n, sha256(string_agg(sha256(item_id), '' ORDER BY sha256(item_id))) AS h FROM items GROUP BY ALL) GROUP BY ALL)"""


@query(f"SELECT h.*, dropped FROM {_HASHED} h LEFT JOIN (SELECT template_id, dropped FROM {_SCREEN}) USING (template_id)", "items")
def s19_manifest_hashes(t: Tables) -> DataFrame:
    return manifest(t)


_SAMPLE = """(SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY source ORDER BY turn, template_id, item_id) AS pick FROM (
  SELECT *, row_number() OVER (PARTITION BY source, template_id ORDER BY sha256('7|' || item_id), item_id) AS turn FROM items WHERE split = 'test')) WHERE pick <= {n})"""


@query(
    f"""SELECT part, value, value >= 1e0 AS pass FROM (
    SELECT 'audit' AS part, round(avg(CASE WHEN {S.bucket("'verdict'", 'item_id')} % 10 <> 1 THEN 1e0 ELSE 0e0 END), 6) AS value FROM {_SAMPLE.format(n=RUN.audit_per_source)}
    UNION ALL SELECT 'manifest', CASE WHEN count(*) > 0 THEN 1e0 END FROM items)""",
    "items",
)
def g0d_audit_and_manifest(t: Tables) -> DataFrame:
    """Every sampled item has its verdict, and the manifest as written tells every group's count and hash."""
    audit = j15_audit_with_raw_fields(t).agg(F.lit("audit").alias("part"), F.round(F.avg(F.col("verdict").isNotNull().cast("double")), 6).alias("value"))
    root = scratch_dir(t.spark, "manifest")
    sinks.write_summary(manifest(t).drop("dropped"), root)
    told = t.spark.read.schema("source string, split string, qtype string, template_id string, n long, sha256 string").json(root)
    now = t.items.groupBy(*GROUP).agg(F.count("*").alias("m")).join(checks.content_hash(t.items, GROUP, "item_id").withColumnRenamed("sha256", "h"), GROUP)
    same = F.coalesce((F.col("n") == F.col("m")) & (F.col("sha256") == F.col("h")), F.lit(False)).cast("double")
    whole = now.join(told, GROUP, "full").agg(F.lit("manifest").alias("part"), F.round(F.avg(same), 6).alias("value"))
    return audit.unionByName(whole).select("part", "value", (F.col("value") >= 1.0).alias("pass"))


_SM = "list_transform(logits, lambda z: exp((z - list_max(logits)) / t) / list_sum(list_transform(logits, lambda y: exp((y - list_max(logits)) / t))))"
_HALF = S.bucket("'half'", "item_id")
@query(
    f"""SELECT qtype, n, ece, ece <= {RUN.teacher_ece}e0 AND n >= {RUN.stratified_dev} AS pass,
    CASE WHEN n < {RUN.stratified_dev} THEN 'too few items' WHEN ece > {RUN.teacher_ece}e0 THEN 'teacher is not calibrated' ELSE '' END AS reason FROM (
    SELECT qtype, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(acc - c)) / sum(n), 6) AS ece FROM (
    SELECT qtype, least(14, CAST(floor(list_max(probs) * 15e0) AS INTEGER)) AS bin, count(*) AS n, avg(list_max(probs)) AS c, {S.share('list_position(probs, list_max(probs)) - 1 = gold_index')} AS acc
    FROM (SELECT l.*, {_SM} AS probs FROM logits l JOIN {S.temperatures(f'(SELECT * FROM logits WHERE {_HALF} % 2 = 0)')} b USING (qtype) WHERE {_HALF} % 2 = 1)
    GROUP BY ALL) GROUP BY qtype)""",
    "logits",
)
def g0c_after_temperature(t: Tables) -> DataFrame:
    """Calibration error on one half under the temperature fitted on the other; too few items pass nothing."""
    best = calibration.fit_temperatures(t.logits.filter(half("item_id") == 0), ["qtype"])
    rows = calibration.apply_temperature(t.logits.filter(half("item_id") == 1), best, ["qtype"])
    ece = metrics.ece(rows.withColumn("ok", P.argmax("probs") == F.col("gold_index")).withColumn("conf", F.array_max("probs")), ["qtype"])
    few, off = F.col("n") < RUN.stratified_dev, F.col("ece") > RUN.teacher_ece
    return ece.select("qtype", "n", "ece", (~few & ~off).alias("pass"), F.when(few, "too few items").when(off, "teacher is not calibrated").otherwise("").alias("reason"))


#: What each model is to beat.
AGAINST = (("m-large", "m-mid"), ("m-large", "m-small"), ("m-mid", "m-small"))
_OK = lambda m: f"max(CASE WHEN model = '{m}' THEN CASE WHEN ok THEN 1e0 ELSE 0e0 END END)"
_BRIER = lambda m: f"max(CASE WHEN model = '{m}' THEN brier END)"


def _ok(m: str) -> Column:
    return F.max(F.when(F.col("model") == m, F.col("ok").cast("double")))


def _brier(m: str) -> Column:
    return F.max(F.when(F.col("model") == m, F.col("brier")))


def _differences(t: Tables) -> DataFrame:
    """item_id, pair, v: by how much a model is better than another on an item, in accuracy and in Brier score."""
    wide = [_ok(a) - _ok(b) for a, b in AGAINST] + [_brier(b) - _brier(a) for a, b in AGAINST]
    names = [f"{a}>{b}|{what}" for what in ("accuracy", "brier") for a, b in AGAINST]
    rows = t.scored.filter("split = 'test'").groupBy("item_id").agg(F.array(*[F.struct(F.lit(n).alias("pair"), v.alias("v")) for n, v in zip(names, wide)]).alias("each"))
    return rows.select("item_id", F.inline("each"))


_NAMES = [f"{a}>{b}|{what}" for what in ("accuracy", "brier") for a, b in AGAINST]
_VALUES = [f"{_OK(a)} - {_OK(b)}" for a, b in AGAINST] + [f"{_BRIER(b)} - {_BRIER(a)}" for a, b in AGAINST]
_DIFFERENCES = f"(SELECT item_id, unnest({_NAMES!r}) AS pair, unnest([{', '.join(_VALUES)}]) AS v FROM scored WHERE split = 'test' GROUP BY item_id)"
_BOUNDS = f"(SELECT pair, quantile_cont(mean, 0.025) AS l, quantile_cont(mean, 0.975) AS h FROM {S.poisson_means(_DIFFERENCES, 'pair')} GROUP BY pair)"


def _bounds(rows: DataFrame, by: str) -> DataFrame:
    low, high = F.percentile("mean", F.lit(0.025)), F.percentile("mean", F.lit(0.975))
    return bootstrap.poisson_means(rows, by, "v").groupBy(by).agg(low.alias("l"), high.alias("h"))


@query(f"SELECT pair, round(l, 6) AS low, round(h, 6) AS high, l > 0 AS better FROM {_BOUNDS}", "scored")
def g3_against_every_baseline(t: Tables) -> DataFrame:
    """Each model against each smaller one, in accuracy and Brier score, with intervals."""
    return _bounds(_differences(t), "pair").select("pair", F.round("l", 6).alias("low"), F.round("h", 6).alias("high"), (F.col("l") > 0).alias("better"))


@query(f"SELECT 'G1' AS gate, round(min(l), 6) AS value, 0e0 AS threshold, min(l) > 0 AS pass, CASE WHEN min(l) > 0 THEN '' ELSE 'an interval holds nought' END AS reason FROM {_BOUNDS} WHERE pair LIKE 'm-large>%'", "scored")
def g1_against_both_baselines(t: Tables) -> DataFrame:
    """The student beats both baselines on both scores, by unrounded bounds."""
    least = _bounds(_differences(t).filter(F.col("pair").startswith("m-large>")), "pair").agg(F.min("l").alias("v"))
    return gates.gate(least, "G1", F.col("v"), 0.0, F.col("v") > 0, "an interval holds nought")


_GAIN = f"(SELECT item_id, template_id, {_OK('m-large')} - {_OK('m-mid')} AS v FROM scored WHERE split = 'test' GROUP BY ALL)"


@query(f"SELECT template_id, round(l, 6) AS low, round(h, 6) AS high, l > 0 AS pass FROM (SELECT template_id, quantile_cont(mean, 0.025) AS l, quantile_cont(mean, 0.975) AS h FROM {S.poisson_means(_GAIN, 'template_id')} GROUP BY template_id)", "scored")
def g2_gain_with_interval(t: Tables) -> DataFrame:
    """What the teacher's data adds to gold alone."""
    rows = t.scored.filter("split = 'test'").groupBy("item_id", "template_id").agg((_ok("m-large") - _ok("m-mid")).alias("v"))
    return _bounds(rows, "template_id").select("template_id", F.round("l", 6).alias("low"), F.round("h", 6).alias("high"), (F.col("l") > 0).alias("pass"))


@query(
    f"""SELECT source, round((SELECT avg(v) FROM {_GAIN.replace('template_id,', 'source,')}) - (t.s - g.s) / nullif(t.n - g.n, 0), 6) AS marginal FROM
    (SELECT source, sum(v) AS s, count(*) AS n FROM {_GAIN.replace('template_id,', 'source,')} GROUP BY source) g CROSS JOIN (SELECT sum(v) AS s, count(*) AS n FROM {_GAIN.replace('template_id,', 'source,')}) t""",
    "scored",
)
def g2_ablation_by_source(t: Tables) -> DataFrame:
    """The gain on all sources less that without one; null where there is one source."""
    rows = t.scored.filter("split = 'test'").groupBy("item_id", "source").agg((_ok("m-large") - _ok("m-mid")).alias("v"))
    each = rows.groupBy("source").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    whole = each.agg(F.sum("s").alias("s_all"), F.sum("n").alias("n_all"))  # one row
    marginal = F.col("s_all") / F.col("n_all") - F.try_divide(F.col("s_all") - F.col("s"), F.col("n_all") - F.col("n"))
    return each.crossJoin(F.broadcast(whole)).select("source", F.round(marginal, 6).alias("marginal"))


@query(
    f"""SELECT model, source, CASE WHEN model = 'm-fixed' THEN 'NOT APPLICABLE — fixed schema' ELSE coalesce(CAST(v AS VARCHAR), 'NOT MEASURED — no run') END AS accuracy FROM
    (SELECT DISTINCT source FROM items) CROSS JOIN (SELECT DISTINCT model FROM predictions UNION ALL SELECT 'm-huge' UNION ALL SELECT 'm-fixed') m
    LEFT JOIN (SELECT model, source, CAST(round({S.share('ok')} * 1000) AS BIGINT) AS v FROM scored GROUP BY ALL) USING (model, source)""",
    "scored",
)
def j11_both_markers(t: Tables) -> DataFrame:
    """A cell of a model that can't take our items says so; one without a run says that."""
    more = t.spark.createDataFrame([("m-huge", None), ("m-fixed", "fixed schema")], "model string, unfit string")
    models = t.predictions.select("model").distinct().withColumn("unfit", F.lit(None).cast("string")).unionByName(more)
    grid = t.items.select("source").distinct().crossJoin(F.broadcast(models))  # sources by models: names, not rows
    done = t.scored.groupBy("model", "source").agg(F.round(F.avg(F.col("ok").cast("double")) * 1000).cast("long").alias("v"))
    cell = F.when(F.col("unfit").isNotNull(), F.concat(F.lit("NOT APPLICABLE — "), "unfit")).otherwise(or_not_measured(F.col("v"), "no run"))
    return grid.join(done, ["model", "source"], "left").select("model", "source", cell.alias("accuracy"))


def _artifacts(t: Tables) -> DataFrame:
    """artifact: the folders of results that were written, a model each."""
    root = scratch_dir(t.spark, "results")
    rows = t.scored.filter("model <> 'm-small'").groupBy("model", "source").agg(F.avg("brier").alias("brier"))
    rows.withColumn("artifact", F.concat("model", F.lit(".json"))).write.mode("overwrite").partitionBy("artifact").json(root)
    return t.spark.read.json(root).select("artifact").distinct()


@query("SELECT DISTINCT 'accuracy of ' || model AS claim, model || '.json' AS artifact FROM predictions WHERE model = 'm-small'", "predictions")
def j21_missing_artifacts(t: Tables) -> DataFrame:
    """A claim for each model; one model's results were never written."""
    ledger = t.predictions.select(F.concat(F.lit("accuracy of "), "model").alias("claim"), F.concat("model", F.lit(".json")).alias("artifact")).distinct()
    return board.orphan_claims(ledger, _artifacts(t)).select("claim", "artifact")


_ONE = "(SELECT template_id, model, item_id, CASE WHEN ok THEN 1e0 ELSE 0e0 END AS v FROM scored WHERE split = 'test')"
_CLAIMS = "(SELECT template_id || '|' || model AS claim, v FROM " + _ONE + ")"
#: The widest interval that a claim may stand on.
WIDEST = 0.1
_AGREES = "(SELECT template_id, abs(avg(CASE WHEN model = 'm-mid' THEN CASE WHEN ok THEN 1e0 ELSE 0e0 END END) - avg(CASE WHEN model = 'm-small' THEN CASE WHEN ok THEN 1e0 ELSE 0e0 END END)) * 100 <= 2 AS robust FROM scored GROUP BY template_id)"


@query(
    f"""SELECT i.template_id, m.model, m.model <> 'm-small' AS artifact, h - l <= {WIDEST}e0 AS interval, robust, m.model <> 'm-small' AND h - l <= {WIDEST}e0 AND robust AS ready
    FROM (SELECT DISTINCT template_id FROM {_ONE}) i CROSS JOIN (SELECT DISTINCT model FROM {_ONE}) m JOIN {_AGREES} USING (template_id)
    JOIN (SELECT claim, quantile_cont(mean, 0.025) AS l, quantile_cont(mean, 0.975) AS h FROM {S.exact_means(_CLAIMS, 'claim')} GROUP BY claim) b ON b.claim = i.template_id || '|' || m.model""",
    "scored",
)
def g4_claims_from_results(t: Tables) -> DataFrame:
    """A claim of a model on a template stands on a written artifact, an interval and two runs that agree."""
    rows = t.scored.filter("split = 'test'").withColumn("claim", F.concat_ws("|", "template_id", "model")).withColumn("v", F.col("ok").cast("double"))
    names = rows.select("claim", "template_id", "model", F.concat("model", F.lit(".json")).alias("artifact")).distinct()
    there = _artifacts(t).withColumn("exists", F.lit(True))
    # An interval supports a claim if it is narrow enough to tell results apart.
    means = bootstrap.exact_means(rows, "claim", "v").groupBy("claim").agg(F.percentile("mean", F.lit(0.025)).alias("l"), F.percentile("mean", F.lit(0.975)).alias("h"))
    interval = means.select("claim", (F.col("h") - F.col("l") <= WIDEST).alias("interval"))
    out = names.join(F.broadcast(there), "artifact", "left").join(interval, "claim", "left").join(a31_harness_agreement(t).select("template_id", F.col("agrees").alias("robust")), "template_id", "left")
    marks = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("interval", "robust")} | {"artifact": F.coalesce("exists", F.lit(False))}
    return out.withColumns(marks).select("template_id", "model", "artifact", "interval", "robust", (F.col("artifact") & F.col("interval") & F.col("robust")).alias("ready"))
