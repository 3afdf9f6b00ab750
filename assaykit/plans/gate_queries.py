"""Gates, screens, the board, the ledger, audits and the headline (G, A18 to A20, A32, J15 to J17, W12, W13, S19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig, load_config
from ..operators import board, bootstrap, checks, gates, metrics, sampling, screen
from ..operators.checks import unpredicted
from ..sources import markdown
from ..sources.adapters import SEED, Tables
from ..sources.scratch import keeper, scratch_dir
from . import base_sql as S
from .registry import query

RUN = RunConfig()
@query(
    f"""SELECT s.template_id, count(*) AS n, round({S.share('ok')}, 6) AS accuracy, round(any_value(m.majority), 6) AS majority, round(avg(brier), 6) AS brier, any_value(e.ece) AS ece
    FROM scored s JOIN (SELECT template_id, CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS majority FROM (SELECT template_id, gold, count(*) AS n FROM items WHERE split = 'test' GROUP BY ALL) GROUP BY template_id) m USING (template_id)
    JOIN (SELECT template_id, round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM (SELECT template_id, least(14, CAST(floor(conf * 15e0) AS INTEGER)) AS bin, count(*) AS n, avg(conf) AS c, {S.share('ok')} AS a
      FROM scored WHERE split = 'test' AND model = 'm-mid' GROUP BY ALL) GROUP BY template_id) e USING (template_id)
    WHERE split = 'test' AND model = 'm-mid' GROUP BY s.template_id""",
    "scored",
)
def headline(t: Tables) -> DataFrame:
    """On the fresh test split, per template: n, accuracy, majority baseline, Brier, ECE."""
    rows, by = t.scored.filter("split = 'test' and model = 'm-mid'"), ["template_id"]
    return metrics.summary(rows, by).join(metrics.majority(t.items.filter("split = 'test'"), by).drop("n"), by)


def board_tables(t: Tables) -> DataFrame:
    """Boards of orders, written as Markdown and read again: an order is a task, 32 keys a board; some name tasks that their board lacks, or each other."""
    k, other = F.col("o_orderkey"), F.col("o_custkey")
    task = lambda n: F.concat(F.lit("T"), n.cast("string"))
    deps = F.when(k % 61 == 0, "all").when(k % 8 == 1, "—").when(k % 97 == 0, task(k + 1)).otherwise(F.concat_ws(", ", task(k - 1 - other % 3), task(k - 2)))
    status = F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("BLOCKED — waits for parts")
    line = F.concat(F.lit("| "), task(k), F.lit(" | order \\| "), other.cast("string"), F.lit(" | "), deps, F.lit(" | "), status, F.lit(" |"))
    boards = t.read("orders").groupBy(F.floor(k / 32).alias("b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), line.alias("line")))), lambda r: r["line"]), "\n").alias("rows"))
    text = F.concat(F.lit("## Board "), F.col("b").cast("string"), F.lit("\n\n| id | task | deps | status |\n|---|---|---|---|\n"), "rows", F.lit("\n\nRules: take the first.\n"))
    root = scratch_dir(t.spark, "boards")
    boards.select(text.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1000).text(root)
    return markdown.read_tables(t.spark, root)


def boards(t: Tables) -> DataFrame:
    return board.parse_board(board_tables(t))


_BOARD = """(SELECT 'Board ' || (o_orderkey // 32) AS board, row_number() OVER (PARTITION BY o_orderkey // 32 ORDER BY o_orderkey) AS pos, 'T' || o_orderkey AS id,
  CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'PENDING' ELSE 'BLOCKED' END AS status, o_orderkey % 61 = 0 AS every,
  CASE WHEN o_orderkey % 61 = 0 OR o_orderkey % 8 = 1 THEN [] WHEN o_orderkey % 97 = 0 THEN ['T' || (o_orderkey + 1)]
       ELSE list_distinct(['T' || (o_orderkey - 1 - o_custkey % 3), 'T' || (o_orderkey - 2)]) END AS deps FROM orders)"""
_NAMED = f"(SELECT b.board, b.id, b.dep, d.status FROM (SELECT board, id, unnest(deps) AS dep FROM {_BOARD}) b LEFT JOIN {_BOARD} d ON d.board = b.board AND d.id = b.dep)"
_EDGES = f"(SELECT * FROM {_NAMED} UNION SELECT b.board, b.id, d.id, d.status FROM {_BOARD} b JOIN {_BOARD} d ON d.board = b.board AND d.id <> b.id WHERE b.every)"
_READY = f"SELECT board, pos, id FROM {_BOARD} WHERE status = 'PENDING' AND (board, id) NOT IN (SELECT board, id FROM {_EDGES} WHERE status IS DISTINCT FROM 'DONE')"


@query(_READY)
def j17_eligible_tasks(t: Tables) -> DataFrame:
    return board.eligible(boards(t)).withColumn("pos", F.col("pos").cast("long"))


@query(
    f"""WITH RECURSIVE edges AS MATERIALIZED {_EDGES}, reach AS (SELECT board, id, dep FROM edges WHERE status IS NOT NULL
    UNION SELECT r.board, r.id, e.dep FROM reach r JOIN edges e ON e.board = r.board AND e.id = r.dep WHERE e.status IS NOT NULL)
    SELECT b.board, b.id, count(r.dep) FILTER (r.dep <> b.id) AS needs, count(r.dep) FILTER (r.dep <> b.id AND d.status <> 'DONE') AS open,
    coalesce(any_value(u.unknown), '') AS unknown, coalesce(bool_or(r.dep = b.id), false) AS cycle
    FROM {_BOARD} b LEFT JOIN reach r USING (board, id) LEFT JOIN {_BOARD} d ON d.board = r.board AND d.id = r.dep
    LEFT JOIN (SELECT board, id, string_agg(dep, ',' ORDER BY dep) AS unknown FROM edges WHERE status IS NULL GROUP BY ALL) u ON u.board = b.board AND u.id = b.id GROUP BY b.board, b.id"""
)
def j17_dependency_report(t: Tables) -> DataFrame:
    """What each task needs directly or not, what of it is open, which ids are unknown, and whether it needs itself."""
    keep = keeper(t.spark, "dependencies")
    return board.dependency_report(keep(boards(t)), keep).withColumn("unknown", F.array_join("unknown", ","))


@query(f"SELECT board, min(pos) AS pos, arg_min(id, pos) AS id FROM ({_READY}) GROUP BY board")
def w12_next_task(t: Tables) -> DataFrame:
    """The first eligible task of each board."""
    return board.next_task(boards(t)).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT board, status, CASE status WHEN 'BLOCKED' THEN 'waits for parts' ELSE '' END AS reason, count(*) AS n FROM {_BOARD} GROUP BY ALL")
def a32_board_summary(t: Tables) -> DataFrame:
    return boards(t).groupBy("board", "status", "reason").agg(F.count("*").alias("n"))


@query("SELECT 'C' || lpad(CAST(row_number() OVER (ORDER BY template_id) + 7 AS VARCHAR), 3, '0') AS id, template_id AS claim FROM (SELECT DISTINCT template_id FROM items)", "items")
def x15_append_claims(t: Tables) -> DataFrame:
    ledger = t.spark.createDataFrame([("C006",), ("C007",)], "id string")
    return board.append_claims(ledger, t.items.select(F.col("template_id").alias("claim")).distinct(), "claim")


@query(
    """SELECT source, source_record_id FROM (SELECT source, source_record_id, row_number() OVER (ORDER BY turn, source, item_id) AS pick FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('13|' || item_id), item_id) AS turn FROM items) WHERE turn <= 5) WHERE pick <= 5""",
    "items",
)
def w13_five_spot_checks(t: Tables) -> DataFrame:
    """Five rows that span the sources, each source's first in hash order before any second."""
    few = sampling.cap(t.items, ["source"], 5, 13).withColumn("h", F.sha2(F.concat_ws("|", F.lit("13"), "item_id"), 256))
    turn = F.expr("row_number() over (partition by source order by h, item_id)")
    return few.withColumn("turn", turn).orderBy("turn", "source", "item_id").limit(5).select("source", "source_record_id")


_PICK = """(SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn, template_id, item_id) AS pick FROM (
  SELECT *, row_number() OVER (PARTITION BY source, template_id ORDER BY sha256('7|' || item_id), item_id) AS turn FROM items WHERE split = 'test'))"""


@query(
    f"""SELECT p.item_id, p.template_id, l.quality, l.toxic, CASE {S.bucket("'verdict'", 'p.item_id')} % 10 WHEN 0 THEN 'R' WHEN 1 THEN NULL ELSE 'A' END AS verdict
    FROM {_PICK} p JOIN labels l ON CAST(l.doc_id AS VARCHAR) = p.source_record_id WHERE pick <= {RUN.audit_per_source}""",
    "items",
)
def j15_audit_with_raw_fields(t: Tables) -> DataFrame:
    """The audit sample beside the raw fields that its gold came from, and the verdicts so far."""
    from ..functions.hashing import bucket

    sample = sampling.stratified(t.items.filter("split = 'test'"), "source", "template_id", RUN.audit_per_source, SEED)
    raw = t.read("labels").select(F.col("doc_id").cast("string").alias("source_record_id"), "quality", "toxic")
    h = bucket(F.lit("verdict"), "item_id") % 10
    verdicts = sample.filter(h != 1).select("item_id", F.when(h == 0, "R").otherwise("A").alias("verdict"))
    return sample.join(raw, "source_record_id").join(verdicts, "item_id", "left").select("item_id", "template_id", "quality", "toxic", "verdict")


_TEXTS = "(SELECT i.item_id, i.template_id, i.split, i.gold, d.text FROM items i JOIN documents d ON CAST(d.doc_id AS VARCHAR) = i.source_record_id)"


@query(f"SELECT template_id, n, bow FROM {S.bag_of_words(_TEXTS)}", "items")
def a19_bag_of_words(t: Tables) -> DataFrame:
    """X11: every template's regression in one fit; the twin unrolls its steps."""
    docs = t.read("documents").select(F.col("doc_id").cast("string").alias("source_record_id"), F.col("text").alias("state"))
    return screen.bag_of_words(t.items.join(docs, "source_record_id"))


_LANGUAGES = "(SELECT i.item_id, d.lang || '|' || i.template_id AS template_id, i.split, i.gold, d.text FROM items i JOIN documents d ON CAST(d.doc_id AS VARCHAR) = i.source_record_id WHERE d.lang IS NOT NULL)"
_CLEAN = "CASE WHEN ends_with(template_id, 'toxic') THEN 'no' ELSE 'yes' END"


@query(
    f"""SELECT template_id, rule AS regex, bow, greatest(rule, coalesce(bow, -1e0)) >= 0.95e0 AS dropped FROM
    (SELECT template_id, avg(CASE WHEN gold = {_CLEAN} THEN 1e0 ELSE 0e0 END) AS rule FROM {_LANGUAGES} WHERE split = 'test' GROUP BY template_id) LEFT JOIN {S.bag_of_words(_LANGUAGES)} USING (template_id)""",
    "items",
)
def a20_drop_rule(t: Tables) -> DataFrame:
    """Templates by language: a rule that calls every document good and none toxic, or the bag of words, reaches the threshold."""
    docs = t.read("documents").filter("lang is not null").select(F.col("doc_id").cast("string").alias("source_record_id"), F.col("text").alias("state"), F.col("lang").alias("l"))
    rows = t.items.join(docs, "source_record_id").withColumn("template_id", F.concat_ws("|", "l", "template_id"))
    rule = F.when(F.col("template_id").endswith("toxic"), "no").otherwise("yes")
    regex = rows.filter("split = 'test'").groupBy("template_id").agg(F.avg((rule == F.col("gold")).cast("double")).alias("regex"))
    return screen.drop_rule(regex.join(screen.bag_of_words(rows).drop("n"), "template_id", "left"))


def _gate_sql(name: str, value: str, threshold: float, op: str, reason: str, source: str) -> str:
    ok = f"coalesce({value} {op} {threshold}e0, false)"
    return f"SELECT '{name}' AS gate, round(CAST({value} AS DOUBLE), 6) AS value, {threshold}e0 AS threshold, {ok} AS pass, CASE WHEN {ok} THEN '' ELSE '{reason}' END AS reason FROM ({source}) g"


_AGREE = "SELECT min(d) AS v FROM (SELECT template_id, abs(avg(CASE WHEN model = 'm-mid' THEN CASE WHEN ok THEN 1e0 ELSE 0e0 END END) - avg(CASE WHEN model = 'm-small' THEN CASE WHEN ok THEN 1e0 ELSE 0e0 END END)) * 100 AS d FROM scored GROUP BY template_id)"


@query(_gate_sql("G0a", "v", 2.0, "<=", "harness disagrees with its reference", _AGREE), "scored")
def g0a_harness_agreement(t: Tables) -> DataFrame:
    acc = lambda m: F.avg(F.when(F.col("model") == m, F.col("ok").cast("double")))
    best = t.scored.groupBy("template_id").agg((F.abs(acc("m-mid") - acc("m-small")) * 100).alias("d")).agg(F.min("d").alias("v"))
    return gates.at_most(best, "G0a", "v", 2.0, "harness disagrees with its reference")


_ECE = "SELECT sum(n * abs(a - c)) / sum(n) AS v FROM (SELECT least(14, CAST(floor(conf * 15e0) AS INTEGER)) AS bin, count(*) AS n, avg(conf) AS c, avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END) AS a FROM scored WHERE model = 'm-large' AND split = 'dev' GROUP BY ALL)"


@query(_gate_sql("G0c", "v", 0.05, "<=", "teacher is not calibrated", _ECE), "scored")
def g0c_teacher_calibration(t: Tables) -> DataFrame:
    bins = metrics.reliability(t.scored.filter("model = 'm-large' and split = 'dev'"), [])
    value = bins.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("v"))
    return gates.at_most(value, "G0c", "v", 0.05, "teacher is not calibrated")


@query(_gate_sql("G0d", "v", 1.0, ">=", "audit is not complete", f"SELECT avg(CASE WHEN {S.bucket(chr(39) + 'verdict' + chr(39), 'item_id')} % 10 <> 1 THEN 1e0 ELSE 0e0 END) AS v FROM {_PICK} WHERE pick <= {RUN.audit_per_source}"), "items")
def g0d_audit_done(t: Tables) -> DataFrame:
    rows = j15_audit_with_raw_fields(t).agg(F.avg(F.col("verdict").isNotNull().cast("double")).alias("v"))
    return gates.at_least(rows, "G0d", "v", 1.0, "audit is not complete")


@query(f"SELECT template_id, round(max(a), 6) AS best, max(a) > 0.95e0 AS too_easy FROM (SELECT template_id, model, {S.share('ok')} AS a FROM scored GROUP BY ALL) GROUP BY template_id", "scored")
def g0e_too_easy(t: Tables) -> DataFrame:
    each = t.scored.groupBy("template_id", "model").agg(F.avg(F.col("ok").cast("double")).alias("a"))
    return each.groupBy("template_id").agg(F.round(F.max("a"), 6).alias("best"), (F.max("a") > 0.95).alias("too_easy"))


_WON = """(SELECT item_id, unnest(['accuracy', 'brier']) AS metric, unnest([a, b]) AS v FROM (
  SELECT item_id, avg(CASE WHEN model = 'm-large' THEN CASE WHEN ok THEN 1e0 ELSE 0e0 END END) - avg(CASE WHEN model = 'm-small' THEN CASE WHEN ok THEN 1e0 ELSE 0e0 END END) AS a,
    avg(CASE WHEN model = 'm-small' THEN brier END) - avg(CASE WHEN model = 'm-large' THEN brier END) AS b FROM scored WHERE split = 'test' GROUP BY item_id))"""


@query(
    f"""SELECT metric, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, quantile_cont(mean, 0.025) > 0 AS pass
    FROM {S.poisson_means(_WON, 'metric')} GROUP BY metric""",
    "scored",
)
def g1_student_beats_baseline(t: Tables) -> DataFrame:
    """Accuracy and Brier differences with intervals that exclude nought."""
    value = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c).cast("double")))
    rows = t.scored.filter("split = 'test'").groupBy("item_id").agg((value("m-large", "ok") - value("m-small", "ok")).alias("accuracy"), (value("m-small", "brier") - value("m-large", "brier")).alias("brier"))
    long = rows.select("item_id", F.expr("stack(2, 'accuracy', accuracy, 'brier', brier) as (metric, v)"))
    low, high = F.percentile("mean", F.lit(0.025)), F.percentile("mean", F.lit(0.975))
    return bootstrap.poisson_means(long, "metric", "v").groupBy("metric").agg(F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), (low > 0).alias("pass"))


@query(f"SELECT model, template_id, round({S.share('ok')}, 6) AS accuracy, round(avg(brier), 6) AS brier FROM scored WHERE split = 'test' GROUP BY ALL", "scored")
def g3_by_size(t: Tables) -> DataFrame:
    rows, by = t.scored.filter("split = 'test'"), ["model", "template_id"]
    return metrics.accuracy(rows, by).drop("n").join(metrics.mean_of(rows, by, "brier"), by)


@query(
    f"""SELECT 'C' || lpad(CAST(row_number() OVER (ORDER BY model, template_id) AS VARCHAR), 3, '0') AS id, model, template_id, low > 0.5e0 AS ready FROM (
    SELECT template_id, model, quantile_cont(mean, 0.025) AS low FROM (SELECT split_part(c, '|', 1) AS template_id, split_part(c, '|', 2) AS model, mean FROM
      {S.exact_means("(SELECT template_id || '|' || model AS c, CASE WHEN ok THEN 1e0 ELSE 0e0 END AS v FROM scored WHERE split = 'dev')", 'c')}) GROUP BY ALL)""",
    "scored",
)
def g4_claim_ready(t: Tables) -> DataFrame:
    """Claims are numbered as the ledger numbers them; one is ready whose interval lies above chance."""
    rows = t.scored.filter("split = 'dev'").select(F.concat_ws("|", "template_id", "model").alias("c"), F.col("ok").cast("double").alias("v"))
    low = bootstrap.exact_means(rows, "c", "v").groupBy("c").agg(F.percentile("mean", F.lit(0.025)).alias("low"))
    claims = low.select(F.split("c", r"\|")[0].alias("template_id"), F.split("c", r"\|")[1].alias("model"), (F.col("low") > 0.5).alias("ready"))
    empty = t.spark.createDataFrame([], "id string")
    return board.append_claims(empty, claims, "model, template_id").select("id", "model", "template_id", "ready")


@query(_gate_sql("GC", "v", 0.0, "<=", "items without predictions", "SELECT count(*) AS v FROM items WHERE item_id NOT IN (SELECT item_id FROM predictions WHERE model = 'm-mid' AND supported)"), "predictions")
def gc_completeness(t: Tables) -> DataFrame:
    missing = unpredicted(t.items, t.predictions.filter("model = 'm-mid' and supported")).agg(F.count("*").alias("v"))
    return gates.at_most(missing, "GC", "v", 0.0, "items without predictions")


@query("SELECT template_id, split, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY template_id) AS BIGINT) AS total FROM items GROUP BY template_id, split", "items")
def gc_arithmetic(t: Tables) -> DataFrame:
    """Split counts beside the totals that they sum to."""
    each = t.items.groupBy("template_id", "split").agg(F.count("*").alias("n"))
    return each.join(t.items.groupBy("template_id").agg(F.count("*").alias("total")), "template_id").select("template_id", "split", "n", "total")


@query("SELECT source, split, qtype, template_id, count(*) AS n, template_id = 'toxic' AS dropped FROM items GROUP BY ALL", "items")
def s19_manifest(t: Tables) -> DataFrame:
    marks = t.spark.createDataFrame([("toxic", True), ("quality", False)], "template_id string, dropped boolean")
    return t.items.groupBy("source", "split", "qtype", "template_id").agg(F.count("*").alias("n")).join(F.broadcast(marks), "template_id").select("source", "split", "qtype", "template_id", "n", "dropped")


_LICENSE = r"(?i)(MIT License|Apache License|BSD|GPL|CC[ -]BY(?:-[A-Z]+)*)"
_REVISIONS = f"""(SELECT source, sha256(string_agg(h, '' ORDER BY p)) AS revision FROM (
  SELECT source, {S.prefix('sha256(text)', '(SELECT * FROM documents WHERE text IS NOT NULL)')} AS p, sha256(string_agg(sha256(text), '' ORDER BY sha256(text))) AS h FROM documents WHERE text IS NOT NULL GROUP BY ALL) GROUP BY source)"""


@query(
    f"""SELECT item_id, 'documents/' || i.source AS dataset, coalesce(revision, 'UNKNOWN') AS revision, coalesce(license, 'UNKNOWN') AS license FROM items i
    LEFT JOIN {_REVISIONS} USING (source) LEFT JOIN (SELECT source, min(regexp_extract(text, '{_LICENSE}', 1)) AS license FROM documents WHERE regexp_matches(text, '{_LICENSE}') GROUP BY source) USING (source)""",
    "items",
)
def s09_provenance(t: Tables) -> DataFrame:
    """Each source as a data set: its revision is the hash of its texts, its licence the first that they name."""
    from ..sources.loaders import join_provenance

    docs = t.read("documents")
    named = F.regexp_extract("text", _LICENSE, 1)
    licences = docs.filter(named != "").groupBy("source").agg(F.min(named).alias("license"))
    table = checks.content_hash(docs.filter("text is not null"), ["source"], "text").withColumnRenamed("sha256", "revision").join(licences, "source", "left")
    out = join_provenance(t.items, table.withColumn("dataset_id", F.concat(F.lit("documents/"), "source")), "source")
    return out.select("item_id", F.col("dataset_id").alias("dataset"), "revision", F.col("source_license").alias("license"))


_SEEDED = "(SELECT max(n_nationkey) AS seed, 10 * count(*) AS cap FROM nation)"


@query(
    f"""SELECT item_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256(seed || '|' || item_id), item_id) AS r FROM items CROSS JOIN {_SEEDED} WHERE split = 'test')
    WHERE r <= cap""",
    "items",
)
def s21_run_config(t: Tables) -> DataFrame:
    """Seed and cap of a run come from its file."""
    root = scratch_dir(t.spark, "config")
    n = t.read("nation").agg(F.max("n_nationkey").alias("seed"), (10 * F.count("*")).alias("cap"))
    n.select(F.concat(F.lit("# of this run\nseed: "), F.col("seed").cast("string"), F.lit("\ntest_cap: "), F.col("cap").cast("string")).alias("value")).coalesce(1).write.mode("overwrite").text(root)
    run = load_config(t.spark, root)
    return sampling.cap(t.items.filter("split = 'test'"), ["source"], run.test_cap, run.seed).select("item_id", "source")


@query(
    f"""SELECT sha256('choice|' || o_orderkey || '|order_status|7') AS item_id, CASE WHEN {S.bucket('CAST(o_orderkey AS VARCHAR)')} % 10 = 0 THEN 'dev' ELSE 'train' END AS split, o_orderstatus AS gold FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT sha256('choice|' || o_orderkey || '|order_status|7'), 'test', o_orderstatus FROM orders WHERE o_orderkey % 2 = 1"""
)
def s02_choice_loader(t: Tables) -> DataFrame:
    """Multiple-choice rows with an official split: validation becomes test, dev is carved from train."""
    from ..sources.loaders import choice_items

    choices = F.array(F.lit("F"), F.lit("O"), F.lit("P"))
    rows = t.read("orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.lit("What is the status?").alias("question"), choices.alias("choices"),
        (F.array_position(choices, F.col("o_orderstatus")) - 1).cast("int").alias("answer_idx"), F.when(F.col("o_orderkey") % 2 == 0, "train").otherwise("validation").alias("split"),
    )
    return choice_items(rows, "choice", "order_status", SEED, carve=10).select("item_id", "split", "gold")


@query("SELECT o_orderkey, CAST(gold - 1 AS INTEGER) AS level, '1-URGENT' AS lowest FROM (SELECT o_orderkey, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority) AS gold FROM orders) WHERE gold IS NOT NULL")
def s07_score_items(t: Tables) -> DataFrame:
    """Graded items keep their levels lowest first."""
    from ..sources.loaders import graded_items

    rows = t.read("orders").select(F.col("o_orderkey").cast("string").alias("query_id"), F.lit("p").alias("doc_id"), F.col("o_orderpriority").alias("grade"))
    out = graded_items(rows, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), "orders", SEED)
    level = F.array_position(F.transform("options", lambda o: o["key"]), F.col("gold")) - 1
    return out.select(F.split("source_record_id", ":")[0].cast("long").alias("o_orderkey"), level.cast("int").alias("level"), F.element_at("options", 1)["key"].alias("lowest"))
