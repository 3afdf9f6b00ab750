"""Templates, filters, joins of records, samples, probes and set checks (P, F, J, W, U, X)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import text as X
from ..functions.hashing import bucket, hash_order
from ..operators import checks, items, leaks, passages, probes, sampling
from ..sources.adapters import SEED, Tables
from ..sources.scratch import keeper
from . import base_sql as S
from .registry import query

RUN = RunConfig()
KEYS = ["item_id", "source_record_id", "split", "state", "options", "gold"]


def _flat(rows: DataFrame) -> DataFrame:
    keys = F.array_join(F.transform("options", lambda o: o["key"]), ",")
    return rows.select("item_id", "source_record_id", "split", "state", keys.alias("options"), "gold")


def _item_sql(source: str, frame: str, record: str, template: str, state: str, gold: str, options: str | None, labels: str | None = None) -> str:
    """options: a SQL list for a choice, in seeded order; labels: the text of fixed options in their own order."""
    ident = f"sha256('{source}|' || {record} || '|{template}|{SEED}')"
    if options:
        listed = f"(SELECT string_agg(o, ',' ORDER BY sha256('{SEED}|' || item_id || '|' || o)) FROM (SELECT unnest(opts) AS o))"
    else:
        listed = f"'{labels}'"
    return f"""SELECT item_id, source_record_id, split, state, {listed} AS options, gold FROM (
    SELECT {ident} AS item_id, {record} AS source_record_id, CASE WHEN {S.bucket(record)} % 5 = 0 THEN 'dev' ELSE 'test' END AS split,
           {state} AS state, {options or 'NULL'} AS opts, {gold} AS gold FROM {frame}) WHERE gold IS NOT NULL"""


_TRIAL = "replace(brief_summary || chr(10) || detailed_description, title, '')"


@query(_item_sql("trials", "trials", "nct_id", "trial_phase", f"replace({_TRIAL}, phase, '')", "phase", "['Phase 1', 'Phase 2', 'Phase 3', 'Phase 4']"), "trials")
def p01_trial_phase(t: Tables) -> DataFrame:
    return _flat(items.trial_phase(t.trials, SEED))


@query(
    _item_sql("trials", "trials", "nct_id", "trial_allocation", _TRIAL, "CASE WHEN allocation = 'RANDOMIZED' THEN 'yes' WHEN allocation IS NOT NULL THEN 'no' END", None, "yes,no"), "trials"
)
def p02_trial_allocation(t: Tables) -> DataFrame:
    return _flat(items.trial_allocation(t.trials, SEED))


@query(_item_sql("trials", "trials", "nct_id", "trial_purpose", f"replace({_TRIAL}, primary_purpose, '')", "primary_purpose", "['TREATMENT', 'PREVENTION', 'DIAGNOSTIC']"), "trials")
def p03_trial_purpose(t: Tables) -> DataFrame:
    return _flat(items.trial_purpose(t.trials, SEED, ("TREATMENT", "PREVENTION", "DIAGNOSTIC")))


@query(_item_sql("trials", "trials", "nct_id", "trial_intervention", f"replace({_TRIAL}, one_type, '')", "one_type", "['DRUG', 'DEVICE', 'BEHAVIORAL']"), "trials")
def p04_trial_intervention(t: Tables) -> DataFrame:
    return _flat(items.trial_intervention(t.trials, SEED, ("DRUG", "DEVICE", "BEHAVIORAL")))


@query(
    _item_sql("trials", "trials", "nct_id", "trial_healthy", "replace(condition || chr(10) || brief_summary, title, '')", "CASE WHEN healthy_volunteers THEN 'yes' WHEN NOT healthy_volunteers THEN 'no' END", None, "yes,no"),
    "trials",
)
def p05_trial_healthy(t: Tables) -> DataFrame:
    return _flat(items.trial_healthy(t.trials, SEED))


def _others_sql(key: str, gold: str, n: int = 3) -> str:
    """The gold and up to n others at the places of `ring` (a list in hash order) that a record visits."""
    place = f"({S.bucket(repr(str(SEED)), repr('start'), key)} % len(ring) + i * (1 + {S.bucket(repr(str(SEED)), repr('step'), key)} % greatest((len(ring) - 1) // {n}, 1))) % len(ring) + 1"
    return f"list_concat([{gold}], list_distinct(list_filter(list_transform(range({n + 1}), lambda i: ring[{place}]), lambda c: c <> {gold})[1:{n}]))"


_PLACE = f"CAST('0x' || substr(sha256('{SEED}|' || c), 1, 15) AS BIGINT)"
_RINGED = f"(SELECT * FROM drug_labels CROSS JOIN (SELECT list(c ORDER BY {_PLACE}) AS ring FROM (SELECT DISTINCT pharm_class AS c FROM drug_labels)))"
_OTHERS = _others_sql("set_id", "pharm_class")


@query(_item_sql("labels", _RINGED, "set_id", "label_class", "replace(s_boxed || chr(10) || s_ind || chr(10) || s_route, pharm_class, '')", "pharm_class", _OTHERS), "drug_labels")
def p06_label_class(t: Tables) -> DataFrame:
    return _flat(items.label_class(t.labels, SEED))


@query(
    _item_sql("labels", "drug_labels", "set_id", "label_boxed", "s_class || chr(10) || s_ind || chr(10) || s_route", "CASE WHEN boxed_warning IS NULL THEN 'no' ELSE 'yes' END", None, "yes,no"), "drug_labels"
)
def p07_label_boxed(t: Tables) -> DataFrame:
    return _flat(items.label_boxed(t.labels, SEED))


_ROUTES = ("ECONOMY", "STANDARD", "PROMO")


@query(_item_sql("labels", "drug_labels", "set_id", "label_route", "replace(s_boxed || chr(10) || s_class || chr(10) || s_ind, route, '')", "route", "['ECONOMY', 'STANDARD', 'PROMO']"), "drug_labels")
def p08_label_route(t: Tables) -> DataFrame:
    return _flat(items.label_route(t.labels, SEED, _ROUTES))


_TYPES = "['meta-analysis', 'systematic review', 'randomized controlled trial', 'case report', 'observational', 'other']"


@query(
    _item_sql("pubmed", "papers", "pmid", "paper_type", "concat_ws(chr(10), title, abstract)", "CASE pub WHEN 0 THEN 'case report' WHEN 1 THEN 'randomized controlled trial' WHEN 2 THEN 'meta-analysis' ELSE 'other' END", _TYPES),
    "papers",
)
def p09_paper_type(t: Tables) -> DataFrame:
    return _flat(items.paper_type(t.papers, SEED))


@query(_item_sql("pubmed", "papers", "pmid", "paper_humans", "concat_ws(chr(10), title, abstract)", "CASE tag WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END", None, "yes,no"), "papers")
def p10_paper_humans(t: Tables) -> DataFrame:
    return _flat(items.paper_humans(t.papers, SEED))


_LEVELLED = f"(SELECT * FROM papers JOIN (SELECT level, list(c ORDER BY {_PLACE}) AS ring FROM (SELECT DISTINCT topic AS c, level FROM papers) GROUP BY level) USING (level))"
_TOPICS = _others_sql("pmid", "topic")


@query(_item_sql("pubmed", _LEVELLED, "pmid", "paper_topic", "concat_ws(chr(10), title, abstract)", "topic", _TOPICS), "papers")
def p11_paper_topic(t: Tables) -> DataFrame:
    return _flat(items.paper_topic(t.papers, SEED))


@query("SELECT item_id, source_record_id, template_id FROM items", "items")
def p12_item_ids(t: Tables) -> DataFrame:
    return t.items.select("item_id", "source_record_id", "template_id")


def _order_sql(salt: str) -> str:
    return f"SELECT item_id, (SELECT string_agg(o, ',' ORDER BY sha256('{salt}|' || item_id || '|' || o)) FROM (SELECT unnest(options) AS o)) AS options FROM brands"


@query(_order_sql("7"), "brands")
def p13_option_order(t: Tables) -> DataFrame:
    shown = hash_order("options", F.lit("7"), F.col("item_id"))
    return t.brands.select("item_id", F.array_join(F.transform(shown, lambda o: o["key"]), ",").alias("options"))


@query(
    """SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS gold, regexp_replace(url, '/[a-z][a-z]/', '/', 'g') AS url,
    length(regexp_replace(html, '<html lang="[a-z]+"', '<html', 'g')) AS n FROM pages"""
)
def p14_answer_leak(t: Tables) -> DataFrame:
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    clean = F.regexp_replace("html", '<html lang="[a-z]+"', "<html")
    return t.read("pages").select("page_id", lang.alias("gold"), F.regexp_replace("url", "/[a-z][a-z]/", "/").alias("url"), F.length(clean).cast("long").alias("n"))


@query(
    r"""SELECT p_partkey, regexp_replace(p_name, '\b(' || (SELECT string_agg(DISTINCT lower(p_type), '|') FROM part) || ')\b', '', 'gi') || ' of size ' || p_size || ' is a , of  and ; twice .' AS state FROM part"""
)
def p14_spelled_leaks(t: Tables) -> DataFrame:
    """Answers in other cases, in the plural and with other marks between their words are taken out, all of two vocabularies at once."""
    p = t.read("part")
    size = F.concat(F.lit(" of size "), F.col("p_size").cast("string"), F.lit(" is a "))
    state = F.concat_ws("", "p_name", size, F.lower("p_brand"), F.lit(", of "), F.regexp_replace("p_brand", "#", " - "), F.lit(" and "), F.concat(F.initcap("p_type"), F.lit("s")), F.lit("; twice "), F.upper("p_type"), F.lit("."))
    answers = p.select(F.col("p_brand").alias("answer")).unionByName(p.select(F.col("p_type").alias("answer"))).distinct()
    return leaks.remove_answers(p.select("p_partkey", state.alias("state")), answers, "p_partkey", "state", "answer")


@query(
    """SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) || chr(10) || 'A. yes' || chr(10) || 'B. no' AS prompt FROM conversations GROUP BY conv_id"""
)
def p15_prompt(t: Tables) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    said = F.array_join(F.transform(turns, lambda s: F.concat(s["role"], F.lit(": "), s["text"])), "\n")
    rows = t.read("conversations").groupBy("conv_id").agg(said.alias("state")).withColumn("options", items.fixed_options("yes", "no"))
    return rows.select("conv_id", F.concat("state", F.lit("\n"), X.render_options("options")).alias("prompt"))


@query(
    """SELECT item_id, (SELECT string_agg(s, ' ' ORDER BY sha256('7|' || item_id || '|' || (i - 1) || '|' || s), s) FROM
    (SELECT unnest(s) AS s, generate_subscripts(s, 1) AS i FROM (SELECT regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)) AS s))) AS text FROM benchmark"""
)
def p16_paraphrase_control(t: Tables) -> DataFrame:
    return t.read("benchmark").select("item_id", X.reorder_sentences(F.col("text"), F.lit("7"), F.col("item_id").cast("string")).alias("text"))


@query("SELECT sha256(item_id || '|nota') AS item_id, item_id AS parent_id, array_to_string(list_filter(options, lambda o: o <> gold), ',') || ',nota' AS options, 'nota' AS gold FROM brands", "brands")
def p17_none_of_the_above(t: Tables) -> DataFrame:
    rows = probes.none_of_the_above(t.brands)
    return rows.select("item_id", "parent_id", F.array_join(F.transform("options", lambda o: o["key"]), ",").alias("options"), "gold")


@query(
    """SELECT sha256(parent_id || '|k' || k) AS item_id, parent_id, k, (SELECT string_agg(o, ',' ORDER BY sha256('order7|' || parent_id || '|' || o)) FROM (SELECT unnest(opts) AS o)) AS options, gold FROM (
    SELECT item_id AS parent_id, k, gold, list_concat([gold], (SELECT coalesce(list(o ORDER BY sha256('k7|' || item_id || '|' || o))[1:k - 1], []) FROM (SELECT unnest(options) AS o) x WHERE o <> gold)) AS opts
    FROM brands CROSS JOIN (VALUES (2), (4), (8), (16)) v(k) WHERE len(options) >= k)""",
    "brands",
)
def p18_candidate_counts(t: Tables) -> DataFrame:
    rows = probes.candidate_counts(t.brands, (2, 4, 8, 16), SEED)
    return rows.select("item_id", "parent_id", "k", F.array_join(F.transform("options", lambda o: o["key"]), ",").alias("options"), "gold")


@query(
    """SELECT sha256(item_id || '|shuffle|8') AS item_id, item_id AS parent_id, (SELECT string_agg(o, ',' ORDER BY sha256('shuffle8|' || item_id || '|' || o)) FROM (SELECT unnest(options) AS o)) AS options FROM brands""",
    "brands",
)
def p19_second_permutation(t: Tables) -> DataFrame:
    rows = probes.shuffled(t.brands, SEED + 1)
    return rows.select("item_id", "parent_id", F.array_join(F.transform("options", lambda o: o["key"]), ",").alias("options"))


_KIND = "CASE WHEN template_id = 'toxic' THEN 'safety' ELSE 'quality' END"


@query(f"SELECT qtype, {_KIND} AS skill, count(*) AS n FROM items GROUP BY ALL", "items")
def p20_skill_mapping(t: Tables) -> DataFrame:
    skill = F.when(F.col("template_id") == "toxic", "safety").otherwise("quality")
    return t.items.groupBy("qtype", skill.alias("skill")).agg(F.count("*").alias("n"))


@query("SELECT nct_id FROM trials WHERE first_posted BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'", "trials")
def f01_first_posted_window(t: Tables) -> DataFrame:
    """By the first-posted date; a later update does not make a record fresh."""
    return t.trials.filter(F.col("first_posted").between("1997-01-01", "1997-12-31")).select("nct_id")


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING min(o_orderdate) >= TIMESTAMP '1998-01-01'")
def f02_first_effective(t: Tables) -> DataFrame:
    return t.read("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("d")).filter("d >= timestamp_ntz '1998-01-01'").select("o_custkey")


@query("SELECT pmid FROM papers WHERE entry_date BETWEEN DATE '2024-06-01' AND DATE '2024-06-30'", "papers")
def f03_entry_date(t: Tables) -> DataFrame:
    return t.papers.filter(F.col("entry_date").between("2024-06-01", "2024-06-30")).select("pmid")


@query(
    """SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')"""
)
def f04_not_before_window(t: Tables) -> DataFrame:
    """Ids of the window without those that existed before it."""
    o = t.read("orders").select("o_custkey", "o_orderdate")
    start = F.expr("timestamp_ntz '1998-01-01'")
    return o.filter(F.col("o_orderdate") >= start).select("o_custkey").distinct().join(o.filter(F.col("o_orderdate") < start).select("o_custkey").distinct(), "o_custkey", "left_anti")


@query("SELECT template_id, count(*) AS n FROM items WHERE split = 'test' GROUP BY template_id", "items")
def f05_test_only(t: Tables) -> DataFrame:
    return t.items.filter("split = 'test'").groupBy("template_id").agg(F.count("*").alias("n"))


@query("SELECT item_id, model FROM scored WHERE n_chars <= CASE model WHEN 'm-small' THEN 1000 WHEN 'm-mid' THEN 4000 ELSE 100000 END", "scored")
def f07_supported(t: Tables) -> DataFrame:
    limits = t.spark.createDataFrame([("m-small", 1000), ("m-mid", 4000), ("m-large", 100000)], "model string, context long")  # one row per model
    return t.scored.join(F.broadcast(limits), "model").filter(F.col("n_chars") <= F.col("context")).select("item_id", "model")


@query("SELECT CAST(sum(CASE WHEN gold IN ('yes', 'no') THEN 0 ELSE 1 END) AS BIGINT) AS faults, count(*) AS n FROM items", "items")
def f08_validity(t: Tables) -> DataFrame:
    rows = t.items.withColumn("options", items.fixed_options("yes", "no"))
    from ..schema import gold_in_options

    return rows.agg(F.sum((~gold_in_options()).cast("long")).alias("faults"), F.count("*").alias("n"))


_RULE = "CASE WHEN regexp_matches(lower(text), '\\\\b(idiot|moron|scum)\\\\b') THEN 'yes' ELSE 'no' END"


@query(
    f"""SELECT split, count(*) AS n, round(avg(CASE WHEN ({_RULE} = 'yes') = (toxic = 1) THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM (
    SELECT text, toxic, CASE WHEN {S.bucket('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN 'dev' ELSE 'test' END AS split FROM documents JOIN labels USING (doc_id)) GROUP BY split""".replace("\\\\", "\\")
)
def f09_keyword_baseline(t: Tables) -> DataFrame:
    """A18 is the test row."""
    from ..operators.screen import keyword_rule

    rows = t.read("documents").select("doc_id", "text").join(t.read("labels").select("doc_id", "toxic"), "doc_id")
    split = F.when(bucket(F.col("doc_id").cast("string")) % 5 == 0, "dev").otherwise("test")
    right = (keyword_rule(F.lower("text"), [(r"\b(idiot|moron|scum)\b", "yes")], "no") == "yes") == (F.col("toxic") == 1)
    return rows.groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.round(F.avg(right.cast("double")), 6).alias("accuracy"))


@query("SELECT item_id, model FROM scored WHERE conf < 0.7e0", "scored")
def f10_low_confidence(t: Tables) -> DataFrame:
    return t.scored.filter(F.array_max("probs") < 0.7).select("item_id", "model")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def j10_relevance(t: Tables) -> DataFrame:
    """Which documents hold a benchmark passage."""
    return passages.holders(t.read("documents").select("doc_id", "text"), t.read("benchmark").select("item_id", F.col("text").alias("passage")))


@query("SELECT nct_id, w.start AS start FROM trials JOIN (SELECT CAST(max(first_posted) - 365 AS DATE) AS s, CAST(CAST(max(first_posted) - 365 AS DATE) AS VARCHAR) AS start FROM trials) w ON first_posted >= w.s", "trials")
def j20_window_row(t: Tables) -> DataFrame:
    """Records against a one-row window."""
    window = t.trials.agg(F.date_sub(F.max("first_posted"), 365).alias("s"))
    return t.trials.crossJoin(F.broadcast(window)).filter("first_posted >= s").select("nct_id", F.col("s").cast("string").alias("start"))


_PENDING = "(VALUES ('C1', 'a.json'), ('C2', 'b.json'), ('C3', 'c.json')) l(id, artifact)"


@query(f"SELECT id, artifact FROM {_PENDING} WHERE artifact NOT IN ('a.json', 'c.json')")
def j21_orphan_claims(t: Tables) -> DataFrame:
    from ..operators.board import orphan_claims

    ledger = t.spark.createDataFrame([("C1", "a.json"), ("C2", "b.json"), ("C3", "c.json")], "id string, artifact string")
    there = t.spark.createDataFrame([("a.json",), ("c.json",)], "artifact string")
    return orphan_claims(ledger, there).select("id", "artifact")


@query("SELECT item_id, template_id, template_id = 'toxic' AS dropped FROM items", "items")
def j22_screen_marks(t: Tables) -> DataFrame:
    """F6 keeps the rest."""
    screen = t.spark.createDataFrame([("toxic", 0.97, 0.9), ("quality", 0.6, None)], "template_id string, regex double, bow double")
    from ..operators.screen import drop_rule

    return t.items.join(F.broadcast(drop_rule(screen).select("template_id", "dropped")), "template_id", "left").select("item_id", "template_id", "dropped")


_IN = "split = '{}'"


def _rank_sql(by: str, seed: int = SEED, rows: str = "items", where: str = "true") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY sha256('{seed}|' || item_id), item_id) AS r FROM {rows} WHERE {where})"


@query(f"SELECT item_id, source, template_id FROM {_rank_sql('source', where=_IN.format('test'))} WHERE r <= {RUN.test_cap}", "items")
def w01_cap_test(t: Tables) -> DataFrame:
    return sampling.cap(t.items.filter("split = 'test'"), ["source"], RUN.test_cap, SEED).select("item_id", "source", "template_id")


@query(f"SELECT item_id, source FROM {_rank_sql('source', where=_IN.format('dev'))} WHERE r <= {RUN.dev_cap}", "items")
def w02_cap_dev(t: Tables) -> DataFrame:
    return sampling.cap(t.items.filter("split = 'dev'"), ["source"], RUN.dev_cap, SEED).select("item_id", "source")


@query(f"SELECT item_id, source FROM {_rank_sql('source', 11)} WHERE r <= {RUN.contamination_cap}", "items")
def w03_contamination_sample(t: Tables) -> DataFrame:
    return sampling.cap(t.items, ["source"], RUN.contamination_cap, 11).select("item_id", "source")


@query(
    """SELECT item_id, source, gold FROM (SELECT *, row_number() OVER (PARTITION BY source, gold ORDER BY sha256('7|' || item_id), item_id) AS r FROM items)
    JOIN (SELECT source, min(n) AS least, count(*) AS labels FROM (SELECT source, gold, count(*) AS n FROM items GROUP BY ALL) GROUP BY source) USING (source) WHERE labels > 1 AND r <= least""",
    "items",
)
def w04_balanced(t: Tables) -> DataFrame:
    return sampling.balanced(t.items, ["source"], "gold", SEED, "item_id").select("item_id", "source", "gold")


_TURN = "(SELECT *, row_number() OVER (PARTITION BY {by}, {spread} ORDER BY sha256('7|' || item_id), item_id) AS turn FROM items WHERE split = '{split}')"


@query(
    f"""SELECT item_id, source, template_id, pick FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn, template_id, item_id) AS pick
    FROM {_TURN.format(by='source', spread='template_id', split='test')}) WHERE pick <= {RUN.audit_per_source}""",
    "items",
)
def w05_audit_sample(t: Tables) -> DataFrame:
    return sampling.stratified(t.items.filter("split = 'test'"), "source", "template_id", RUN.audit_per_source, SEED).select("item_id", "source", "template_id", F.col("pick").cast("long").alias("pick"))


@query(
    f"""SELECT item_id, template_id, source, pick FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY turn, source, item_id) AS pick
    FROM {_TURN.format(by='template_id', spread='source', split='dev')}) WHERE pick <= {RUN.stratified_dev}""",
    "items",
)
def w06_stratified_dev(t: Tables) -> DataFrame:
    return sampling.stratified(t.items.filter("split = 'dev'"), "template_id", "source", RUN.stratified_dev, SEED).select("item_id", "template_id", "source", F.col("pick").cast("long").alias("pick"))


@query(
    f"""SELECT item_id FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY turn, source, item_id) AS pick
    FROM {_TURN.format(by='template_id', spread='source', split='dev')}) WHERE pick <= {RUN.thinking}""",
    "items",
)
def w07_thinking_subset(t: Tables) -> DataFrame:
    """A prefix of the order of W6, so the same items."""
    return sampling.stratified(t.items.filter("split = 'dev'"), "template_id", "source", RUN.thinking, SEED).select("item_id")


@query(f"SELECT CASE WHEN {S.bucket('CAST(o_orderkey AS VARCHAR)')} % 5 = 0 THEN 'dev' ELSE 'test' END AS split, count(*) AS n FROM orders GROUP BY ALL")
def w08_record_split(t: Tables) -> DataFrame:
    split = F.when(sampling.fifth(F.col("o_orderkey").cast("string")) == 0, "dev").otherwise("test")
    return t.read("orders").groupBy(split.alias("split")).agg(F.count("*").alias("n"))


@query(f"SELECT template_id, {S.bucket(chr(39) + 'half' + chr(39), 'item_id')} % 2 AS half, count(*) AS n FROM items GROUP BY ALL", "items")
def w09_halves(t: Tables) -> DataFrame:
    return t.items.groupBy("template_id", sampling.half("item_id").alias("half")).agg(F.count("*").alias("n"))


@query("SELECT item_id, array_to_string((SELECT list(o ORDER BY sha256('d|' || item_id || '|' || o))[1:3] FROM (SELECT unnest(options) AS o) x WHERE o <> gold), ',') AS distractors FROM brands", "brands")
def w11_distractors(t: Tables) -> DataFrame:
    """Other classes of the build, the first three in hash order."""
    drawn = sampling.distractors("options", F.col("gold"), 3, F.lit("d"), F.col("item_id"))
    return t.brands.select("item_id", F.array_join(F.transform(drawn, lambda o: o["key"]), ",").alias("distractors"))


@query("SELECT item_id, source, 'established' AS tier FROM items WHERE source < 'src3' UNION ALL SELECT item_id, source, tier FROM items WHERE source >= 'src3'", "items")
def u01_union(t: Tables) -> DataFrame:
    cols = ["item_id", "source", "tier"]
    old = t.items.filter("source < 'src3'").withColumn("tier", F.lit("established")).select(*cols)
    return old.unionByName(t.items.filter("source >= 'src3'").select(*cols))


@query("SELECT CAST(NULL AS VARCHAR) AS item_id, CAST(NULL AS VARCHAR) AS only WHERE false")
def u02_rebuild(t: Tables) -> DataFrame:
    """Two builds, the second on another partitioning, differ in no row."""
    again = Tables(t.spark, t.sf_dir).items.repartition(5, "gold")
    return checks.rebuild_difference(t.items, again).select("item_id", "only")


@query(
    f"""SELECT item_id, 'first' AS only, gold FROM items WHERE {S.bucket("'changed'", 'item_id')} % 50 = 0
    UNION ALL SELECT item_id, 'second', CASE gold WHEN 'yes' THEN 'no' ELSE 'yes' END FROM items WHERE {S.bucket("'changed'", 'item_id')} % 50 = 0""",
    "items",
)
def u02_where_builds_differ(t: Tables) -> DataFrame:
    """A second build in which some golds changed; a tree of hashes leads to their rows."""
    other = F.when(bucket(F.lit("changed"), "item_id") % 50 == 0, F.when(F.col("gold") == "yes", "no").otherwise("yes")).otherwise(F.col("gold"))
    again = Tables(t.spark, t.sf_dir).items.withColumn("gold", other).repartition(5, "source")
    return checks.tree_difference(t.items, again, "item_id", keeper(t.spark, "difference")).select("item_id", "only", "gold")


@query("SELECT source_record_id FROM items WHERE split = 'dev' INTERSECT SELECT source_record_id FROM items WHERE split = 'test'", "items")
def u03_split_overlap(t: Tables) -> DataFrame:
    part = lambda s: t.items.filter(F.col("split") == s).select("source_record_id")
    return part("dev").intersect(part("test"))


@query(
    """SELECT variant, count(*) AS n FROM (SELECT 'base' AS variant FROM brands UNION ALL SELECT 'nota' FROM brands UNION ALL SELECT 'shuffle' FROM brands
    UNION ALL SELECT 'k' || k FROM brands CROSS JOIN (VALUES (2), (4), (8), (16)) v(k) WHERE len(options) >= k) GROUP BY variant""",
    "brands",
)
def u04_variants(t: Tables) -> DataFrame:
    base = t.brands.select(F.lit("base").alias("variant"))
    for more in (probes.none_of_the_above(t.brands), probes.shuffled(t.brands, 8), probes.candidate_counts(t.brands, (2, 4, 8, 16), SEED)):
        base = base.unionByName(more.select("variant"))
    return base.groupBy("variant").agg(F.count("*").alias("n"))


def _answer(prefix: str, options: Column) -> Column:
    """A stand-in for a model: which option's content it takes."""
    ranked = F.transform(options, lambda o, i: F.struct(bucket(F.lit(prefix), F.col("parent_id"), o["key"], F.when(i < 5, "near").otherwise("far")).alias("h"), o["key"].alias("k")))
    return F.array_max(ranked)["k"]


def _answer_sql(options: str, parent: str) -> str:
    h = S.bucket("'m'", parent, "o", "CASE WHEN i <= 5 THEN 'near' ELSE 'far' END")
    return f"(SELECT arg_max(o, ({h}, o)) FROM (SELECT unnest({options}) AS o, generate_subscripts({options}, 1) AS i))"


@query(
    f"""SELECT 'm' AS model, count(*) AS n, round(avg(CASE WHEN a <> b THEN 1e0 ELSE 0e0 END), 6) AS flip_rate FROM (
    SELECT {_answer_sql('options', 'item_id')} AS a, {_answer_sql('shown', 'item_id')} AS b FROM (
    SELECT item_id, options, (SELECT list(o ORDER BY sha256('shuffle8|' || item_id || '|' || o)) FROM (SELECT unnest(options) AS o)) AS shown FROM brands))""",
    "brands",
)
def a09_flip_rate(t: Tables) -> DataFrame:
    base = t.brands.withColumn("parent_id", F.col("item_id"))
    varied = probes.shuffled(t.brands, 8)
    said = lambda rows: rows.select("parent_id", F.lit("m").alias("model"), _answer("m", F.col("options")).alias("content"))
    return probes.flip_rate(said(base), said(varied), ["model"])


@query(
    f"""SELECT k, count(*) AS n, round(avg(CASE WHEN {_answer_sql('shown', 'parent_id')} = gold THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM (
    SELECT parent_id, k, gold, (SELECT list(o ORDER BY sha256('order7|' || parent_id || '|' || o)) FROM (SELECT unnest(opts) AS o)) AS shown FROM (
    SELECT item_id AS parent_id, k, gold, list_concat([gold], (SELECT coalesce(list(o ORDER BY sha256('k7|' || item_id || '|' || o))[1:k - 1], []) FROM (SELECT unnest(options) AS o) x WHERE o <> gold)) AS opts
    FROM brands CROSS JOIN (VALUES (2), (4), (8), (16)) v(k) WHERE len(options) >= k)) GROUP BY k""",
    "brands",
)
def a10_candidate_degradation(t: Tables) -> DataFrame:
    rows = probes.candidate_counts(t.brands, (2, 4, 8, 16), SEED)
    right = (_answer("m", F.col("options")) == F.col("gold")).cast("double")
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"))


_SAID = "CAST('0x' || substr(sha256('{salt}|' || item_id), 1, 8) AS BIGINT)"


@query(
    f"""SELECT round(avg(CASE WHEN {_SAID.format(salt='n')} % 3 = 0 THEN 1e0 ELSE 0e0 END), 6) AS detection,
    round(avg(CASE WHEN {_SAID.format(salt='b')} % 11 = 0 THEN 1e0 ELSE 0e0 END), 6) AS false_rejection, 'm' AS model FROM brands""",
    "brands",
)
def a11_abstention(t: Tables) -> DataFrame:
    """A stand-in model that sometimes denies all options, of plain items too."""
    said = lambda salt, n, id_, other: F.when(bucket(F.lit(salt), id_) % n == 0, "nota").otherwise(other)
    base = t.brands.select(F.lit("m").alias("model"), said("b", 11, "item_id", F.col("gold")).alias("content"))
    nota = probes.none_of_the_above(t.brands).select(F.lit("m").alias("model"), said("n", 3, "parent_id", F.lit("other")).alias("content"))
    return probes.abstention(base, nota, ["model"])


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, 'C' || lpad(CAST(event_id % 2000 AS VARCHAR), CAST(greatest(3, len(CAST(event_id % 2000 AS VARCHAR))) AS INTEGER), '0') AS id FROM events")
def x08_stamps_and_ids(t: Tables) -> DataFrame:
    """Times of events as stamps; numbers as claim ids."""
    return t.read("events").select("event_id", X.utc_stamp(F.col("ts").cast("timestamp")).alias("stamp"), X.claim_id((F.col("event_id") % 2000).cast("int")).alias("id"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def x12_json_field(t: Tables) -> DataFrame:
    return t.read("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT o_orderkey, CAST(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority) - 1 AS INTEGER) AS level FROM orders")
def x18_ordered_levels(t: Tables) -> DataFrame:
    levels = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    return t.read("orders").select("o_orderkey", F.coalesce(F.array_position(levels, F.col("o_orderpriority")) - 1, F.lit(-1)).cast("int").alias("level"))
