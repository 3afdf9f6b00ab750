"""Loaders, readers and writers through files (S): the tables at hand are written in a source's published shape and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.hashing import bucket
from ..operators import build as B
from ..operators import checks, items, metrics, sampling
from ..schema import faults
from ..sources import loaders, paged, readers, sinks
from ..sources.adapters import SEED, Tables
from ..sources.scratch import scratch_dir
from ..streaming import living
from . import base_sql as S
from .registry import query

LEVELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _lines(rows: DataFrame, path: str, broken: Column | None = None) -> str:
    """One JSON line for each row; where broken holds, one that ends early, behind the record's id if it begins with one."""
    text = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != "_k"]))
    begin = F.regexp_extract(text, r'^\{"protocolSection":\{"identificationModule":\{"nctId":"[^"]*"', 0)
    cut = F.when(begin != "", begin).otherwise(F.substring(text, 1, 12))
    rows.select((text if broken is None else F.when(broken, cut).otherwise(text)).alias("value")).write.mode("overwrite").text(path)
    return path


def _pick(values: list[str | None], key: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values)).cast("int"))


def _loaded_sql(source: str, template: str, frame: str, record: str, gold: str, tested: str, more: str = "") -> str:
    """template: a SQL expression."""
    split = f"CASE WHEN {tested} THEN 'test' WHEN {S.bucket(f'CAST({record} AS VARCHAR)')} % 10 = 0 THEN 'dev' ELSE 'train' END"
    return f"SELECT sha256('{source}|' || {record} || '|' || {template} || '|{SEED}') AS item_id, {split} AS split, {gold} AS gold{more} FROM {frame} WHERE {gold} IS NOT NULL"


_FOUR = "['ECONOMY', 'STANDARD', 'PROMO', 'LARGE']"
_FOUR_GOLD = f"CASE WHEN list_contains({_FOUR}, p_type) AND p_partkey % 50 <> 0 THEN p_type END"


@query(
    f"""SELECT item_id, split, gold, (SELECT string_agg(o, ',' ORDER BY sha256('{SEED}|' || item_id || '|' || o)) FROM (SELECT unnest(opts) AS o)) AS options
    FROM ({_loaded_sql("four_option", "'four_option'", "part", "p_partkey", _FOUR_GOLD, "p_partkey % 3 > 0", f", {_FOUR} AS opts")})"""
)
def s01_four_options(t: Tables) -> DataFrame:
    """Lines of multiple-choice questions; one in fifty ends early and is set aside."""
    choices = F.array(*[F.lit(v) for v in ("ECONOMY", "STANDARD", "PROMO", "LARGE")])
    k = F.col("p_partkey")
    rows = t.read("part").select(
        k.cast("string").alias("id"), F.col("p_name").alias("question"), choices.alias("choices"), (F.array_position(choices, F.col("p_type")) - 1).cast("int").alias("answer_idx"),
        _pick(["train", "validation", "test"], k).alias("split"), k.alias("_k"),
    )
    good, _ = readers.scan_choices(t.spark, _lines(rows, scratch_dir(t.spark, "choices"), F.col("_k") % 50 == 0))
    out = loaders.choice_items(good, "four_option", "four_option", SEED)
    return out.select("item_id", "split", "gold", F.array_join(F.transform("options", lambda o: o["key"]), ",").alias("options"))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE 'maybe' END"


@query(_loaded_sql("abstracts", "'answer'", "orders", "o_orderkey", _STATUS, "o_orderkey % 5 = 0", ", o_orderpriority || chr(10) || 'Is it done?' AS state"))
def s03_yes_no_maybe(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "no").otherwise("maybe")
    rows = t.read("orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.lit("Is it done?").alias("question"), F.col("o_orderpriority").alias("context"), status.alias("label"),
        F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train").alias("split"),
    )
    return loaders.labelled_items(rows, "abstracts", "answer", ("yes", "no", "maybe"), SEED).select("item_id", "split", "gold", "state")


_TYPES = ("ECONOMY", "STANDARD", "PROMO", "LARGE", "SMALL", "MEDIUM")


@query(_loaded_sql("subjects", "'subset' || (p_size % 6)", "part", "p_partkey", "p_type", "p_partkey % 3 = 0", ", 'subset' || (p_size % 6) AS template_id"))
def s04_subsets(t: Tables) -> DataFrame:
    """Six subsets, each a template."""
    choices, k = F.array(*[F.lit(v) for v in _TYPES]), F.col("p_partkey")
    rows = t.read("part").select(
        k.cast("string").alias("id"), F.col("p_name").alias("question"), choices.alias("choices"), (F.array_position(choices, F.col("p_type")) - 1).cast("int").alias("answer_idx"),
        F.when(k % 3 == 0, "test").otherwise("train").alias("split"), (F.col("p_size") % 6).alias("part"),
    )
    parts = {f"subset{i}": rows.filter(F.col("part") == i).drop("part") for i in range(6)}
    return loaders.subset_items(parts, "subjects", SEED).select("item_id", "template_id", "split", "gold")


_CLAIM = "CASE l_returnflag WHEN 'A' THEN 'support' WHEN 'R' THEN 'contradict' ELSE 'not enough' END"


@query(_loaded_sql("claims", "'verdict'", "lineitem", "(l_orderkey || '-' || l_linenumber)", _CLAIM, "l_orderkey % 4 = 0"))
def s05_claims(t: Tables) -> DataFrame:
    """Three-way verification; rows that share an id make items of one id."""
    flag = F.col("l_returnflag")
    rows = t.read("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.lit("Does the text support the claim?").alias("question"), F.lit("").alias("context"),
        F.when(flag == "A", "support").when(flag == "R", "contradict").otherwise("not enough").alias("label"), F.when(F.col("l_orderkey") % 4 == 0, "validation").otherwise("train").alias("split"),
    )
    return loaders.labelled_items(rows, "claims", "verdict", ("support", "contradict", "not enough"), SEED).select("item_id", "split", "gold")


_VERACITY: list[str | None] = ["true", "false", "mixture", "unproven", None]


@query(_loaded_sql("health", "'veracity'", "supplier", "s_suppkey", S.pick(_VERACITY, "s_suppkey"), "false", ", 'first' AS dataset_id, 'CC BY 4.0' AS license"))
def s06_licensed_sets(t: Tables) -> DataFrame:
    """Two sets of checked claims; the one without a licence is left out."""

    def load(table: str, key: str, name: str, licence: str | None) -> DataFrame:
        k = F.col(key)
        rows = t.read(table).select(k.cast("string").alias("id"), F.lit("Is it true?").alias("question"), F.lit("").alias("context"), _pick(_VERACITY, k).alias("label"), F.lit("train").alias("split"))
        return loaders.with_provenance(loaders.labelled_items(rows, "health", "veracity", ("true", "false", "mixture", "unproven"), SEED), name, "r1", licence)

    both = load("supplier", "s_suppkey", "first", "CC BY 4.0").unionByName(load("customer", "c_custkey", "second", None))
    return loaders.only_licensed(both).select("item_id", "split", "gold", "dataset_id", F.col("source_license").alias("license"))


def _pairs(t: Tables) -> DataFrame:
    """Queries, corpus and judgements as files; a judgement may lack its grade or its query."""
    root, k = scratch_dir(t.spark, "qrels"), F.col("doc_id")
    _lines(t.read("benchmark").select(F.col("item_id").cast("string").alias("_id"), "text"), f"{root}/queries")
    _lines(t.read("documents").select(k.cast("string").alias("_id"), F.concat(F.lit("Document "), k.cast("string")).alias("title"), "text"), f"{root}/corpus")
    judged = t.read("documents").select((k % 50).cast("string").alias("query-id"), k.cast("string").alias("corpus-id"), F.when(k % 10 != 9, k % 3).cast("string").alias("score"))
    judged.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{root}/qrels")
    return readers.scan_qrels(t.spark, f"{root}/queries", f"{root}/corpus", f"{root}/qrels")


_PAIRS = """(SELECT CAST(b.item_id AS VARCHAR) AS query_id, CAST(d.doc_id AS VARCHAR) AS doc_id, CAST(d.doc_id % 3 AS INTEGER) AS grade, b.text AS query, d.text
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 50 WHERE d.doc_id % 10 <> 9)"""


@query(f"SELECT query_id, doc_id, grade, length(query) AS query_chars, length(text) AS text_chars FROM {_PAIRS}")
def j10_qrels(t: Tables) -> DataFrame:
    return _pairs(t).select("query_id", "doc_id", "grade", F.length("query").cast("long").alias("query_chars"), F.length("text").cast("long").alias("text_chars"))


_GOLD = "CASE WHEN grade > 0 THEN 'yes' ELSE 'no' END"


@query(
    f"""SELECT sha256('rel|' || id || '|relevance|{SEED}') AS item_id, id AS source_record_id, gold, length(query) + 1 + length(text) AS chars FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, gold ORDER BY sha256('{SEED}|' || id), id) AS r FROM (SELECT *, {_GOLD} AS gold, query_id || ':' || doc_id AS id FROM {_PAIRS}))
    JOIN (SELECT query_id, min(n) AS least, count(*) AS labels FROM (SELECT query_id, {_GOLD} AS gold, count(*) AS n FROM {_PAIRS} GROUP BY ALL) GROUP BY query_id) USING (query_id)
    WHERE labels > 1 AND r <= least"""
)
def s07_relevance(t: Tables) -> DataFrame:
    """As many relevant documents as others for each query."""
    return loaders.relevance_items(_pairs(t), "rel", SEED).select("item_id", "source_record_id", "gold", F.length("state").cast("long").alias("chars"))


@query(_loaded_sql("routing", "'question_type'", "events", "event_id", "CASE WHEN event_type <> 'error' THEN event_type END", "event_id % 2 = 0"))
def s08_question_types(t: Tables) -> DataFrame:
    """Which type a question is of; a type that is not listed makes no item."""
    k = F.col("event_id")
    rows = t.read("events").select(k.cast("string").alias("id"), F.col("props").alias("question"), F.lit("").alias("context"), F.col("event_type").alias("label"), F.when(k % 2 == 0, "test").otherwise("train").alias("split"))
    return loaders.labelled_items(rows, "routing", "question_type", ("view", "click", "purchase", "signup"), SEED).select("item_id", "split", "gold")


def _study_lines(t: Tables) -> str:
    """Trials as the registry nests them; one line in fifty ends early."""
    date = lambda c: F.struct(F.col(c).cast("string").alias("date"))
    kinds = F.transform("intervention_types", lambda k: F.struct(k.alias("type")))
    section = F.struct(
        F.struct(F.col("nct_id").alias("nctId"), F.col("title").alias("briefTitle")).alias("identificationModule"),
        F.struct(date("first_posted").alias("studyFirstPostDateStruct"), date("last_updated").alias("lastUpdatePostDateStruct")).alias("statusModule"),
        F.struct(F.col("brief_summary").alias("briefSummary"), F.col("detailed_description").alias("detailedDescription")).alias("descriptionModule"),
        F.struct("conditions").alias("conditionsModule"),
        F.struct(F.when(F.col("phase").isNotNull(), F.array(F.replace("phase", F.lit("Phase "), F.lit("PHASE")))).alias("phases"), F.struct("allocation", F.col("primary_purpose").alias("primaryPurpose")).alias("designInfo")).alias("designModule"),
        F.struct(kinds.alias("interventions")).alias("armsInterventionsModule"), F.struct(F.col("healthy_volunteers").alias("healthyVolunteers")).alias("eligibilityModule"),
    )
    rows = t.trials.select(section.alias("protocolSection"), F.substring("nct_id", 4, 20).cast("long").alias("_k"))
    return _lines(rows, scratch_dir(t.spark, "studies"), F.col("_k") % 50 == 0)


_WHOLE = "CAST(substr(nct_id, 4) AS BIGINT) % 50 <> 0"


@query(
    f"""SELECT nct_id, title, brief_summary, phase, allocation, primary_purpose, coalesce(one_type, 'DRUG,DEVICE') AS kinds, healthy_volunteers,
    CAST(first_posted AS VARCHAR) AS first_posted, CAST(last_updated AS VARCHAR) AS last_updated FROM trials WHERE {_WHOLE}""",
    "trials",
)
def s10_trial_records(t: Tables) -> DataFrame:
    rows, _ = readers.scan_trials(t.spark, _study_lines(t))
    return rows.select(
        "nct_id", "title", "brief_summary", "phase", "allocation", "primary_purpose", F.array_join("intervention_types", ",").alias("kinds"), "healthy_volunteers",
        F.col("first_posted").cast("string").alias("first_posted"), F.col("last_updated").cast("string").alias("last_updated"),
    )


@query("""SELECT count(*) AS n, count(DISTINCT o_orderkey) AS records, max(len('{"protocolSection":{"identificationModule":{"nctId":"NCT' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || '"')) AS longest FROM orders WHERE o_orderkey % 50 = 0""")
def s10_trial_quarantine(t: Tables) -> DataFrame:
    """Lines that end early are set aside whole, so that their records can be asked for again."""
    _, bad = readers.scan_trials(t.spark, _study_lines(t))
    record = F.regexp_extract("_corrupt_record", '"nctId":"(NCT[0-9]+)"', 1)
    return bad.agg(F.count("*").alias("n"), F.count_distinct(F.when(record != "", record)).alias("records"), F.max(F.length("_corrupt_record")).alias("longest"))


#: Records of a captured page; one page in LOST was never captured.
PAGE, LOST = 100, 40


def _pages(t: Tables) -> str:
    """Trials as an interface hands them out, PAGE of them with each token; every LOST-th page is missing."""
    k = F.substring("nct_id", 4, 20).cast("long")
    page = F.floor(k / PAGE)
    rows = t.trials.select("nct_id", "phase", F.col("first_posted").cast("string").alias("first_posted"), page.alias("page"))
    last = rows.agg(F.max("page").alias("last"))  # one row
    each = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("nct_id", "phase", "first_posted"))).alias("records"))  # PAGE records
    token = lambda n: F.when(n == 0, "").otherwise(F.concat(F.lit("t"), F.lpad(n.cast("string"), 9, "0")))
    onward = F.when(F.col("page") < F.col("last"), token(F.col("page") + 1))
    body = F.to_json(F.struct("records", onward.alias("nextPageToken")))
    whole = each.crossJoin(F.broadcast(last)).filter((F.col("page") % LOST != LOST - 1) | (F.col("page") == F.col("last")))
    files = whole.select(F.concat(F.lit("page-"), token(F.col("page")), F.lit(".json")).alias("file"), body.alias("body"))
    return sinks.write_files(files, scratch_dir(t.spark, "pages"))


_PAGED = f"(SELECT *, CAST(substr(nct_id, 4) AS BIGINT) // {PAGE} AS page, max(CAST(substr(nct_id, 4) AS BIGINT) // {PAGE}) OVER () AS last FROM trials)"
_TOKEN = "CASE WHEN page = 0 THEN '' ELSE 't' || lpad(CAST(page AS VARCHAR), 9, '0') END"


@query(
    f"""SELECT {_TOKEN} AS token, nct_id, phase, CAST(first_posted AS VARCHAR) AS first_posted, false AS missing FROM {_PAGED} WHERE page % {LOST} <> {LOST - 1} OR page = last
    UNION ALL SELECT DISTINCT {_TOKEN}, NULL, NULL, NULL, true FROM {_PAGED} WHERE page % {LOST} = {LOST - 1} AND page <> last""",
    "trials",
)
def s10_paged_records(t: Tables) -> DataFrame:
    """Captured pages, read along their tokens; the read goes on behind a missing page and names it."""
    rows = paged.read_pages(t.spark, _pages(t))
    record = F.from_json("record", "nct_id string, phase string, first_posted string")
    return rows.select("token", record["nct_id"].alias("nct_id"), record["phase"].alias("phase"), record["first_posted"].alias("first_posted"), "missing")


@query("SELECT set_id, CAST(effective_date AS VARCHAR) AS effective_date, pharm_class, boxed_warning, route, s_ind AS indications, CASE WHEN boxed_warning IS NULL THEN 1 ELSE 2 END AS sections FROM drug_labels", "drug_labels")
def s11_label_records(t: Tables) -> DataFrame:
    rows = t.labels.select(
        "set_id", F.date_format("effective_date", "yyyyMMdd").alias("effective_time"), F.when(F.col("boxed_warning").isNotNull(), F.array("boxed_warning")).alias("boxed_warning"),
        F.array(F.col("sections")["indications"]).alias("indications_and_usage"), F.struct(F.col("pharm_class").alias("pharm_class_epc"), "route").alias("openfda"),
    )
    got, _ = readers.scan_labels(t.spark, _lines(rows, scratch_dir(t.spark, "labels")))
    return got.select(
        "set_id", F.col("effective_date").cast("string").alias("effective_date"), F.array_join("pharm_class", ",").alias("pharm_class"), "boxed_warning", F.array_join("route", ",").alias("route"),
        F.col("sections")["indications_and_usage"].alias("indications"), F.size("sections").alias("sections"),
    )


#: Records of a file, as in the public update files.
ARTICLES = 30_000


@query(
    f"""SELECT CAST(c_custkey AS VARCHAR) AS pmid, CAST(CAST(DATE '2024-01-01' + CAST(c_custkey % 366 AS INTEGER) AS DATE) AS VARCHAR) AS entry_date, c_name AS title, c_mktsegment || ' Nation ' || c_nationkey AS abstract,
    {S.pick(['case report', 'meta-analysis', 'letter'], 'c_custkey')} AS pub_types, 'Humans:false,' || c_mktsegment || ':A.' || c_mktsegment || ':true' AS mesh FROM customer"""
)
def s12_literature_records(t: Tables) -> DataFrame:
    """Records in the XML of the public update files; X14."""
    k = F.col("c_custkey")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 366).cast("int"))
    head = lambda name, major: F.struct(F.struct(name.alias("_VALUE"), F.lit(major).alias("_MajorTopicYN")).alias("DescriptorName"))
    kinds = F.array(_pick(["Case Report", "Meta-Analysis", "Letter"], k))
    article = F.struct(F.col("c_name").alias("ArticleTitle"), F.struct(F.array("c_mktsegment", F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string"))).alias("AbstractText")).alias("Abstract"), F.struct(kinds.alias("PublicationType")).alias("PublicationTypeList"))
    cite = F.struct(k.cast("string").alias("PMID"), article.alias("Article"), F.struct(F.array(head(F.lit("Humans"), "N"), head(F.col("c_mktsegment"), "Y")).alias("MeshHeading")).alias("MeshHeadingList"))
    seen = F.struct(F.lit("entrez").alias("_PubStatus"), F.year(day).alias("Year"), F.month(day).alias("Month"), F.day(day).alias("Day"))
    root = scratch_dir(t.spark, "articles")
    rows = t.read("customer").select(cite.alias("MedlineCitation"), F.struct(F.struct(F.array(seen).alias("PubMedPubDate")).alias("History")).alias("PubmedData"))
    files = -(-t.read("customer").count() // ARTICLES) or 1
    rows.repartition(files).write.mode("overwrite").format("xml").option("rootTag", "PubmedArticleSet").option("rowTag", "PubmedArticle").save(root)
    trees = t.read("customer").select(F.col("c_mktsegment").alias("name"), F.concat(F.lit("A."), F.col("c_mktsegment")).alias("tree")).distinct()
    got = readers.scan_pubmed(t.spark, root, trees)
    heads = F.transform("mesh", lambda m: F.concat_ws(":", m["name"], m["tree"], m["major"].cast("string")))
    return got.select("pmid", F.col("entry_date").cast("string").alias("entry_date"), "title", "abstract", F.array_join("pub_types", ",").alias("pub_types"), F.array_join(heads, ",").alias("mesh"))


_MAKERS = B.templates("trials", purposes=("TREATMENT", "PREVENTION", "DIAGNOSTIC"), kinds=("DRUG", "DEVICE", "BEHAVIORAL"))
_WINDOW = ("1997-01-01", "1997-12-31")
_BUILT = f"""(SELECT sha256('trials|' || nct_id || '|' || template_id || '|{SEED}') AS item_id, template_id, gold, CAST(first_posted AS VARCHAR) AS record_date FROM (
  SELECT nct_id, first_posted, unnest(['trial_phase', 'trial_allocation', 'trial_purpose', 'trial_intervention', 'trial_healthy']) AS template_id,
    unnest([phase, CASE WHEN allocation = 'RANDOMIZED' THEN 'yes' WHEN allocation IS NOT NULL THEN 'no' END, primary_purpose, one_type, CASE WHEN healthy_volunteers THEN 'yes' WHEN NOT healthy_volunteers THEN 'no' END]) AS gold
  FROM trials WHERE first_posted BETWEEN DATE '{_WINDOW[0]}' AND DATE '{_WINDOW[1]}') WHERE gold IS NOT NULL)"""


@query(f"SELECT * FROM {_BUILT}", "trials")
def s13_build(t: Tables) -> DataFrame:
    out = B.build(t.trials, "trials", *_WINDOW, SEED, _MAKERS)
    return out.select("item_id", "template_id", "gold", F.col("record_date").cast("string").alias("record_date"))


_PREFIXED = f"(SELECT template_id, {S.prefix('sha256(item_id)', _BUILT)} AS p, sha256(string_agg(sha256(item_id), '' ORDER BY sha256(item_id))) AS h FROM {_BUILT} GROUP BY ALL)"


@query(f"SELECT template_id, sha256(string_agg(h, '' ORDER BY p)) AS sha256, true AS same FROM {_PREFIXED} GROUP BY template_id", "trials")
def s13_rebuild_hash(t: Tables) -> DataFrame:
    """A build and a second one, whose records stand on other partitions, have one hash for each template."""
    make = lambda records: checks.content_hash(B.build(records, "trials", *_WINDOW, SEED, _MAKERS), ["template_id"], "item_id")
    first, again = make(t.trials), make(t.trials.repartition(7, "allocation")).withColumnRenamed("sha256", "again")
    return first.join(again, "template_id", "full").select("template_id", "sha256", F.coalesce(F.col("sha256") == F.col("again"), F.lit(False)).alias("same"))


@query(f"SELECT template_id, sha256(string_agg(h, '' ORDER BY p)) AS sha256 FROM {_PREFIXED} GROUP BY template_id", "trials")
def s13_living_build(t: Tables) -> DataFrame:
    """Two landings of records, the later dates first, a landing that repeats some of them, and a batch that is run again: the items are those of one build."""
    root = scratch_dir(t.spark, "living")
    k = F.substring("nct_id", 4, 20).cast("long")
    landing, store = f"{root}/landing", f"{root}/store"
    for number, part in enumerate((k % 2 == 1, (k % 2 == 0) | (k % 10 == 1), k % 7 == 0)):
        t.trials.filter(part).write.json(f"{landing}/{number}")
        living.land(t.spark, f"{landing}/*", readers.TRIALS, store, f"{root}/progress").awaitTermination()
    # A checkpoint that is lost: everything lands again, under numbers that are taken.
    living.land(t.spark, f"{landing}/*", readers.TRIALS, store, f"{root}/again").awaitTermination()
    items_ = living.rebuild(t.spark, store, readers.TRIALS, lambda r: B.build(r, "trials", *_WINDOW, SEED, _MAKERS))
    return checks.content_hash(items_, ["template_id"], "item_id")


_LABEL_MAKERS = B.templates("labels", routes=("ECONOMY", "STANDARD", "PROMO"))
_LABEL_WINDOW = ("2023-06-01", "2024-05-31")


@query(
    f"""SELECT sha256('labels|' || set_id || '|' || template_id || '|{SEED}') AS item_id, template_id, gold, CAST(effective_date AS VARCHAR) AS record_date FROM (
    SELECT set_id, effective_date, unnest(['label_class', 'label_boxed', 'label_route']) AS template_id, unnest([pharm_class, CASE WHEN boxed_warning IS NULL THEN 'no' ELSE 'yes' END, route]) AS gold
    FROM drug_labels WHERE effective_date BETWEEN DATE '{_LABEL_WINDOW[0]}' AND DATE '{_LABEL_WINDOW[1]}') WHERE gold IS NOT NULL""",
    "drug_labels",
)
def s13_build_labels(t: Tables) -> DataFrame:
    out = B.build(t.labels, "labels", *_LABEL_WINDOW, SEED, _LABEL_MAKERS)
    return out.select("item_id", "template_id", "gold", F.col("record_date").cast("string").alias("record_date"))


_PAPER_WINDOW = ("2024-03-01", "2024-08-31")


@query(
    f"""SELECT sha256('pubmed|' || pmid || '|' || template_id || '|{SEED}') AS item_id, template_id, gold, CAST(entry_date AS VARCHAR) AS record_date FROM (
    SELECT pmid, entry_date, unnest(['paper_type', 'paper_humans', 'paper_topic']) AS template_id,
      unnest([CASE pub WHEN 0 THEN 'case report' WHEN 1 THEN 'randomized controlled trial' WHEN 2 THEN 'meta-analysis' ELSE 'other' END, CASE tag WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END, topic]) AS gold
    FROM papers WHERE entry_date BETWEEN DATE '{_PAPER_WINDOW[0]}' AND DATE '{_PAPER_WINDOW[1]}') WHERE gold IS NOT NULL""",
    "papers",
)
def s13_build_papers(t: Tables) -> DataFrame:
    out = B.build(t.papers, "pubmed", *_PAPER_WINDOW, SEED, B.templates("pubmed"))
    return out.select("item_id", "template_id", "gold", F.col("record_date").cast("string").alias("record_date"))


_RECORD = "CAST(substr(nct_id, 4) AS BIGINT)"
_PHASES = f"(SELECT sha256('trials|' || nct_id || '|trial_phase|{SEED}') AS item_id, {_RECORD} % 20 AS k, phase AS gold FROM trials WHERE phase IS NOT NULL)"


@query(f"SELECT CASE WHEN k <> 3 THEN item_id END AS item_id, CASE k WHEN 3 THEN 'malformed' WHEN 7 THEN 'gold' WHEN 9 THEN 'tier' ELSE '' END AS why FROM {_PHASES}", "trials")
def s14_read_items(t: Tables) -> DataFrame:
    """Items read with validation: what is broken or faulty is set aside with the reason."""
    k = F.substring("source_record_id", 4, 20).cast("long") % 20
    rows = items.trial_phase(t.trials, SEED).withColumn("_k", k)
    rows = rows.withColumns({"gold": F.when(F.col("_k") == 7, "zzz").otherwise(F.col("gold")), "tier": F.when(F.col("_k") == 9, "old").otherwise(F.col("tier"))})
    good, bad = readers.read_items(t.spark, _lines(rows, scratch_dir(t.spark, "items"), F.col("_k") == 3))
    return good.select("item_id", F.lit("").alias("why")).unionByName(bad.select(F.when(F.col("why") != "malformed", F.get_json_object("record", "$.item_id")).alias("item_id"), "why"))


@query(f"SELECT item_id, gold FROM {_PHASES}", "trials")
def s15_write_items(t: Tables) -> DataFrame:
    root = scratch_dir(t.spark, "written")
    sinks.write_items(items.trial_phase(t.trials, SEED), root)
    return readers.read_items(t.spark, root)[0].select("item_id", "gold")


@query(
    """SELECT 'source=' || source || '/part=' || p AS file, sum(len(item_id) + 1)::BIGINT AS bytes, sha256(string_agg(item_id || chr(10), '' ORDER BY item_id)) AS sha256, p = '7' AS changed
    FROM (SELECT source, item_id, substr(item_id, 1, 1) AS p FROM items) GROUP BY ALL""",
    "items",
)
def a13_file_hashes(t: Tables) -> DataFrame:
    """Size and SHA-256 of each file that a sink wrote; files that changed since the manifest are named."""
    root = scratch_dir(t.spark, "files")
    rows = t.items.select("item_id", "source", F.substring("item_id", 1, 1).alias("part"))
    write = lambda some, at: some.repartition("source", "part").sortWithinPartitions("source", "part", "item_id").write.partitionBy("source", "part").mode("overwrite").text(at)
    write(rows, f"{root}/first")
    write(rows.withColumn("item_id", F.when(F.col("part") == "7", F.upper("item_id")).otherwise(F.col("item_id"))), f"{root}/second")
    folder = lambda at: checks.file_manifest(t.spark, at).withColumn("file", F.regexp_replace("file", "/[^/]*$", ""))
    told = folder(f"{root}/first")
    changed = checks.changed_files(told, folder(f"{root}/second")).select("file", F.lit(True).alias("changed"))
    return told.join(changed, "file", "left").select("file", "bytes", "sha256", F.coalesce("changed", F.lit(False)).alias("changed"))


@query("SELECT model, source, count(*) AS n, round(avg(CASE WHEN gold_index = 0 THEN p ELSE 1e0 - p END), 6) AS mean FROM scored GROUP BY ALL", "scored")
def s16_write_predictions(t: Tables) -> DataFrame:
    """Predictions by model and source, read again."""
    root = scratch_dir(t.spark, "predictions")
    sinks.write_predictions(t.scored.select("item_id", "model", "source", "probs"), root)
    return t.spark.read.parquet(root).groupBy("model", "source").agg(F.count("*").alias("n"), F.round(F.avg(F.get("probs", F.lit(0))), 6).alias("mean"))


@query(f"SELECT model, template_id, count(*) AS n, round({S.share('ok')}, 6) AS accuracy FROM scored GROUP BY ALL", "scored")
def s17_write_summary(t: Tables) -> DataFrame:
    root = scratch_dir(t.spark, "summary")
    sinks.write_summary(metrics.accuracy(t.scored, ["model", "template_id"]), root)
    return t.spark.read.schema("model string, template_id string, n long, accuracy double").json(root)


@query(
    """SELECT 0 AS pos, '| model | template_id | n |' AS line UNION ALL SELECT 1, '| --- | --- | --- |'
    UNION ALL SELECT 1 + row_number() OVER (ORDER BY model, template_id), '| ' || model || ' | ' || template_id || ' | ' || count(*) || ' |' FROM scored GROUP BY model, template_id""",
    "scored",
)
def s18_markdown(t: Tables) -> DataFrame:
    rows = t.scored.groupBy("model", "template_id").agg(F.count("*").alias("n")).orderBy("model", "template_id")
    return t.spark.createDataFrame(list(enumerate(sinks.to_markdown(rows).splitlines())), "pos long, line string")


_TURN = f"(SELECT *, row_number() OVER (PARTITION BY source, template_id ORDER BY sha256('{SEED}|' || item_id), item_id) AS turn FROM items WHERE split = 'test')"
_SAMPLE = f"(SELECT *, {S.bucket(chr(39) + 'verdict' + chr(39), 'item_id')} % 10 AS h FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn, template_id, item_id) AS pick FROM {_TURN}) WHERE pick <= 50)"


@query(f"SELECT source, count(*) AS n, count(CASE WHEN h > 2 THEN 1 END) AS accepted, count(CASE WHEN h = 0 THEN 1 END) AS rejected, count(CASE WHEN h IN (1, 2) THEN 1 END) AS pending FROM {_SAMPLE} GROUP BY source", "items")
def s20_audit_files(t: Tables) -> DataFrame:
    """The sample as it is exported, and the verdicts that came back; some lines are broken, so their items wait."""
    root = scratch_dir(t.spark, "audit")
    sinks.write_audit(sampling.stratified(t.items.filter("split = 'test'"), "source", "template_id", 50, SEED), f"{root}/sample")
    sample = t.spark.read.schema("item_id string, template_id string, source string, gold string").json(f"{root}/sample")
    h = bucket(F.lit("verdict"), "item_id") % 10
    said = sample.select("item_id", F.when(h == 0, "R").otherwise("A").alias("verdict"), h.alias("_k")).filter("_k <> 1")
    verdicts, _ = readers.read_verdicts(t.spark, _lines(said, f"{root}/verdicts", F.col("_k") == 2))
    told = lambda v: F.count(F.when(v, 1))
    v = F.col("verdict")
    return sample.join(verdicts.select("item_id", "verdict"), "item_id", "left").groupBy("source").agg(F.count("*").alias("n"), told(v == "A").alias("accepted"), told(v == "R").alias("rejected"), told(v.isNull()).alias("pending"))


_TOKENS = S.bucket("'tok'", "item_id")


@query(
    f"""SELECT mode, count(*) AS n, round(avg(tokens), 6) AS tokens_per_item, round(count(*) / sum(seconds) * 3600, 4) AS items_per_hour, round(avg(seconds), 6) AS seconds_per_item FROM (
    SELECT CASE WHEN h % 2 = 0 THEN 'short' ELSE 'long' END AS mode, h % 100 + 1 AS tokens, CAST(h % 64 + 1 AS DOUBLE) / 8 AS seconds FROM (SELECT {_TOKENS} AS h FROM items) WHERE h % 50 <> 0) GROUP BY mode""",
    "items",
)
def s23_teacher_throughput(t: Tables) -> DataFrame:
    """Captured teacher outputs and their rates."""
    h = bucket(F.lit("tok"), "item_id")
    rows = t.items.select(
        "item_id", F.when(h % 2 == 0, "short").otherwise("long").alias("mode"), F.create_map(F.lit("A"), F.lit(0.6)).alias("topk"), (h % 100 + 1).cast("int").alias("output_tokens"),
        ((h % 64 + 1).cast("double") / 8).alias("seconds"), h.alias("_k"),
    )
    got, _ = readers.scan_teacher(t.spark, _lines(rows, scratch_dir(t.spark, "teacher"), F.col("_k") % 50 == 0))
    return got.groupBy("mode").agg(
        F.count("*").alias("n"), F.round(F.avg("output_tokens"), 6).alias("tokens_per_item"), F.round(F.count("*") / F.sum("seconds") * 3600, 4).alias("items_per_hour"), F.round(F.avg("seconds"), 6).alias("seconds_per_item")
    )


def _page(t: Tables) -> str:
    """A Markdown page with the nations' names in a fenced block."""
    root = scratch_dir(t.spark, "page")
    names = F.array_join(F.array_sort(F.collect_list("n_name")), "\n")  # 25 names
    page = F.concat(F.lit("# Other\n```\nno\n```\n## Names\n```text\n"), names, F.lit("\n```\n"))
    t.read("nation").agg(page.alias("value")).write.mode("overwrite").text(root)
    return root


@query("SELECT n_name AS line FROM nation")
def s26_fenced_block(t: Tables) -> DataFrame:
    return readers.fenced_block(t.spark, _page(t), "Names").select(F.explode(F.split("block", "\n")).alias("line")).filter("line <> ''")


@query("SELECT w AS literal, EXISTS (SELECT 1 FROM nation WHERE contains(n_name, w)) AS found FROM (VALUES ('BRAZIL'), ('ATLANTIS'), ('NATION_1')) v(w)")
def s27_status_scan(t: Tables) -> DataFrame:
    """is a literal in the file."""
    page = _page(t)
    return t.spark.createDataFrame([(w, readers.has_line(t.spark, page, w)) for w in ("BRAZIL", "ATLANTIS", "NATION_1")], "literal string, found boolean")


@query("SELECT n_nationkey, printf('session_%03d.log', n_nationkey) AS name FROM nation")
def s28_session_logs(t: Tables) -> DataFrame:
    return t.read("nation").select("n_nationkey", X.session_log(F.col("n_nationkey")).alias("name"))


@query(
    """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 13 = 0 THEN 'state' END, CASE WHEN o_orderkey % 11 = 0 THEN 'gold' END, CASE WHEN o_orderkey % 7 = 0 THEN 'levels' END) AS faults FROM orders"""
)
def f08_rules(t: Tables) -> DataFrame:
    """Which rules a graded item breaks: a state, a gold among its options, two levels at least."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    rows = t.read("orders").select(
        "o_orderkey", k.cast("string").alias("item_id"), F.lit("fresh").alias("tier"), F.lit("test").alias("split"), F.lit("score").alias("qtype"), F.when(k % 13 != 0, p).alias("state"),
        F.when(k % 7 == 0, items.options_of(F.array(p))).otherwise(items.fixed_options(*LEVELS)).alias("options"), F.when(k % 11 == 0, "none").otherwise(p).alias("gold"),
    )
    return rows.select("o_orderkey", F.array_join(faults(), ",").alias("faults"))
