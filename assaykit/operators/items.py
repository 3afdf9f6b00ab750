"""Item templates: a structured record becomes a typed question whose gold is one of its fields.

The field that holds the answer never reaches the state, and an answer spelled out in the state
is taken out of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bucket, hash_order, stable_id
from ..functions.text import without
from .prefix import running_totals, same

YES_NO = ("yes", "no")


def options_of(labels: Column) -> Column:
    """An array of strings as options; a label is its own key."""
    return F.transform(labels, lambda v: F.struct(v.alias("key"), v.alias("label"), F.lit(None).cast("string").alias("description")))


def fixed_options(*labels: str) -> Column:
    return options_of(F.array(*[F.lit(v) for v in labels]))


def as_items(
    records: DataFrame, *, source: str, record_id: Column, record_date: Column, template: str, qtype: str, state: Column, question: str,
    options: Column, gold: Column, seed: int, tier: str = "fresh", skill: str = "reading", license_: str = "UNKNOWN", split: Column | None = None,
) -> DataFrame:
    """Records with a gold become items; choices are put in a seeded order, levels keep theirs.

    split: where a record goes by its own columns; by a hash of its id if not given. One row makes
    one item at most, so rows repeated make items of one id; a null gold makes none.
    """
    given = F.lit(None).cast("string") if split is None else split
    rows = records.select(
        F.lit(tier).alias("tier"), F.lit(source).alias("source"), record_id.cast("string").alias("source_record_id"),
        F.lit(None).cast("string").alias("source_url"), F.lit(license_).alias("source_license"), record_date.cast("date").alias("record_date"),
        F.lit(template).alias("template_id"), F.lit(skill).alias("skill"), F.lit(qtype).alias("qtype"), state.alias("state"),
        F.lit(question).alias("question"), options.alias("options"), gold.alias("gold"), given.alias("split"),
    ).filter(F.col("gold").isNotNull())
    rows = rows.withColumn("item_id", stable_id("source", "source_record_id", "template_id", F.lit(str(seed))))
    if qtype == "choice":
        rows = rows.withColumn("options", hash_order("options", F.lit(str(seed)), F.col("item_id")))
    rows = rows.withColumn("split", F.coalesce("split", F.when(bucket("source_record_id") % 5 == 0, "dev").otherwise("test")))
    return rows.withColumn("meta", F.create_map(F.lit("seed"), F.lit(str(seed))))


def _joined(*parts: str) -> Column:
    return F.concat_ws("\n", *parts)


TRIAL_STATE = ("brief_summary", "detailed_description")


def _trial(records: DataFrame, template: str, qtype: str, question: str, options: Column, gold: Column, seed: int, state: Column | None = None) -> DataFrame:
    state = _joined(*TRIAL_STATE) if state is None else state
    return as_items(
        records, source="trials", record_id=F.col("nct_id"), record_date=F.col("first_posted"), template=template, qtype=qtype,
        state=without(without(state, F.coalesce("title", F.lit(""))), gold) if qtype == "choice" else without(state, F.coalesce("title", F.lit(""))),
        question=question, options=options, gold=gold, seed=seed,
    )


def trial_phase(records: DataFrame, seed: int) -> DataFrame:
    return _trial(records, "trial_phase", "choice", "Which phase is this trial?", fixed_options("Phase 1", "Phase 2", "Phase 3", "Phase 4"), F.col("phase"), seed)


def trial_allocation(records: DataFrame, seed: int) -> DataFrame:
    gold = F.when(F.col("allocation") == "RANDOMIZED", "yes").when(F.col("allocation").isNotNull(), "no")
    return _trial(records, "trial_allocation", "noul", "Is allocation randomised?", fixed_options(*YES_NO), gold, seed)


def trial_purpose(records: DataFrame, seed: int, purposes: tuple[str, ...]) -> DataFrame:
    return _trial(records, "trial_purpose", "choice", "What is the primary purpose?", fixed_options(*purposes), F.col("primary_purpose"), seed)


def trial_intervention(records: DataFrame, seed: int, kinds: tuple[str, ...]) -> DataFrame:
    """Only records of one intervention type have a single answer."""
    gold = F.when(F.size("intervention_types") == 1, F.element_at("intervention_types", 1))
    return _trial(records, "trial_intervention", "choice", "Which type of intervention is studied?", fixed_options(*kinds), gold, seed)


def trial_healthy(records: DataFrame, seed: int) -> DataFrame:
    """The state is condition and summary; the eligibility text would tell."""
    gold = F.when(F.col("healthy_volunteers"), "yes").when(~F.col("healthy_volunteers"), "no")
    state = F.concat_ws("\n", F.array_join("conditions", ", "), F.col("brief_summary"))
    return _trial(records, "trial_healthy", "noul", "Are healthy volunteers accepted?", fixed_options(*YES_NO), gold, seed, state)


def _sections(but: str) -> Column:
    kept = F.map_filter("sections", lambda k, _: k != but)
    return F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: e["value"]), "\n")


def _label(records: DataFrame, template: str, qtype: str, question: str, options: Column, gold: Column, seed: int, section: str) -> DataFrame:
    return as_items(
        records, source="labels", record_id=F.col("set_id"), record_date=F.col("effective_date"), template=template, qtype=qtype,
        state=without(_sections(section), gold) if qtype == "choice" else _sections(section), question=question, options=options, gold=gold, seed=seed,
    )


def ring_distractors(records: DataFrame, id_: str, gold: str, by: list[str], others: int, seed: int) -> DataFrame:
    """records with others: up to so many golds of other records of the same `by`.

    The distinct golds of a group stand on a ring in the order of their seeded hashes. A record visits
    others + 1 places, a start and a step of its own, and leaves its own gold out; the places are joined
    to the ring, so no record sees a whole vocabulary. Golds are kept from records without an id or gold.
    """
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), "_value"), 256), 1, 15), 16, 10).cast("long")
    values = records.filter(F.col(gold).isNotNull()).select(*by, F.col(gold).alias("_value")).distinct().withColumn("_h", h)
    ring = running_totals(values.withColumn("_one", F.lit(1)), by, "_h", {"_place": "_one"}).select(*by, "_value", F.col("_place").cast("long").alias("_place"))
    sizes = values.groupBy(*by).agg(F.count("*").alias("_n"))
    asked = same(records.select(*by, id_, gold).filter(F.col(gold).isNotNull()).distinct(), sizes, by)
    start, widest = bucket(F.lit(str(seed)), F.lit("start"), id_) % F.col("_n"), F.greatest(F.floor((F.col("_n") - 1) / others), F.lit(1))
    step = 1 + bucket(F.lit(str(seed)), F.lit("step"), id_) % widest
    visits = F.transform(F.sequence(F.lit(0), F.lit(others)), lambda i: F.struct(((start + i * step) % F.col("_n")).cast("long").alias("_place"), i.alias("_turn")))
    met = same(asked.select(*by, id_, gold, F.inline(visits)), ring, [*by, "_place"]).filter(F.col("_value") != F.col(gold))
    first = met.groupBy(*by, id_, gold, "_value").agg(F.min("_turn").alias("_turn"))
    drawn = first.groupBy(*by, id_, gold).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("_turn", "_value"))), lambda r: r["_value"]), 1, others).alias("others"))
    return same(records, drawn, [*by, id_, gold], "left").withColumn("others", F.coalesce("others", F.array().cast("array<string>")))


def label_class(records: DataFrame, seed: int, others: int = 3) -> DataFrame:
    """Distractors are other classes of the same build. A record without a class, or with an empty list of them, has no item."""
    rows = ring_distractors(records.withColumn("_gold", F.get("pharm_class", F.lit(0))), "set_id", "_gold", [], others, seed)
    return _label(rows, "label_class", "choice", "Which class does this drug belong to?", options_of(F.concat(F.array("_gold"), "others")), F.col("_gold"), seed, "class")


def label_boxed(records: DataFrame, seed: int) -> DataFrame:
    gold = F.when(F.col("boxed_warning").isNotNull(), "yes").otherwise("no")
    return _label(records, "label_boxed", "noul", "Does it carry a boxed warning?", fixed_options(*YES_NO), gold, seed, "boxed_warning")


def label_route(records: DataFrame, seed: int, routes: tuple[str, ...]) -> DataFrame:
    gold = F.when(F.size("route") == 1, F.element_at("route", 1))
    return _label(records, "label_route", "choice", "How is it given?", fixed_options(*routes), gold, seed, "route")


#: Publication types from the most to the least specific; the first that a record has is its answer.
PUBLICATION = ("meta-analysis", "systematic review", "randomized controlled trial", "case report", "observational")


def _paper(records: DataFrame, template: str, qtype: str, question: str, options: Column, gold: Column, seed: int) -> DataFrame:
    return as_items(
        records, source="pubmed", record_id=F.col("pmid"), record_date=F.col("entry_date"), template=template, qtype=qtype,
        state=_joined("title", "abstract"), question=question, options=options, gold=gold, seed=seed,
    )


def paper_type(records: DataFrame, seed: int) -> DataFrame:
    gold = F.lit("other")
    for kind in reversed(PUBLICATION):
        gold = F.when(F.array_contains("pub_types", kind), kind).otherwise(gold)
    return _paper(records, "paper_type", "choice", "What type of publication is this?", fixed_options(*PUBLICATION, "other"), gold, seed)


def paper_humans(records: DataFrame, seed: int) -> DataFrame:
    """Records with both check tags, or neither, have no answer."""
    names = F.transform("mesh", lambda m: m["name"])
    people, animals = F.array_contains(names, "Humans"), F.array_contains(names, "Animals")
    return _paper(records, "paper_humans", "noul", "Does it study humans?", fixed_options(*YES_NO), F.when(people & ~animals, "yes").when(animals & ~people, "no"), seed)


def paper_topic(records: DataFrame, seed: int, others: int = 3) -> DataFrame:
    """The first major topic; distractors are topics of its level of the tree."""
    first = F.get(F.filter("mesh", lambda m: m["major"]), F.lit(0))
    rows = records.withColumn("_first", first).filter("_first is not null").withColumn("_topic", F.col("_first.name")).withColumn("_level", F.size(F.split(F.col("_first.tree"), r"\.")))
    rows = ring_distractors(rows, "pmid", "_topic", ["_level"], others, seed)
    return _paper(rows, "paper_topic", "choice", "Which is its major topic?", options_of(F.concat(F.array("_topic"), "others")), F.col("_topic"), seed)
