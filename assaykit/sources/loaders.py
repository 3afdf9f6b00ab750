"""Public question sets as items, each keeping its official split, revision and licence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import bucket
from ..operators.items import as_items, fixed_options, options_of
from ..operators.sampling import balanced


def with_provenance(items: DataFrame, dataset_id: str, revision: str, license_: str | None) -> DataFrame:
    return items.withColumns({"dataset_id": F.lit(dataset_id), "revision": F.lit(revision), "source_license": F.coalesce(F.lit(license_).cast("string"), F.lit("UNKNOWN"))})


def join_provenance(items: DataFrame, table: DataFrame, by: str) -> DataFrame:
    """items with dataset_id, revision and source_license of a table with one row for each `by`; what it lacks, or says nothing of, is UNKNOWN."""
    names = ("dataset_id", "revision", "license")
    told = table.select(F.col(by).alias("_by"), *(F.col(n).alias(f"_{n}") for n in names))
    rows = items.drop("dataset_id", "revision", "source_license").join(told, F.col(by).eqNullSafe(F.col("_by")), "left")
    known = {("source_license" if n == "license" else n): F.coalesce(F.col(f"_{n}"), F.lit("UNKNOWN")) for n in names}
    return rows.withColumns(known).drop("_by", *(f"_{n}" for n in names))


def only_licensed(items: DataFrame) -> DataFrame:
    return items.filter(F.col("source_license") != "UNKNOWN")


def _split(official: Column, record: Column, carve: int) -> Column:
    """Validation stands in for a test split without public labels; one in `carve` train records becomes dev."""
    return F.when(official.isin("validation", "test"), "test").when(bucket(record) % carve == 0, "dev").otherwise("train")


def choice_items(rows: DataFrame, source: str, template: str, seed: int, carve: int = 10) -> DataFrame:
    """id, question, choices, answer_idx, split -> choice items, one for each row whose answer is one of its choices.

    A record whose id stands in several official splits is a test record in all its rows, so that
    none is trained on (its rows meet by id); a null id, choice or answer makes no item.
    """
    rows = rows.filter("id is not null")
    tested = F.max(F.col("split").isin("validation", "test")).over(Window.partitionBy("id"))
    rows = rows.withColumn("_official", F.when(tested, "test").otherwise(F.col("split")))
    return as_items(
        rows, source=source, record_id=F.col("id"), record_date=F.lit(None).cast("date"), template=template, qtype="choice",
        state=F.col("question"), question="", options=options_of(F.col("choices")), gold=F.get("choices", F.col("answer_idx")), seed=seed, tier="established",
        split=_split(F.col("_official"), F.col("id").cast("string"), carve),
    )


def labelled_items(rows: DataFrame, source: str, template: str, labels: tuple[str, ...], seed: int) -> DataFrame:
    """id, question, context, label, split -> choice items over fixed labels (yes/no/maybe, support/contradict/not enough, question types)."""
    choices = F.array(*[F.lit(v) for v in labels])
    text = F.concat_ws("\n", "context", "question")
    ready = rows.select("id", text.alias("question"), choices.alias("choices"), (F.array_position(choices, F.col("label")) - 1).cast("int").alias("answer_idx"), "split")
    return choice_items(ready, source, template, seed)


def subset_items(parts: dict[str, DataFrame], source: str, seed: int) -> DataFrame:
    """Subsets of one question set; each is a template."""
    out = None
    for name, rows in sorted(parts.items()):
        one = choice_items(rows, source, name, seed)
        out = one if out is None else out.unionByName(one)
    return out


def relevance_items(pairs: DataFrame, source: str, seed: int) -> DataFrame:
    """query_id, doc_id, grade, query, text -> yes/no items, as many relevant as not for each query."""
    rows = pairs.withColumn("_gold", F.when(F.col("grade") > 0, "yes").otherwise("no")).withColumn("_id", F.concat_ws(":", "query_id", "doc_id"))
    rows = balanced(rows, ["query_id"], "_gold", seed, "_id")
    return as_items(
        rows, source=source, record_id=F.col("_id"), record_date=F.lit(None).cast("date"), template="relevance", qtype="noul", state=F.concat_ws("\n", "query", "text"),
        question="Is the document relevant to the query?", options=fixed_options("yes", "no"), gold=F.col("_gold"), seed=seed, tier="established",
    )


def graded_items(pairs: DataFrame, levels: tuple[str, ...], source: str, seed: int) -> DataFrame:
    """query_id, doc_id, grade (one of the levels, lowest first) -> score items; pairs without a grade have none."""
    grade = F.col("grade").cast("string")
    return as_items(
        pairs, source=source, record_id=F.concat_ws(":", "query_id", "doc_id"), record_date=F.lit(None).cast("date"), template="graded", qtype="score",
        state=F.concat_ws("\n", *[c for c in ("query", "text") if c in pairs.columns]), question="How relevant is the document?", options=fixed_options(*levels),
        gold=F.when(grade.isin(*levels), grade), seed=seed, tier="established",
    )
