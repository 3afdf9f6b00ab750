"""Readers with explicit schemas; malformed rows are set aside, never dropped in silence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prefix import same
from ..schema import ITEM, TEACHER, VERDICT, faults

TRIALS = """nct_id string, title string, brief_summary string, detailed_description string, conditions array<string>, phase string,
 allocation string, primary_purpose string, intervention_types array<string>, healthy_volunteers boolean, eligibility_text string,
 first_posted date, last_updated date"""
LABELS = "set_id string, effective_date date, sections map<string,string>, pharm_class array<string>, boxed_warning string, route array<string>"
PUBMED = "pmid string, entry_date date, title string, abstract string, pub_types array<string>, mesh array<struct<name:string,tree:string,major:boolean>>"
CHOICES = "id string, question string, choices array<string>, answer_idx int, split string"


def scan_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, lines that do not fit the schema)."""
    full = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    fits = F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()
    return rows.filter(fits).select("r.*").drop("_corrupt_record"), rows.filter(~fits).select(F.col("value").alias("_corrupt_record"))


#: Fields of a trial record in the registry's public interface, second version (fixed names).
STUDY = """protocolSection struct<
 identificationModule:struct<nctId:string,briefTitle:string>,
 statusModule:struct<studyFirstPostDateStruct:struct<date:string>,lastUpdatePostDateStruct:struct<date:string>>,
 descriptionModule:struct<briefSummary:string,detailedDescription:string>,
 conditionsModule:struct<conditions:array<string>>,
 designModule:struct<phases:array<string>,designInfo:struct<allocation:string,primaryPurpose:string>>,
 armsInterventionsModule:struct<interventions:array<struct<type:string>>>,
 eligibilityModule:struct<eligibilityCriteria:string,healthyVolunteers:boolean>>"""
#: Fields of a drug label in the public label interface (fixed names).
SPL = """set_id string, effective_time string, boxed_warning array<string>, indications_and_usage array<string>, warnings array<string>,
 adverse_reactions array<string>, dosage_and_administration array<string>, description array<string>,
 openfda struct<pharm_class_epc:array<string>,route:array<string>>"""
SECTIONS = ("boxed_warning", "indications_and_usage", "warnings", "adverse_reactions", "dosage_and_administration", "description")


def scan_trials(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(trial records in the normalised schema, lines that are none).

    A record of several phases, or of none, has a null phase; a first or last date that is no
    whole day is null.
    """
    raw, bad = scan_json(spark, path, STUDY)
    p = "protocolSection"
    design, status = f"{p}.designModule", f"{p}.statusModule"
    phase = F.when(F.size(f"{design}.phases") == 1, F.regexp_replace(F.get(f"{design}.phases", F.lit(0)), "^PHASE([0-9])$", "Phase $1"))
    kinds = F.array_distinct(F.transform(f"{p}.armsInterventionsModule.interventions", lambda i: i["type"]))
    rows = raw.select(
        F.col(f"{p}.identificationModule.nctId").alias("nct_id"), F.col(f"{p}.identificationModule.briefTitle").alias("title"),
        F.col(f"{p}.descriptionModule.briefSummary").alias("brief_summary"), F.col(f"{p}.descriptionModule.detailedDescription").alias("detailed_description"),
        F.col(f"{p}.conditionsModule.conditions").alias("conditions"), F.when(phase.startswith("Phase "), phase).alias("phase"), F.col(f"{design}.designInfo.allocation").alias("allocation"),
        F.col(f"{design}.designInfo.primaryPurpose").alias("primary_purpose"), kinds.alias("intervention_types"),
        F.col(f"{p}.eligibilityModule.healthyVolunteers").alias("healthy_volunteers"), F.col(f"{p}.eligibilityModule.eligibilityCriteria").alias("eligibility_text"),
        F.try_to_date(F.col(f"{status}.studyFirstPostDateStruct.date"), "yyyy-MM-dd").alias("first_posted"),
        F.try_to_date(F.col(f"{status}.lastUpdatePostDateStruct.date"), "yyyy-MM-dd").alias("last_updated"),
    )
    return _identified(rows, bad, "nct_id")


def scan_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(drug labels in the normalised schema, lines that are none). Sections that a label lacks are absent from its map."""
    raw, bad = scan_json(spark, path, SPL)
    each = F.array(*[F.struct(F.lit(s).alias("k"), F.array_join(s, "\n").alias("v")) for s in SECTIONS])
    rows = raw.select(
        "set_id", F.try_to_date("effective_time", "yyyyMMdd").alias("effective_date"),
        F.map_from_entries(F.filter(each, lambda e: e["v"].isNotNull())).alias("sections"), F.col("openfda.pharm_class_epc").alias("pharm_class"),
        F.array_join("boxed_warning", "\n").alias("boxed_warning"), F.col("openfda.route").alias("route"),
    )
    return _identified(rows, bad, "set_id")


def _identified(rows: DataFrame, bad: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """A record without its id is set aside like a malformed line."""
    none = rows.filter(F.col(key).isNull()).select(F.to_json(F.struct(*rows.columns)).alias("_corrupt_record"))
    return rows.filter(F.col(key).isNotNull()), bad.unionByName(none)


def scan_normalised_trials(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records already in the normalised schema, and lines that are none."""
    return scan_json(spark, path, TRIALS)


def scan_normalised_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return scan_json(spark, path, LABELS)


def scan_teacher(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(teacher outputs, lines that are none)."""
    return scan_json(spark, path, TEACHER)


def read_verdicts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(audit verdicts, lines that are none)."""
    return scan_json(spark, path, VERDICT)


def read_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid items, quarantine: the line or the faults)."""
    good, bad = scan_json(spark, path, ITEM)
    marked = good.withColumn("faults", faults())
    broken = marked.filter(F.size("faults") > 0).select(F.to_json(F.struct(*good.columns)).alias("record"), F.array_join("faults", ",").alias("why"))
    return marked.filter(F.size("faults") == 0).drop("faults"), broken.unionByName(bad.select(F.col("_corrupt_record").alias("record"), F.lit("malformed").alias("why")))


#: Elements of a literature record in the public XML format (fixed names).
ARTICLE = """MedlineCitation struct<PMID:string, DateCompleted:struct<Year:string,Month:string,Day:string>,
 Article:struct<ArticleTitle:string, Abstract:struct<AbstractText:array<string>>, PublicationTypeList:struct<PublicationType:array<string>>>,
 MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_VALUE:string,_MajorTopicYN:string,_UI:string>>>>>,
 PubmedData struct<History:struct<PubMedPubDate:array<struct<_PubStatus:string,Year:string,Month:string,Day:string>>>>"""


def scan_pubmed(spark: SparkSession, path: str, trees: DataFrame | None = None) -> DataFrame:
    """Records in the normalised schema. trees: name, tree; a vocabulary that the files do not carry.

    Files are UTF-8. They are cut behind each record, so one large file is read by many tasks.
    """
    texts = spark.read.option("lineSep", "</PubmedArticle>").text(path)
    # What follows the last record of a file has no beginning of one.
    begun = texts.withColumn("value", F.regexp_extract("value", r"(?s)<PubmedArticle(?:\s[^>]*)?>.*", 0)).filter("value <> ''")
    raw = begun.select(F.from_xml(F.concat("value", F.lit("</PubmedArticle>")), ARTICLE, {"rowTag": "PubmedArticle"}).alias("r")).select("r.*")
    entry = F.get(F.filter("PubmedData.History.PubMedPubDate", lambda d: d["_PubStatus"] == "entrez"), F.lit(0))
    cite = "MedlineCitation"
    heads = F.coalesce(F.col(f"{cite}.MeshHeadingList.MeshHeading.DescriptorName"), F.array())
    rows = raw.select(
        F.col(f"{cite}.PMID").alias("pmid"), F.make_date(entry["Year"].cast("int"), entry["Month"].cast("int"), entry["Day"].cast("int")).alias("entry_date"),
        F.col(f"{cite}.Article.ArticleTitle").alias("title"), F.array_join(f"{cite}.Article.Abstract.AbstractText", " ").alias("abstract"),
        F.transform(f"{cite}.Article.PublicationTypeList.PublicationType", lambda t: F.lower(t)).alias("pub_types"),
        F.transform(heads, lambda h: F.struct(h["_VALUE"].alias("name"), F.lit(None).cast("string").alias("tree"), (h["_MajorTopicYN"] == "Y").alias("major"))).alias("mesh"),
    )
    if trees is None:
        return rows
    # Records meet the vocabulary by name; of a name's several trees the first in order is taken.
    first = trees.filter("name is not null").groupBy("name").agg(F.min("tree").alias("tree"))
    used = rows.select("pmid", F.explode(F.array_distinct(F.transform("mesh", lambda m: m["name"]))).alias("name")).distinct().join(first, "name")
    maps = used.groupBy("pmid").agg(F.map_from_entries(F.collect_list(F.struct("name", "tree"))).alias("_trees"))  # a record's own names
    named = F.transform("mesh", lambda m: F.struct(m["name"].alias("name"), F.element_at("_trees", m["name"]).alias("tree"), m["major"].alias("major")))
    return same(rows, maps, ["pmid"], "left").withColumn("mesh", named).drop("_trees")


def scan_qrels(spark: SparkSession, queries: str, corpus: str, qrels: str) -> DataFrame:
    """query_id, doc_id, grade, query, title, text of graded pairs."""
    graded = spark.read.schema("query_id string, doc_id string, grade int").option("sep", "\t").option("header", True).csv(qrels).filter("grade is not null")
    asked = spark.read.schema("_id string, text string").json(queries).select(F.col("_id").alias("query_id"), F.col("text").alias("query"))
    found = spark.read.schema("_id string, title string, text string").json(corpus).withColumnRenamed("_id", "doc_id")
    return graded.join(asked, "query_id").join(found, "doc_id")


def scan_choices(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(multiple-choice rows: id, question, choices, answer_idx, split; lines that are none)."""
    return scan_json(spark, path, CHOICES)


def fenced_block(spark: SparkSession, path: str, heading: str) -> DataFrame:
    """block: the first fenced block under a heading of a Markdown file."""
    text = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", rf"(?s)(?:^|\n)#+ {heading}[^\n]*\n(.*)", 1)
    return text.select(F.regexp_extract(body, r"(?s)```[^\n]*\n(.*?)```", 1).alias("block"))


def has_line(spark: SparkSession, path: str, literal: str) -> bool:
    return not spark.read.text(path).filter(F.col("value").contains(literal)).limit(1).isEmpty()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
