import hashlib
import json

from pyspark.sql import functions as F

from assaykit.operators.items import paper_humans
from assaykit.sources import loaders, readers, sinks
from assaykit.streaming.incremental import build_incrementally

XML = """<?xml version="1.0"?><PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID>11</PMID><Article><ArticleTitle>One</ArticleTitle><Abstract><AbstractText>Part a.</AbstractText><AbstractText>Part b.</AbstractText></Abstract>
<PublicationTypeList><PublicationType>Case Report</PublicationType></PublicationTypeList></Article>
<MeshHeadingList><MeshHeading><DescriptorName UI="D1" MajorTopicYN="N">Humans</DescriptorName></MeshHeading><MeshHeading><DescriptorName UI="D2" MajorTopicYN="Y">Asthma</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>
<PubmedData><History><PubMedPubDate PubStatus="received"><Year>2024</Year><Month>1</Month><Day>2</Day></PubMedPubDate><PubMedPubDate PubStatus="entrez"><Year>2025</Year><Month>3</Month><Day>4</Day></PubMedPubDate></History></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><ArticleTitle>Two</ArticleTitle></Article></MedlineCitation></PubmedArticle>
</PubmedArticleSet>"""


def test_literature_records(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    trees = spark.createDataFrame([("Asthma", "C08.127")], "name string, tree string")
    got = {r.pmid: r for r in readers.scan_pubmed(spark, str(tmp_path / "a.xml"), trees).collect()}
    assert (str(got["11"].entry_date), got["11"].abstract, got["11"].pub_types) == ("2025-03-04", "Part a. Part b.", ["case report"])
    assert [(m.name, m.tree, m.major) for m in got["11"].mesh] == [("Humans", None, False), ("Asthma", "C08.127", True)]
    assert got["12"].mesh == [] and got["12"].entry_date is None
    assert [r.gold for r in paper_humans(readers.scan_pubmed(spark, str(tmp_path / "a.xml")), 1).collect()] == ["yes"]


def test_items_and_quarantine(spark, tmp_path):
    good = {"item_id": "1", "tier": "fresh", "source": "s", "split": "test", "qtype": "choice", "state": "x", "options": [{"key": "a", "label": "A"}], "gold": "a"}
    lines = [json.dumps(good), json.dumps(good | {"gold": "z"}), "{broken"]
    (tmp_path / "i.jsonl").write_text("\n".join(lines))
    items, bad = readers.read_items(spark, str(tmp_path / "i.jsonl"))
    assert [r.item_id for r in items.collect()] == ["1"] and sorted(r.why for r in bad.collect()) == ["gold", "malformed"]
    sinks.write_items(items, str(tmp_path / "out"))
    again, none = readers.read_items(spark, str(tmp_path / "out"))
    assert [r.gold for r in again.select("gold").collect()] == ["a"] and none.count() == 0


def test_relevance_pairs(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"_id":"q1","text":"query"}')
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"_id": f"d{i}", "title": "", "text": f"doc {i}"}) for i in range(5)))
    (tmp_path / "r.tsv").write_text("query-id\tcorpus-id\tscore\n" + "\n".join(f"q1\td{i}\t{2 if i == 0 else 0}" for i in range(4)) + "\nq1\td4\t\n")
    pairs = readers.scan_qrels(spark, str(tmp_path / "q.jsonl"), str(tmp_path / "c.jsonl"), str(tmp_path / "r.tsv"))
    assert pairs.count() == 4
    assert sorted(r.gold for r in loaders.relevance_items(pairs, "rel", 1).collect()) == ["no", "yes"]
    graded = loaders.graded_items(pairs, ("0", "1", "2"), "rel", 1)
    assert sorted(r.gold for r in graded.collect()) == ["0", "0", "0", "2"] and [o.key for o in graded.first().options] == ["0", "1", "2"]


def test_choice_sets(spark):
    df = spark.createDataFrame([("1", "q", ["x", "y"], 1, "validation"), ("2", "q", ["x", "y"], 0, "train"), ("3", "q", ["x"], 5, "train")], "id string, question string, choices array<string>, answer_idx int, split string")
    got = {r.source_record_id: r for r in loaders.choice_items(df, "s", "t", 1).collect()}
    assert set(got) == {"1", "2"} and got["1"].split == "test" and got["2"].split in ("train", "dev") and got["1"].gold == "y"
    labelled = spark.createDataFrame([("1", "q", "ctx", "maybe", "test"), ("2", "q", "ctx", "other", "test")], "id string, question string, context string, label string, split string")
    assert [r.gold for r in loaders.labelled_items(labelled, "s", "t", ("yes", "no", "maybe"), 1).collect()] == ["maybe"]
    assert loaders.subset_items({"b": df, "a": df}, "s", 1).select("template_id").distinct().count() == 2
    some = loaders.with_provenance(df, "d", "r", "MIT").unionByName(loaders.with_provenance(df, "d", "r", None))
    assert loaders.only_licensed(some).count() == 3


def test_summaries_predictions_and_files(spark, tmp_path):
    df = spark.createDataFrame([("m", "s", 0.5), ("m", "t", None)], "model string, source string, accuracy double")
    assert sinks.to_markdown(df.orderBy("source"), "no run").splitlines() == ["| model | source | accuracy |", "| --- | --- | --- |", "| m | s | 0.5 |", "| m | t | NOT MEASURED — no run |"]
    sinks.write_summary(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2
    sinks.write_predictions(df.withColumn("item_id", F.lit("i")), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("model = 'm' and source = 's'").count() == 1
    (tmp_path / "f.txt").write_text("hello")
    assert readers.file_hashes(spark, str(tmp_path / "f.txt")).first().sha256 == hashlib.sha256(b"hello").hexdigest()
    assert sinks.session_log_name(7) == "session_007.log"


def test_fenced_block_and_status(spark, tmp_path):
    (tmp_path / "k.md").write_text("# A\n```\nno\n```\n## Loop prompt\ntext\n```text\nline 1\nline 2\n```\n```\nlater\n```\n")
    assert readers.fenced_block(spark, str(tmp_path / "k.md"), "Loop prompt").first().block == "line 1\nline 2\n"
    assert readers.has_line(spark, str(tmp_path / "k.md"), "line 2") and not readers.has_line(spark, str(tmp_path / "k.md"), "STOPPED")


def test_incremental_build_takes_each_file_once(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    template = lambda df: df.select(F.sha2("id", 256).alias("item_id"), "id")
    for k, ids in enumerate((["a", "b", "b"], ["b", "c"])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"id": i}) for i in ids))
        build_incrementally(spark, landing, "id string", template, out, state).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_one_large_xml_file_is_read_by_many_tasks(spark, tmp_path):
    one = "<PubmedArticle Status='x'><MedlineCitation><PMID>{}</PMID><Article><ArticleTitle>A &amp; <![CDATA[b < c]]> {}</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
    (tmp_path / "a.xml").write_text('<?xml version="1.0" encoding="UTF-8"?>\n<PubmedArticleSet>\n' + "\n".join(one.format(k, "é" * 2000) for k in range(3000)) + "\n</PubmedArticleSet>\n")
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        rows = readers.scan_pubmed(spark, str(tmp_path / "a.xml"))
        tasks = [r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(tasks) > 4 and sum(tasks) == 3000
        assert {(r.pmid, r.title) for r in rows.collect()} == {(str(k), f"A & b < c {'é' * 2000}") for k in range(3000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
