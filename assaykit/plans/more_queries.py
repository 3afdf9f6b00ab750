"""Remaining rows of the inventory: predicates, later-stage comparisons, small scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import probs as P
from ..functions.text import sentences
from ..operators import near, tokens
from ..sources.adapters import Tables
from . import base_sql as S
from .registry import query


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def f12_graded_only(t: Tables) -> DataFrame:
    """Pairs that have a graded label."""
    grade = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), F.col("o_orderpriority"))
    return t.read("orders").withColumn("grade", grade).filter("grade is not null").select("o_orderkey")


@query()
def f13_label_tokens(t: Tables) -> DataFrame:
    """Letters of as many options as the items have, and their golds: which variant is one token of each installed tokenizer."""
    import public_tokenizers

    files = {"byte_bpe_50k": ("tokenizers", "byte_bpe_50k.json"), "piece_bpe_32k": ("sentencepiece", "piece_bpe_32k.model"), "word_bpe_49k": ("tokenizers", "word_bpe_49k.json")}
    letters = t.brands.select(F.explode(F.transform("options", lambda o, i: F.chr(F.lit(65) + i % 26))).alias("label")).distinct()
    labels = letters.unionByName(t.items.select(F.col("gold").alias("label"))).unionByName(t.brands.select(F.col("gold").alias("label")))
    return tokens.label_tokens(labels, "label", {n: (kind, public_tokenizers.path(f)) for n, (kind, f) in files.items()})


@query(
    r"""SELECT lang, count(*) AS n, round(avg(CASE WHEN judged = (quality = 1) THEN 1e0 ELSE 0e0 END), 6) AS agreement,
    round((avg(CASE WHEN judged = (quality = 1) THEN 1e0 ELSE 0e0 END) - e) / nullif(1 - e, 0), 6) AS kappa FROM (
    SELECT *, avg(CASE WHEN judged THEN 1e0 ELSE 0e0 END) OVER g * avg(CASE WHEN quality = 1 THEN 1e0 ELSE 0e0 END) OVER g
      + (1 - avg(CASE WHEN judged THEN 1e0 ELSE 0e0 END) OVER g) * (1 - avg(CASE WHEN quality = 1 THEN 1e0 ELSE 0e0 END) OVER g) AS e FROM (
      SELECT lang, quality, len(string_split(text, ' ')) >= 20 AND len(regexp_extract_all(text, '[.!?]')) * 40 >= len(string_split(text, ' ')) AS judged FROM labels JOIN documents USING (doc_id) WHERE text IS NOT NULL AND quality IS NOT NULL)
    WINDOW g AS (PARTITION BY lang)) GROUP BY lang, e"""
)
def j24_judge_agreement(t: Tables) -> DataFrame:
    """A judge that reads the text (enough words, sentences that end) against the gold of the same document, with the agreement that chance gives taken out."""
    words = F.size(F.split("text", " ", -1))
    judged = (words >= 20) & (F.regexp_count("text", F.lit("[.!?]")) * 40 >= words)
    gold = t.read("labels").filter("quality is not null").select("doc_id", (F.col("quality") == 1).alias("good"))
    rows = gold.join(t.read("documents").filter("text is not null").select("doc_id", "lang", judged.alias("judged")), "doc_id")
    share = lambda c: F.avg(c.cast("double"))
    each = rows.groupBy("lang").agg(F.count("*").alias("n"), share(F.col("judged") == F.col("good")).alias("a"), share(F.col("judged")).alias("j"), share(F.col("good")).alias("g"))
    chance = F.col("j") * F.col("g") + (1 - F.col("j")) * (1 - F.col("g"))
    return each.select("lang", "n", F.round("a", 6).alias("agreement"), F.round(F.try_divide(F.col("a") - chance, 1 - chance), 6).alias("kappa"))


@query(
    f"""SELECT template_id, round(a - b, 6) AS gain, a > b AS pass FROM (SELECT template_id, avg(CASE WHEN model = 'm-large' THEN CASE WHEN ok THEN 1e0 ELSE 0e0 END END) AS a,
    avg(CASE WHEN model = 'm-mid' THEN CASE WHEN ok THEN 1e0 ELSE 0e0 END END) AS b FROM scored WHERE split = 'test' GROUP BY template_id)""",
    "scored",
)
def g2_distillation(t: Tables) -> DataFrame:
    """Teacher data against gold only; a29 is its ablation by source."""
    acc = lambda m: F.avg(F.when(F.col("model") == m, F.col("ok").cast("double")))
    rows = t.scored.filter("split = 'test'").groupBy("template_id").agg(acc("m-large").alias("a"), acc("m-mid").alias("b"))
    return rows.select("template_id", F.round(F.col("a") - F.col("b"), 6).alias("gain"), (F.col("a") > F.col("b")).alias("pass"))


@query(
    """SELECT vec_id, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS pred, len(list_filter(l, lambda x: x = list_max(l))) > 1 AS tied
    FROM (SELECT vec_id, list_transform(embedding[1:10], lambda x: floor(CAST(x AS DOUBLE) * 2e0)) AS l FROM embeddings)"""
)
def w10_first_of_ties(t: Tables) -> DataFrame:
    """Coarse logits, so that many are tied."""
    coarse = F.transform(F.slice("embedding", 1, 10), lambda x: F.floor(x.cast("double") * 2))
    rows = t.read("embeddings").select("vec_id", coarse.alias("l"))
    return rows.select("vec_id", P.argmax("l").alias("pred"), (F.size(F.filter("l", lambda x: x == F.array_max("l"))) > 1).alias("tied"))


@query("SELECT item_id, len(regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1))) AS n FROM benchmark")
def x10_sentences(t: Tables) -> DataFrame:
    return t.read("benchmark").select("item_id", F.size(sentences("text")).cast("long").alias("n"))


@query(
    f"""SELECT k, count(*) AS n, round(avg(CASE WHEN {S.bucket("'near'", 'item_id', 'CAST(k AS VARCHAR)')} % 3 <> 0 THEN 1e0 ELSE 0e0 END), 6) AS accuracy
    FROM (SELECT item_id, len(list_filter(options, lambda o: o <> gold AND levenshtein(o, gold) <= 1)) AS k FROM brands) GROUP BY k""",
    "brands",
)
def a34_accuracy_by_near_options(t: Tables) -> DataFrame:
    """Accuracy of a stand-in model by how many options lie one edit from the gold."""
    from ..functions.hashing import bucket

    pairs = near.near_pairs(t.brands.select("gold"), "gold")
    counts = pairs.select(F.explode(F.array("a", "b")).alias("gold")).groupBy("gold").agg(F.count("*").alias("near"))
    rows = t.brands.join(counts, "gold", "left").withColumn("k", F.coalesce("near", F.lit(0)).cast("long"))
    right = (bucket(F.lit("near"), "item_id", F.col("k").cast("string")) % 3 != 0).cast("double")
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"))


@query("SELECT template_id, split, count(*) AS n FROM items WHERE template_id <> 'toxic' GROUP BY ALL", "items")
def f06_kept_templates(t: Tables) -> DataFrame:
    dropped = t.spark.createDataFrame([("toxic",)], "template_id string")
    return t.items.join(F.broadcast(dropped), "template_id", "left_anti").groupBy("template_id", "split").agg(F.count("*").alias("n"))
