"""The tables at hand in the roles that the operators expect; plans/base_sql.py has the same in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import bucket, stable_id, unit
from ..functions.probs import argmax, softmax
from .shipping import ship

SEED = 7
#: Options of one item.
MOST_OPTIONS = 10_000
MODELS = {"m-small": 0.2, "m-mid": 0.3, "m-large": 0.4}


class Tables:
    """Lazily read tables and the frames derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship(spark)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def items(self) -> DataFrame:
        """Yes/no items: is a document good, is it toxic; gold from the labels."""
        labels = self.read("labels").select("doc_id", F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("template_id", "v"))
        docs = self.read("documents").select("doc_id", "lang", "source", "n_chars")
        rows = labels.join(docs, "doc_id").withColumn("record", F.col("doc_id").cast("string"))
        return rows.select(
            stable_id(F.lit("documents"), "record", "template_id", F.lit(str(SEED))).alias("item_id"), F.lit("fresh").alias("tier"), "source",
            F.col("record").alias("source_record_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int")).alias("record_date"),
            F.when(bucket("record") % 5 == 0, "dev").otherwise("test").alias("split"), "template_id", F.lit("noul").alias("qtype"), "lang", "n_chars",
            F.when(F.col("v") == 1, "yes").otherwise("no").alias("gold"), F.when(F.col("v") == 1, 0).otherwise(1).alias("gold_index"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Three models' probabilities of [yes, no], by hash, the better the model the nearer to the gold."""
        models = self.spark.createDataFrame(list(MODELS.items()), "model string, base double")  # three rows
        rows = self.items.select("item_id", "gold_index").crossJoin(F.broadcast(models))
        p = F.col("base") + (1.0 - F.col("base")) * unit("model", "item_id")
        rows = rows.withColumn("p", p)
        probs = F.when(F.col("gold_index") == 0, F.array("p", 1.0 - F.col("p"))).otherwise(F.array(1.0 - F.col("p"), "p"))
        return rows.select(
            "item_id", "model", probs.alias("probs"), (10.0 + 90.0 * unit(F.lit("latency"), "model", "item_id")).alias("latency_ms"),
            (0.5 + 0.5 * unit(F.lit("mass"), "model", "item_id")).alias("label_mass"), (bucket(F.lit("fits"), "model", "item_id") % 20 != 0).alias("supported"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        from ..operators.metrics import score

        return score(self.items, self.predictions)

    @cached_property
    def logits(self) -> DataFrame:
        """Ten option logits of each embedding; gold is its label."""
        rows = self.read("embeddings")
        ten = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
        return rows.select(
            F.concat(F.lit("emb-"), F.col("vec_id").cast("string")).alias("item_id"), (F.col("vec_id") % 3).cast("int").alias("grp"),
            F.when(F.col("vec_id") % 2 == 0, "choice").otherwise("score").alias("qtype"), ten.alias("logits"), F.col("label").cast("int").alias("gold_index"),
        )

    @cached_property
    def logit_scored(self) -> DataFrame:
        from ..functions.probs import brier, nll

        rows = self.logits.withColumn("probs", softmax("logits"))
        return rows.select(
            "*", (argmax("probs") == F.col("gold_index")).alias("ok"), F.array_max("probs").alias("conf"), brier("probs", "gold_index").alias("brier"), nll("probs", "gold_index").alias("nll")
        )

    @cached_property
    def trials(self) -> DataFrame:
        """Orders as trial records."""
        o = self.read("orders")
        k = F.col("o_orderkey")
        pick = lambda values, n: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (n % len(values) + 1).cast("int"))
        return o.select(
            F.concat(F.lit("NCT"), F.lpad(k.cast("string"), 8, "0")).alias("nct_id"), F.concat(F.lit("Trial of "), F.col("o_orderpriority")).alias("title"),
            F.concat(F.lit("Trial of "), F.col("o_orderpriority"), F.lit(" begins. It is a Phase "), (k % 4 + 1).cast("string"), F.lit(" study of "), F.col("o_custkey").cast("string"), F.lit(".")).alias("brief_summary"),
            F.concat(F.lit("Status "), F.col("o_orderstatus")).alias("detailed_description"), F.array(F.col("o_orderpriority")).alias("conditions"),
            pick(["Phase 1", "Phase 2", "Phase 3", "Phase 4", None], k).alias("phase"), pick(["RANDOMIZED", "NON_RANDOMIZED", None], k).alias("allocation"),
            pick(["TREATMENT", "PREVENTION", "DIAGNOSTIC"], k).alias("primary_purpose"),
            F.when(k % 7 == 0, F.array(F.lit("DRUG"), F.lit("DEVICE"))).otherwise(F.array(pick(["DRUG", "DEVICE", "BEHAVIORAL"], k))).alias("intervention_types"),
            F.when(k % 11 != 0, k % 2 == 0).alias("healthy_volunteers"), F.to_date("o_orderdate").alias("first_posted"),
            F.date_add(F.to_date("o_orderdate"), (k % 900).cast("int")).alias("last_updated"),
        )

    @cached_property
    def labels(self) -> DataFrame:
        """Parts as drug labels."""
        p = self.read("part")
        return p.select(
            F.concat(F.lit("set-"), F.col("p_partkey").cast("string")).alias("set_id"), F.date_add(F.lit("2023-01-01").cast("date"), (F.col("p_partkey") % 1000).cast("int")).alias("effective_date"),
            F.map_from_arrays(
                F.array(F.lit("boxed_warning"), F.lit("class"), F.lit("indications"), F.lit("route")),
                F.array(F.concat(F.lit("Warning "), F.col("p_size").cast("string")), F.concat(F.lit("A "), F.col("p_brand")), F.concat(F.col("p_name"), F.lit(" of "), F.col("p_brand")), F.col("p_type")),
            ).alias("sections"),
            F.array("p_brand").alias("pharm_class"), F.when(F.col("p_size") < 10, "risk").alias("boxed_warning"), F.array("p_type").alias("route"),
        )

    @cached_property
    def papers(self) -> DataFrame:
        """Documents as literature records."""
        d = self.read("documents")
        k = F.col("doc_id")
        name = lambda n: F.concat(F.lit("Topic "), (n % 7).cast("string"))
        tree = lambda n: F.when(n % 7 < 4, F.concat(F.lit("A0"), (n % 7).cast("string"))).otherwise(F.concat(F.lit("A01.0"), (n % 7).cast("string")))
        tag = F.when(k % 3 == 0, "Humans").when(k % 3 == 1, "Animals").otherwise("Plants")
        return d.select(
            k.cast("string").alias("pmid"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 366).cast("int")).alias("entry_date"),
            F.concat(F.lit("On "), F.col("source")).alias("title"), F.col("text").alias("abstract"),
            F.when(k % 4 == 0, F.array(F.lit("observational"), F.lit("case report"))).when(k % 4 == 1, F.array(F.lit("randomized controlled trial"))).when(k % 4 == 2, F.array(F.lit("meta-analysis"), F.lit("systematic review"))).otherwise(F.array(F.lit("letter"))).alias("pub_types"),
            F.array(
                F.struct(tag.alias("name"), F.lit("Z01").alias("tree"), F.lit(False).alias("major")),
                F.struct(name(k).alias("name"), tree(k).alias("tree"), F.lit(True).alias("major")),
            ).alias("mesh"),
        )

    @cached_property
    def brands(self) -> DataFrame:
        """Choice items with as many options as there are brands; each carries them all, so more than MOST_OPTIONS are refused."""
        p = self.read("part")
        if (n := p.select("p_brand").distinct().count()) > MOST_OPTIONS:
            raise ValueError(f"{n} brands are no list of options")
        every = p.agg(F.array_sort(F.collect_set("p_brand")).alias("brands"))  # a vocabulary
        option = F.transform("brands", lambda b: F.struct(b.alias("key"), b.alias("label"), F.lit(None).cast("string").alias("description")))
        return p.crossJoin(F.broadcast(every)).select(
            stable_id(F.lit("part"), F.col("p_partkey").cast("string"), F.lit("brand")).alias("item_id"), F.col("p_partkey").alias("record"), option.alias("options"), F.col("p_brand").alias("gold")
        )
