"""Schemas of items, predictions and their neighbours, and predicates for their invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPTION = "struct<key:string,label:string,description:string>"
ITEM = f"""item_id string, tier string, source string, source_record_id string, source_url string, source_license string,
 record_date date, split string, template_id string, skill string, qtype string, state string, question string,
 options array<{OPTION}>, gold string, meta map<string,string>"""
PREDICTION = """item_id string, model string, source string, variant string, logits array<double>, probs array<double>,
 label_mass double, pred_key string, expected_level double, latency_ms double, supported boolean"""
MANIFEST = "source string, split string, qtype string, template_id string, n bigint, sha256 string, dropped boolean"
LEDGER = "id string, claim string, value string, artifact string, recompute string, task string"
BOARD = "pos int, id string, task string, gpu string, deps array<string>, status string"
VERDICT = "item_id string, verdict string, note string, ts timestamp"
TEACHER = "item_id string, mode string, topk map<string,double>, output_tokens int, seconds double"
TOKENS = "item_id string, model string, is_control boolean, logprobs array<double>"

TIERS, SPLITS, QTYPES = ("established", "fresh"), ("train", "dev", "test"), ("noul", "choice", "score")


def gold_in_options(options: str = "options", gold: str = "gold") -> Column:
    return F.exists(options, lambda o: o["key"] == F.col(gold))


def faults() -> Column:
    """Names of the rules that an item breaks, in order; an empty array for a valid item."""
    rules = {
        "item_id": F.col("item_id").isNotNull() & (F.length("item_id") > 0),
        "tier": F.col("tier").isin(*TIERS),
        "split": F.col("split").isin(*SPLITS),
        "qtype": F.col("qtype").isin(*QTYPES),
        "state": F.col("state").isNotNull(),
        "gold": gold_in_options(),
        "noul": (F.col("qtype") != "noul") | F.col("gold").isin("yes", "no"),
        "levels": (F.col("qtype") != "score") | (F.size("options") >= 2),
    }
    marks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.array_compact(F.array(*marks))


def validated(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid items, quarantined items with their faults)."""
    marked = items.withColumn("faults", faults())
    return marked.filter(F.size("faults") == 0).drop("faults"), marked.filter(F.size("faults") > 0)
