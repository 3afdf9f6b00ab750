"""The corpus pipeline: language ID, exact dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs. All but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assaykit.llm import block_naming, config_packing, context_pii, segment_language, shingle_links
from assaykit.llm._common import Workspace, read_table

#: A document is rejected if its language is undetermined or less likely than this.
LEAST_LANGUAGE_SCORE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text has no letter, or no language that stands out."""
    return segment_language.keep_languages(docs, public_tokenizers.path("piece_bpe_32k.model"), LEAST_LANGUAGE_SCORE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return block_naming.drop_exact_copies(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group, linked by fingerprint or by five-word shingles of similarity 0.8, the row with the smallest doc_id stays."""
    return shingle_links.drop_near_copies(spark, docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; what is personal in it gives way to its kind in brackets."""
    return context_pii.redact(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return config_packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", keep_known_languages),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", redact_personal_data),
    ("best-fit packing", pack_sequences),
]

#: The stages' models and hashes have no SQL form; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    work = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = work.table(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
