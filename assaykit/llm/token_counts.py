"""Token counts behind a digest cache.

The cache is a Parquet table keyed by the digest of the normalised content and the digest of
the tokenizer's file. Documents find their counts by joining their digests to it. What is not
there is reduced to one representative for each distinct digest, encoded and appended.

Normalised content: runs of ASCII white space are one space, none at the ends. The tokenizer
drops white space, so this changes no count; it lowers case by itself, after it has looked for
special strings, so case is kept here.

Defined results: a null text is empty and has no tokens; a text of any length is counted whole;
rows repeated get a row each; an empty table gives no rows; other columns are not read. Two
writers that append the same digest at once leave equal rows; reading takes one of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Workspace, join_same
from ._vocab import OTHER, Remembered, batch_ids, tokenizer

CACHE = "content string, tokenizer string, n_tokens long"
#: Words as the tokenizer's pre-tokenizer cuts them (fixed values of its file).
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
SPECIAL = re.compile(r"<\|startoftext\|>|<\|endoftext\|>")


class WordCounter:
    """Counts as Tokenizer.encode(text, add_special_tokens=False) does."""

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.words = Remembered(lambda new: list(map(len, batch_ids(self.library, new))))

    def count(self, text: str) -> int:
        if OTHER.search(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if "<|" in text:
            parts = SPECIAL.split(text)
            return len(parts) - 1 + sum(map(self.count_plain, parts))
        return self.count_plain(text)

    def count_plain(self, text: str) -> int:
        return sum(self.words.of(WORDS.findall(text.lower())))


@lru_cache(maxsize=1)
def word_counter(path: str) -> WordCounter:
    """One for each worker process; its words serve all of that worker's tasks."""
    return WordCounter(path)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _normalised():
    return F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[ \t\n\r\x0B\f]+", " "))


def encode_counts(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """content, text -> content, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = word_counter(tokenizer_path)
        for batch in batches:
            counts = [counter.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(run, "content string, n_tokens long")


def read_cache(spark: SparkSession, path: str, tokenizer_digest: str) -> DataFrame:
    try:
        table = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        table = spark.createDataFrame([], CACHE)
    return table.filter(F.col("tokenizer") == tokenizer_digest).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(spark: SparkSession, docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 2048) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit. Counts that were missing are in the cache afterwards."""
    work, version = Workspace(spark, "token-counts"), file_digest(tokenizer_path)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("content", F.sha2(_normalised(), 256))
    rows = work.table(text.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    misses = rows.join(work.table(read_cache(spark, cache_path, version), "known"), "content", "left_anti")
    # One document stands for each distinct miss, so that a text with many copies travels and is encoded once.
    chosen = misses.groupBy("content").agg(F.min("doc_id").alias("doc_id"))
    picked = join_same(text, chosen.hint("shuffle_hash"), ["doc_id", "content"], "left_semi")
    new = encode_counts(picked.select("content", "text"), tokenizer_path)
    new.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    counted = rows.join(work.table(read_cache(spark, cache_path, version), "counts"), "content")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
