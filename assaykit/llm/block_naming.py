"""Exact dedup by deterministic block naming, in DataFrame operations only.

Each text is cut into blocks of a fixed number of characters. The distinct blocks are sorted
and numbered, so that equal blocks share an integer and different blocks never do. Adjacent
names are paired, the distinct pairs are sorted and numbered in turn, and so on until one name
is left of each document. Documents are equal if and only if they end on the same level with
the same name: names stand for contents, not for hashes of them.

Only the distinct blocks travel with their content, after a map-side combine. A document's own
block list finds its names by a 64-bit handle of the block. Where two different blocks share a
handle, which the table of distinct blocks shows, those blocks are matched by content instead,
so that a collision cannot merge two texts.

Defined results: a null text is empty and equals the empty text; a text of any length takes
log2 of its number of blocks rounds; rows repeated with the same doc_id and text each get a
row, of which one is kept; a null doc_id is a value like another, lower than all; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Workspace, fresh, join_same, row_keys

BLOCK_CHARS = 4096
#: Names of blocks found by content lie above those found by handle.
BY_CONTENT = 1 << 62


def _blocks(docs: DataFrame, block_chars: int, handle: Callable[[Column], Column]) -> DataFrame:
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    rows = row_keys(docs).select("doc_id", "th", F.posexplode_outer(cut).alias("idx", "block"))
    rows = rows.select("doc_id", "th", F.coalesce("idx", F.lit(0)).alias("idx"), F.coalesce("block", F.lit("")).alias("block"))
    return rows.withColumn("handle", handle(F.col("block")))


def _numbered(distinct: DataFrame, *by: str) -> DataFrame:
    """Sorts what each partition holds and numbers it; no two rows get the same integer."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _first_names(docs: DataFrame, work: Workspace, block_chars: int, handle: Callable[[Column], Column]) -> DataFrame:
    """doc_id, th, idx, name of every block."""
    blocks = _blocks(docs, block_chars, handle)
    names = work.table(_numbered(blocks.select("handle", "block").distinct(), "block").select("handle", "name"), "names0")
    per_handle = names.groupBy("handle").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    clear = per_handle.filter("n = 1").select("handle", "name")
    clash = work.table(per_handle.filter("n > 1").select("handle"), "clash")
    out = blocks.drop("block").join(names, "handle").select("doc_id", "th", "idx", "name")
    if not clash.isEmpty():
        hit = blocks.join(clash, "handle", "left_semi")
        by_content = _numbered(hit.select("handle", "block").distinct(), "block")
        by_content = work.table(by_content.withColumn("name", F.col("name") + F.lit(BY_CONTENT)), "names0c")
        out = (
            blocks.drop("block").join(clear, "handle").select("doc_id", "th", "idx", "name")
            .unionByName(hit.join(by_content, ["handle", "block"]).select("doc_id", "th", "idx", "name"))
        )
    return out


def name_documents(docs: DataFrame, work: Workspace, block_chars: int = BLOCK_CHARS, handle: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, th, level, name of each distinct (doc_id, text); (level, name) is the text's identity."""
    first = work.table(_first_names(docs, work, block_chars, handle), "level0")
    size = first.groupBy("doc_id", "th").agg((F.max("idx") + 1).alias("n"), F.max(F.when(F.col("idx") == 0, F.col("name"))).alias("name"))
    done = size.filter("n = 1").select("doc_id", "th", F.lit(0).alias("level"), "name")
    long = size.filter("n > 1").select("doc_id", "th", "n")
    level, most = 0, first.agg(F.max("idx")).first()[0] or 0
    if not most:
        return done
    rows = work.table(join_same(first, long, ["doc_id", "th"]), "long0")
    ended = [done]
    while most:
        level += 1
        half = F.floor(F.col("idx") / 2).cast("int")
        pairs = rows.groupBy("doc_id", "th", half.alias("idx"), "n").agg(
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("l"),
            F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"),
        )
        pairs = work.table(pairs, f"pairs{level}")
        names = work.table(_numbered(pairs.select("l", "r").distinct(), "l", "r"), f"names{level}")
        rows = pairs.join(names, ["l", "r"]).select("doc_id", "th", "idx", "name", F.ceil(F.col("n") / 2).cast("int").alias("n"))
        rows = work.table(rows, f"long{level}")
        ended.append(rows.filter("n = 1").select("doc_id", "th", F.lit(level).alias("level"), "name"))
        rows, most = rows.filter("n > 1"), most // 2
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(spark: SparkSession, docs: DataFrame, block_chars: int = BLOCK_CHARS, handle: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. The largest doc_id of equal texts stays."""
    work = Workspace(spark, "exact-dedup")
    ids = name_documents(docs, work, block_chars, handle)
    rows = row_keys(docs).select("doc_id", "th", F.sha2("text", 256).alias("text_sha256")).groupBy("doc_id", "th", "text_sha256").agg(F.count("*").alias("copies"))
    rows = work.table(join_same(rows, ids, ["doc_id", "th"]).drop("th"), "identities")
    groups = rows.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    each = rows.join(work.table(groups, "groups"), ["level", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    work = Workspace(spark, "exact-dedup")
    ids = name_documents(docs, work)
    named = work.table(ids, "identities")
    stay = named.groupBy("level", "name").agg(F.max(F.struct("doc_id", "th")).alias("k")).select("k.doc_id", "k.th")
    th, n = fresh(docs.columns, "th", "n")
    keyed = docs.withColumn(th, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    stay = stay.withColumnRenamed("th", th)
    kept = join_same(keyed, stay.hint("shuffle_hash"), ["doc_id", th], "left_semi")
    # Rows repeated whole are told apart by nothing; one of each stays.
    often = work.table(keyed.groupBy("doc_id", th).agg(F.count("*").alias(n)).filter(F.col(n) > 1), "repeated")
    if often.isEmpty():
        return kept.drop(th)
    often = often.select("doc_id", th)
    once = join_same(kept, often, ["doc_id", th], "left_anti")
    return once.unionByName(join_same(kept, often, ["doc_id", th], "left_semi").dropDuplicates(["doc_id", th])).drop(th)
