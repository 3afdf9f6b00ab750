"""Which texts hold which passages, by an equality join on word n-grams.

A passage that stands in a text stands there with all its words but the first and the last whole,
so any run of words inside it is a run of words of the text. Each passage is looked up by one such
run; texts offer all of theirs; what meets is verified as a substring. Nothing is compared that
shares no run. Passages of fewer than RUN + 2 words have no such run: they are looked up by a single
inner word, or, with fewer than three words, by their first three characters (or the only one or first
of two) among those of the texts.

Defined results: a null text holds nothing, a null passage is held by nothing, an empty passage by
every text; a text repeated gives its pairs again, a passage repeated whole counts once; texts and passages of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 5


def _words(text: str) -> Column:
    return F.split(text, r"[ \t\n\x0B\f\r]+")


def _runs(words: str, n: int) -> Column:
    """Hashes of all runs of n words."""
    count = F.size(words) - (n - 1)
    at = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(words, i, F.lit(n))))


def holders(texts: DataFrame, passages: DataFrame, text_id: str = "doc_id", passage_id: str = "item_id") -> DataFrame:
    """text_id, passage_id of each text (text) that contains a passage (passage)."""
    split = passages.withColumn("_w", _words("passage"))
    long, short = F.size("_w") >= RUN + 2, F.size("_w") >= 3
    out = []
    for n, which in ((RUN, long), (1, ~long & short)):
        asked = split.filter(which).select(passage_id, "passage", F.xxhash64(F.slice("_w", 2, n)).alias("_run"))
        if asked.isEmpty():
            continue
        offered = texts.withColumn("_w", _words("text")).select(text_id, F.explode(F.array_distinct(_runs("_w", n))).alias("_run"))
        # Only ids meet; the texts of what meets are joined after.
        met = offered.join(asked.select("_run").distinct(), "_run", "left_semi").join(asked, "_run")
        out.append(met.select(text_id, passage_id, "passage").distinct().join(texts, text_id).filter(F.contains("text", "passage")).select(text_id, passage_id))
    tiny = split.filter(~short).select(passage_id, "passage").distinct()
    for n, which in ((3, F.length("passage") >= 3), (1, F.length("passage").between(1, 2))):
        asked = tiny.filter(which).select(passage_id, "passage", F.substring("passage", 1, n).alias("_run"))
        if asked.isEmpty():
            continue
        grams = F.array_distinct(F.concat(*[F.regexp_extract_all(F.substring("text", k, 2**31 - 1), F.lit(f"(?s).{{{n}}}"), F.lit(0)) for k in range(1, n + 1)]))
        met = texts.select(text_id, F.explode(grams).alias("_run")).join(asked.select("_run").distinct(), "_run", "left_semi").join(asked, "_run")
        out.append(met.select(text_id, passage_id, "passage").distinct().join(texts, text_id).filter(F.contains("text", "passage")).select(text_id, passage_id))
    every = tiny.filter("passage = ''").select(passage_id)  # passages without a character: every text holds each of them
    if not every.isEmpty():
        out.append(texts.filter("text is not null").select(text_id).crossJoin(every))
    none = texts.select(text_id).join(passages.select(passage_id), F.lit(False))
    for more in out:
        none = none.unionByName(more)
    return none
