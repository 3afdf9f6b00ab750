"""Answers spelled out in texts, by many spellings at once.

A spelling is compared by its words' plain forms: lower case, without a plural ending, whatever stands
between the words. Every run of as many words as some answer has is looked up among the answers by an
equality join, so a text is read once for all answers, and nothing is compared that shares no run. What
is found is taken out with all that stands between its words; runs may overlap.

Defined results: a null text stays null, a null answer, or one without a letter or digit, is in no text;
answers of one plain form are one; rows that share an id are told apart by their text and rows repeated
stay repeated; texts of any length are read whole; an empty table of answers leaves the texts as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import same

WORD = r"[\p{L}\p{N}]+"
#: Plural endings and what stands in their place, the first that fits (English rules).
PLURALS = (("(?<=[b-df-hj-np-tv-z])ies$", "y"), ("(?<=(s|x|z|ch|sh))es$", ""), ("(?<=[^su])s$", ""))


def plain(word: Column) -> Column:
    """A word's lower case, singular by rule; words of up to three characters keep their endings."""
    low = F.lower(word)
    out = low
    for pattern, put in reversed(PLURALS):
        out = F.when(low.rlike(pattern), F.regexp_replace(low, pattern, put)).otherwise(out)
    return F.when(F.length(low) > 3, out).otherwise(low)


def plain_words(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), plain)


def find_answers(texts: DataFrame, answers: DataFrame, id_: str, text: str, answer: str) -> DataFrame:
    """id_, th (the text's hash), at (first word, from 0), n (words), answer (its plain form) of every answer in every text."""
    forms = answers.select(plain_words(answer).alias("w")).filter(F.size("w") > 0).select(F.size("w").alias("n"), F.array_join("w", " ").alias("form")).distinct()
    lengths = sorted(r.n for r in forms.select("n").distinct().collect())  # how many words answers have
    words = texts.filter(F.col(text).isNotNull()).select(id_, F.xxhash64(text).alias("th"), plain_words(text).alias("w")).distinct()
    out = words.select(id_, "th", F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit("").alias("answer")).filter(F.lit(False))
    for n in lengths:
        count = F.size("w") - (n - 1)
        places = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
        runs = words.select(id_, "th", F.explode(F.transform(places, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("w", i + 1, n), " ").alias("answer")))).alias("r")).select(id_, "th", "r.at", F.lit(n).alias("n"), "r.answer")
        out = out.unionByName(runs.join(forms.filter(F.col("n") == n).select(F.col("form").alias("answer")), "answer", "left_semi"))
    return out


def remove_answers(texts: DataFrame, answers: DataFrame, id_: str, text: str, answer: str) -> DataFrame:
    """texts with every spelling of every answer taken out of their text."""
    found = find_answers(texts, answers, id_, text, answer)
    # Word numbers that go, and gaps inside an answer; a text's own words bound both lists.
    each = found.groupBy(id_, "th").agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)))).alias("_gone"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("n") > 1, F.sequence(F.col("at") + 1, F.greatest(F.col("at") + F.col("n") - 1, F.col("at") + 1))).otherwise(F.array().cast("array<int>"))))).alias("_inner"),
    )
    rows = same(texts.withColumn("th", F.xxhash64(text)), each, [id_, "th"], "left")
    words, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD, -1)
    kept = F.zip_with(
        gaps, words,
        lambda g, w: F.struct(g.alias("g"), F.coalesce(w, F.lit("")).alias("w")),
    )
    parts = F.transform(kept, lambda p, i: F.concat(F.when(F.array_contains("_inner", i), "").otherwise(p["g"]), F.when(F.array_contains("_gone", i), "").otherwise(p["w"])))
    return rows.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(parts, ""))).drop("th", "_gone", "_inner")
