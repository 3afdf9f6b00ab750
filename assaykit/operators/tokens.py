"""Adapters of outside libraries that run on Arrow batches, and what is asked of a tokenizer.

An adapter is a function of a file's path that gives a function from texts to lists of ids. It is named
in ADAPTERS; `register` adds one. Workers load a file once.

Defined results: a null label has no row; a label that several items have is asked once; a tokenizer for
which no variant is one token gets a null variant; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encode = Callable[[list[str]], list[list[int]]]
ADAPTERS: dict[str, Callable[[str], Encode]] = {}


def register(kind: str) -> Callable[[Callable[[str], Encode]], Callable[[str], Encode]]:
    def add(make: Callable[[str], Encode]) -> Callable[[str], Encode]:
        ADAPTERS[kind] = make
        return make

    return add


@register("tokenizers")
def _tokenizers(path: str) -> Encode:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return lambda texts: [library.encode(t, add_special_tokens=False).ids for t in texts]


@register("sentencepiece")
def _sentencepiece(path: str) -> Encode:
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: library.encode(texts, num_threads=1)


@lru_cache(maxsize=8)
def adapter(kind: str, path: str) -> Encode:
    if kind not in ADAPTERS:
        raise ValueError(f"no adapter is named {kind}; there are {sorted(ADAPTERS)}")
    return ADAPTERS[kind](path)


def token_lengths(texts: DataFrame, column: str, kind: str, path: str, name: str = "tokens") -> DataFrame:
    """texts with how many tokens a column has, null for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = adapter(kind, path)
        for batch in batches:
            values = batch.column(column).to_pylist()
            asked = iter(encode([v for v in values if v is not None]))
            counts = pa.array([None if v is None else len(next(asked)) for v in values], pa.int32())
            yield batch.append_column(name, counts)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInArrow(run, f"{kinds}, `{name}` int")


def label_tokens(labels: DataFrame, column: str, tokenizers: dict[str, tuple[str, str]], variants: tuple[str, ...] = (" {}", "{}")) -> DataFrame:
    """tokenizer, label, variant (the first that is one token), single; tokenizers: name -> (kind, path)."""
    each = labels.select(F.col(column).alias("label")).filter("label is not null").distinct()
    forms = F.array(*[F.struct(F.lit(k).alias("rank"), F.concat(F.lit(v.split("{}")[0]), "label", F.lit(v.split("{}")[1])).alias("variant")) for k, v in enumerate(variants)])
    asked = each.select("label", F.inline(forms))
    out = None
    for name, (kind, path) in sorted(tokenizers.items()):
        best = F.min(F.when(F.col("tokens") == 1, F.struct("rank", "variant")))
        one = token_lengths(asked, "variant", kind, path).groupBy("label").agg(best.alias("b")).select(F.lit(name).alias("tokenizer"), "label", F.col("b.variant").alias("variant"), F.col("b").isNotNull().alias("single"))
        out = one if out is None else out.unionByName(one)
    return out
