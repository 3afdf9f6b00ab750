import random

import public_tokenizers
import pytest

from assaykit.llm._vocab import TextIds, tokenizer
from assaykit.llm.token_counts import WordCounter, count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    r = random.Random(5)
    fixed = ["", "a'sb''s 'S <|endoftext|>x<|startoftext|> <|ENDOFTEXT|> <|endof", "\x0b\x0cab\x1c", "日本語 é İstanbul ŉ ſ", " " * 2000 + "b", "1a2b __x__ -- a_b"]
    return fixed + ["".join(r.choice("ab'sS <|>endoftx\n\t9_-.éß ñÑÀ") for _ in range(r.randrange(50))) for _ in range(3000)]


def test_word_counts_are_the_librarys():
    counter, library = WordCounter(PATH), tokenizer(PATH)
    for text in odd_texts():
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    ids = TextIds(public_tokenizers.path(name))
    assert ids.by_word == (name == "byte_bpe_50k.json")
    for text in odd_texts()[:800]:
        assert ids.ids(text).tolist() == ids.library.encode(text, add_special_tokens=False).ids, repr(text)


def test_odd_rows_and_a_warm_cache(spark, odd, tmp_path):
    df, rows = odd
    cache = str(tmp_path / "cache")
    library = tokenizer(PATH)
    want = sorted(((i, len((t or "").encode()), n, n > 2048) for i, t in rows for n in [len(library.encode(t or "", add_special_tokens=False).ids)]), key=str)
    assert sorted(map(tuple, count_tokens(spark, df, PATH, cache).collect()), key=str) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({" ".join((t or "").split(None)) for _, t in rows})
    assert sorted(map(tuple, count_tokens(spark, df, PATH, cache).collect()), key=str) == want
    assert spark.read.parquet(cache).count() == stored


def test_another_tokenizer_does_not_read_the_counts(spark, odd, tmp_path):
    df, _ = odd
    cache, other = str(tmp_path / "cache"), str(tmp_path / "other.json")
    count_tokens(spark, df, PATH, cache).count()
    with open(PATH) as f, open(other, "w") as g:
        g.write(f.read() + "\n")
    before = spark.read.parquet(cache).count()
    count_tokens(spark, df, other, cache).count()
    assert spark.read.parquet(cache).count() == 2 * before


def test_empty_table(spark, empty, tmp_path):
    assert count_tokens(spark, empty, PATH, str(tmp_path / "cache")).count() == 0
