import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from assaykit.llm import padded_bpe
from assaykit.llm.queries import op12_padded_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def coder():
    return padded_bpe.codec(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def same(coder, library, texts):
    got = coder.encode(texts)
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
    assert [coder.decode(g) for g in got] == [t.encode() for t in texts]


def test_random_words_of_every_length(coder, library):
    rng = random.Random(2)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ab", "éèüßçñ", "漢字仮名交じり文", "привет", "🙂🙃😀", " ", "=-_*#.!?/\\<>|", "0123456789", " \n\t 　", "'sdlm"]
    texts = ["".join(rng.choices(rng.choice(kinds), k=rng.randrange(1, 160))) for _ in range(4000)]
    same(coder, library, texts)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    coder = padded_bpe.codec(PATH, PATTERN)
    same(coder, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={}), [text])


def test_every_character_between_letters_and_numbers(coder, library):
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    # Seven apart, so that neighbours are of other blocks.
    same(coder, library, ["".join(every[k::997]) for k in range(997)])


@pytest.mark.parametrize("text", ["a" * 60000, "ab" * 20000, " " * 30000, "é" * 20000, "=" * 20001, "x" * 1025, "".join(random.Random(4).choices("etaoinshrdlu", k=20000))])
def test_long_words(coder, library, text):
    same(coder, library, [text])


def test_long_rows_merge_as_short_ones(coder):
    rng = random.Random(8)
    words = ["".join(rng.choices(rng.choice(["abcdefghijklmnopqrstuvwxyz", "aab", "the "]), k=rng.randrange(2, 80))).encode() for _ in range(1500)]
    for word, ids in zip(words, coder.merge(words)):
        assert coder._merge_long(word).tolist() == ids.tolist()


def test_a_pair_that_ranks_below_the_one_it_is_made_of():
    """`abcd` ranks below `bc`d`'s parts here, so after the merge that makes it possible it comes before equal pairs further right."""
    tokens = [*(bytes([b]) for b in range(256)), b"cd", b"bc", b"abc", b"cda", b"abcd", b"bcb"]
    ranks = {t: k for k, t in enumerate(tokens)}
    order = ["abcd", "abc", "bc", "cda", "bcb", "cd"]
    ranks.update({t.encode(): 256 + k for k, t in enumerate(order)})
    library = tiktoken.Encoding("odd", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={})
    coder = padded_bpe.ByteCodec.__new__(padded_bpe.ByteCodec)
    coder.ranks, coder.byte_ids = ranks, np.arange(256, dtype=np.int32)
    splits = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    coder.pairs = padded_bpe.PairTable(*np.array(splits, dtype=np.int64).T)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcd", k=rng.randrange(1, 40))) for _ in range(3000)]
    want = [library.encode_ordinary(w) for w in words]
    assert [i.tolist() for i in coder.merge([w.encode() for w in words])] == want
    assert [coder._merge_long(w.encode()).tolist() for w in words] == want


def test_pair_table_with_colliding_keys():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 300, (4000, 2)), axis=0)
    table = padded_bpe.PairTable(keys[:, 0], keys[:, 1], np.arange(len(keys)))
    assert (table(keys[:, 0], keys[:, 1]) == np.arange(len(keys))).all()
    left, right = np.meshgrid(np.arange(-1, 320), np.arange(-1, 320))
    known = {tuple(k): v for v, k in enumerate(keys.tolist())}
    got = table(left.ravel(), right.ravel())
    assert all(g == known.get((a, b), padded_bpe.NEVER) for g, a, b in zip(got.tolist(), left.ravel().tolist(), right.ravel().tolist()))


def test_query_rows_equal_the_library(spark, library, tmp_path):
    rows = [(1, "Hello <|endoftext|> world's  end\n\n"), (2, None), (3, ""), (4, "z" * 3000), (4, "z" * 3000), (None, "日本語のテキスト"), (5, "\U00032b1a鉿 ՘ \x1c\x1f\x85 a")]
    spark.createDataFrame([(*r, 0, []) for r in rows], "doc_id long, text string, n_tokens int, ids array<int>").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op12_padded_bpe(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for doc_id, text in rows:
        ids = np.array(library.encode_ordinary(text or ""), dtype="<u4")
        want.append((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_ids_and_texts_round_trip(spark, library):
    docs = spark.createDataFrame([(1, "Some words, some more."), (2, None), (3, "naïve 🙂")], "doc_id long, text string")
    ids = padded_bpe.encode(docs, PATH, PATTERN)
    assert {r.doc_id: r.ids for r in ids.collect()} == {1: library.encode_ordinary("Some words, some more."), 2: [], 3: library.encode_ordinary("naïve 🙂")}
    assert {r.doc_id: bytes(r.content).decode() for r in padded_bpe.decode(ids, PATH, PATTERN).collect()} == {1: "Some words, some more.", 2: "", 3: "naïve 🙂"}


def test_unknown_ids_and_incomplete_files_are_refused(coder, tmp_path):
    with pytest.raises(ValueError):
        coder.decode(np.array([60000]))
    (tmp_path / "ranks").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError):
        padded_bpe.ByteCodec(str(tmp_path / "ranks"), PATTERN)


def test_empty_table(spark):
    assert padded_bpe.encode_and_decode(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).count() == 0
