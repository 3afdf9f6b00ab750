import os
import random
import struct
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from assaykit.llm.sentencepiece_backend import Codec, decode, encode, encode_and_check

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_ids_are_the_librarys_and_come_back():
    tokens, library, r = Codec(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(1)
    texts = ["", " ", "  a", "a ", "<s> </s> <0x41>", "▁x ▁", "日本語 🙂"] + ["".join(r.choice("ab   \n\té日🙂the<s>x0") for _ in range(r.randrange(30))) for _ in range(4000)]
    for text in texts:
        ids, same = tokens.encode(text)
        assert ids.tolist() == library.encode(text) and same, repr(text)
        assert "▁" in text or tokens.decode(ids.tolist()) == text, repr(text)


def test_odd_rows(spark, odd):
    df, rows = odd
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "")
        want.append((doc_id, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), zlib.crc32((text or "").encode()), True, True))
    assert sorted(map(tuple, encode_and_check(spark, df, PATH).collect()), key=str) == sorted(want, key=str)


def test_frames_of_ids_decode_to_the_texts(spark, odd):
    df, rows = odd
    back = decode(encode(df, PATH), PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)


def test_empty_table(spark, empty):
    assert encode_and_check(spark, empty, PATH).count() == 0


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def write_model(path, pieces, kind, squeeze):
    body = [(1, message((1, p.encode()), (2, score), (3, t))) for p, score, t in pieces]
    trainer = message((3, kind), (4, len(pieces)), (35, 1))
    normaliser = message((1, b"identity"), (2, b""), (3, 1), (4, int(squeeze)), (5, 1))
    path.write_bytes(message(*body, (2, trainer), (3, normaliser)))


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("squeeze", [False, True])
def test_handmade_models_of_both_kinds(tmp_path, kind, squeeze):
    """A few pieces written out by hand, so that unigram scores and space squeezing are met too."""
    own = ["▁", "a", "b", "c", "ab", "bc", "▁a", "▁ab", "abc", "▁▁", "ca"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]]
    pieces += [(p, -2.0 - 0.37 * i, 1) for i, p in enumerate(own)]
    write_model(tmp_path / "m.model", pieces, kind, squeeze)
    tokens, library = Codec(str(tmp_path / "m.model")), sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    assert tokens.by_word == (not squeeze)
    r = random.Random(kind)
    for text in ["", "é", "abc  ab"] + ["".join(r.choice("abc  d") for _ in range(r.randrange(14))) for _ in range(1500)]:
        ids, _ = tokens.encode(text)
        assert ids.tolist() == library.encode(text), repr(text)
        assert tokens.decode(ids.tolist()) == library.decode(ids.tolist()), repr(text)


def test_batches_run_on_the_librarys_threads():
    """In a fresh process that has encoded without threads before, a batch starts the library's pool."""
    code = (
        "import psutil, random, os\n"
        "from assaykit.llm._vocab import batch_ids, tokenizer\n"
        "import public_tokenizers\n"
        "t = tokenizer(public_tokenizers.path('byte_bpe_50k.json'))\n"
        "words = [''.join(random.choice('abcdefgh') for _ in range(12)) for _ in range(4000)]\n"
        "alone = batch_ids(t, words)\n"
        "before = psutil.Process().num_threads()\n"
        "assert batch_ids(t, words, threads=True) == alone\n"
        "after = psutil.Process().num_threads()\n"
        "assert 'TOKENIZERS_PARALLELISM' not in os.environ\n"
        "print(before, after)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], env=env, check=True)
    before, after = map(int, out.stdout.split())
    assert after > before or os.cpu_count() == 1
