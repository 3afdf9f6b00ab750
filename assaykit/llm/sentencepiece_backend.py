"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read here: pieces with scores and types, the trainer's and the
normaliser's settings. From them the same tokenizer is rebuilt in the tokenizers library: the
normaliser with its character map, white space marker and dummy prefix; a unigram model with
its scores, or a BPE model whose merges are ordered by the scores of what they make; byte
fallback; and the decoder. Batches of distinct words are encoded by the library's threads.

No piece goes on beyond a marker that follows another character, which is checked, so a text's
ids are those of its words, each with the markers before it; a word's ids are computed once and
remembered, in a table of bounded size. Parity is verified on every word when it is first met:
the ids must be those of the sentencepiece library. Whole texts are decoded again by query.

Defined results: a null or empty text has no ids; a text of any length is encoded whole; rows
repeated get a row each; an empty table gives no rows; other columns are not read. A text that
holds the marker character itself decodes to a space there, as in the library, and so has no
round trip.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import row_keys
from ._vocab import Remembered, batch_ids

MARK = "▁"
#: Piece types and model types of the published protobuf schema (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Threads of the library that parity is held against; the tokenizers library has a pool of its own.
THREADS = 2


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as int, all else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool
    suffix: bool


def parse(path: str) -> Model:
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, types, trainer, normaliser = [], [], [], {}, {}
    for number, value in wire(data):
        if number == 1:
            piece = dict(wire(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
            types.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(wire(value))
        elif number == 3:
            normaliser = dict(wire(value))
    return Model(
        pieces, scores, types, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normaliser.get(2, b""), bool(normaliser.get(3, 1)),
        bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)), bool(trainer.get(24, 0)),
    )


def build(model: Model):
    """The model as a Tokenizer."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if model.kind not in (UNIGRAM, BPE) or model.suffix or not model.escape:
        raise ValueError("only unigram and BPE models with markers before words are rebuilt")
    index = {p: i for i, p in enumerate(model.pieces)}
    unknown = model.types.index(UNKNOWN)
    if model.kind == UNIGRAM:
        core = models.Unigram(list(zip(model.pieces, model.scores)), unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        normal = {p for p, t in zip(model.pieces, model.types) if t in (NORMAL, USER_DEFINED)}
        made = sorted((i for i, (p, t) in enumerate(zip(model.pieces, model.types)) if t == NORMAL and len(p) > 1), key=lambda i: (-model.scores[i], i))
        merges = [(p[:k], p[k:]) for p in (model.pieces[i] for i in made) for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        core = models.BPE(index, merges, unk_token=model.pieces[unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])]
    )
    if own := [p for p, t in zip(model.pieces, model.types) if t == USER_DEFINED]:
        tokenizer.add_tokens([AddedToken(p, normalized=True, special=False) for p in own])
    return tokenizer


class Codec:
    """encode(text) -> (ids, whether every word agrees with the sentencepiece library)."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = parse(path)
        self.library = build(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = all(MARK not in p.lstrip(MARK) for p, t in zip(self.model.pieces, self.model.types) if t == NORMAL)
        self.lone = [self.library.token_to_id(MARK)] if MARK in self.model.pieces else []
        self.by_word = plain and bool(self.lone) and self.model.dummy_prefix and not self.model.squeeze and not self.model.charsmap and USER_DEFINED not in self.model.types
        self.words = Remembered(self._new)
        self.spelt = [bytes([int(p[1:-1], 16)]) if t == BYTE else p.replace(MARK, " ").encode() for p, t in zip(self.model.pieces, self.model.types)]
        self.compared, self.differ = False, set()

    def _new(self, words: list[str]) -> list[bytes]:
        """Words as they stand in the text, a space in front of each; those that the reference encodes otherwise are noted."""
        bare = [w[1:] for w in words]
        ids = batch_ids(self.library, bare, threads=True)
        same = self.reference.encode(bare, num_threads=THREADS)
        # A marker alone is a text's end; the libraries see an empty text there.
        if ids != same:
            self.differ.update(w for w, i, s in zip(words, ids, same) if i != s)
        return [array("I", i if b else self.lone).tobytes() for b, i in zip(bare, ids)]

    def encode(self, text: str) -> tuple[np.ndarray, bool]:
        if not text:
            return np.zeros(0, dtype="<u4"), True
        if not self.by_word:
            ids = self.library.encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype="<u4"), ids == self.reference.encode(text)
        return self._ids(WORD.findall(" " + text))

    def _ids(self, words: list[str]) -> tuple[np.ndarray, bool]:
        return np.frombuffer(b"".join(self.words.of(words)), dtype="<u4"), not self.differ or self.differ.isdisjoint(words)

    def encode_many(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        """encode() of each; the words that are new go to the libraries in one batch."""
        if not self.by_word:
            return [self.encode(t) for t in texts]
        lists = [WORD.findall(" " + t) if t else [] for t in texts]
        self.words.learn(lists)
        return list(map(self._ids, lists))

    def decode(self, ids: list[int]) -> str:
        """The pieces' spellings joined, as the library's decoder joins them; bytes that are no UTF-8 are left to the library.

        The first text of each worker is compared with the library's.
        """
        try:
            text = b"".join(map(self.spelt.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            return self.library.decode(ids, skip_special_tokens=False)
        text = text[1:] if self.model.dummy_prefix and text.startswith(" ") else text
        if not self.compared:
            if text != self.library.decode(ids, skip_special_tokens=False):
                raise ValueError("the two decoders disagree")
            self.compared = True
        return text


#: A word with the spaces or markers before it; markers in the text stand for spaces.
WORD = re.compile(f"[ {MARK}]+[^ {MARK}]*")


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One for each worker process."""
    return Codec(path)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, th, ids (array<int>), verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                got = tokens.encode_many(some.column("text").to_pylist())
                ends = np.cumsum([0, *(len(i) for i, _ in got)]).astype(np.int32)
                flat = np.concatenate([i for i, _ in got]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("th"), ids, pa.array([g for _, g in got])], names=["doc_id", "th", "ids", "verified"]
                )

    rows = row_keys(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "th", "text")
    return rows.mapInArrow(run, "doc_id long, th long, ids array<int>, verified boolean")


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """doc_id, th, ids -> doc_id, th, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                texts = [tokens.decode(ids) for ids in some.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("th"), pa.array(texts, pa.string())], names=["doc_id", "th", "text"])

    return rows.select("doc_id", "th", "ids").mapInArrow(run, "doc_id long, th long, text string")


def encode_and_check(spark: SparkSession, docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), decoded_crc32, round_trip, parity.

    The ids are decoded again, whole; round_trip: the decoded text is the document's. parity: no
    word's ids differ from those of the sentencepiece library.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(model_path)
        names = ["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "round_trip", "parity"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        for batch in batches:
            out: list[tuple] = []
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                texts = [t or "" for t in some.column("text").to_pylist()]
                got = tokens.encode_many(texts)
                back = [tokens.decode(i.tolist()) for i, _ in got]
                for doc_id, text, (ids, good), b in zip(some.column("doc_id").to_pylist(), texts, got, back):
                    out.append((doc_id, len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(b.encode()), b == text, good))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=names)

    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean, parity boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
