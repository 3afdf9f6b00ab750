"""Byte-level BPE over padded matrices: texts to ids as a rank file's own library gives them, and back.

A text is cut by the file's pattern. Each new distinct word becomes a row of byte ids in a padded
matrix with other words of about its length. In every round each row merges its leftmost pair of
least rank; pairs are looked up in a hash table of arrays, rows close up by one place, and rows that
are done leave the matrix. Only words are remembered, in a table of bounded size.

A word of more than WIDEST bytes is a row by itself, in which one round merges every occurrence of the
least pair, as long as no pair that this makes ranks below it (else the leftmost occurrence only).

Defined results: a null text is empty and has no ids; special strings are ordinary text; a text or
word of any length is encoded whole; rows repeated get a row each; an empty table gives no rows;
columns other than doc_id and text are not read. Decoding refuses ids that the file does not have.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._vocab import BYTE_LEVEL_WORDS, OTHER, Remembered

#: Longest row of a shared matrix, in bytes; cells of one matrix.
WIDEST, CELLS = 1024, 1 << 18
#: Rank of a pair that does not merge.
NEVER = np.int32(np.iinfo(np.int32).max)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, of a file whose lines hold base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> id of the merged token, in open-addressed arrays that are probed for many pairs at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(8, int(len(left)).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, NEVER, dtype=np.int32)
        keys, at = (left.astype(np.int64) << 32) | right, np.arange(len(left))
        slots = self._slots(keys)
        while len(at):
            free = self.keys[slots] < 0
            _, first = np.unique(slots[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slots[put]], self.values[slots[put]] = keys[at[put]], merged[at[put]]
            rest = np.ones(len(at), dtype=bool)
            rest[put] = False
            at, slots = at[rest], (slots[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of pairs, NEVER where there is none; a negative id has no pairs."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slots = self._slots(keys)
        met = self.keys[slots]
        found = np.where(met == keys, self.values[slots], NEVER)
        open_ = np.flatnonzero((met != keys) & (met >= 0) & (keys >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            met = self.keys[slots[open_]]
            hit = met == keys[open_]
            found[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (met >= 0)]
        return found


class ByteCodec:
    """encode and decode with one rank file and one pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the rank file has no token for the bytes {missing}")
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        splits = [(l, r, rank) for token, rank in self.ranks.items() for k in range(1, len(token)) if (l := self.ranks.get(token[:k])) is not None and (r := self.ranks.get(token[k:])) is not None]
        self.pairs = PairTable(*np.array(splits, dtype=np.int64).reshape(-1, 3).T)
        self.words = Remembered(lambda new: [ids.tobytes() for ids in self.merge([w.encode() for w in new])])
        self.cut = regex.compile(pattern)
        #: The installed pattern cuts texts without OTHER's characters as `re` does with this one.
        self.plain = BYTE_LEVEL_WORDS if pattern == _PATTERN else None

    def split(self, text: str) -> list[str]:
        if self.plain and not OTHER.search(text):
            return self.plain.findall(text)
        like = text.translate(stand_ins())
        if like is text or like == text:
            return [m.group() for m in self.cut.finditer(text)]
        return [text[m.start() : m.end()] for m in self.cut.finditer(like)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text; the words that are new are merged together."""
        lists = [self.split(t) for t in texts]
        words = list(set().union(*lists))
        known = dict(zip(words, self.words.of(words)))
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), dtype=np.uint32) for words in lists]

    def decode(self, ids: np.ndarray) -> bytes:
        try:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        except KeyError as e:
            raise ValueError(f"id {e.args[0]} is not in the rank file") from None

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """ids of words that no pattern cuts any more."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(words)
        buckets: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            if len(word) > WIDEST:
                out[at] = self._merge_long(word)
            elif word:
                buckets.setdefault(_width(len(word)), []).append(at)
        for width, places in sorted(buckets.items()):
            step = max(1, CELLS // width)
            for lo in range(0, len(places), step):
                some = places[lo : lo + step]
                for at, ids in zip(some, self._merge_rows([words[a] for a in some], width)):
                    out[at] = ids
        return out

    def _merge_rows(self, words: list[bytes], width: int) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        inside = np.arange(width) < sizes[:, None]
        ids = np.full((len(words), width), -1, dtype=np.int32)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        # One column more than there are pairs, so that ranks close up as ids do.
        ranks = np.full((len(words), width), NEVER, dtype=np.int32)
        ranks[:, :-1] = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), width - 1)
        rows, out = np.arange(len(words)), [None] * len(words)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NEVER
            if done.any():
                for row, line, n in zip(rows[done].tolist(), ids[done], sizes[done].tolist()):
                    out[row] = line[:n].astype(np.uint32)
                left = ~done
                rows, sizes, ids, ranks, at, best = rows[left], sizes[left], ids[left], ranks[left], at[left], best[left]
                if not len(rows):
                    break
            most = int(sizes.max())
            place = np.arange(most - 1)
            source = place + (place > at[:, None])
            ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
            line = np.arange(len(rows))
            ids[line, at], sizes = best, sizes - 1
            for left in (at - 1, at):
                pair = (left >= 0) & (left + 1 < sizes)
                row, col = line[pair], left[pair]
                ranks[row, col] = self.pairs(ids[row, col], ids[row, col + 1])
            ranks[line, sizes - 1] = NEVER
        return out

    def _merge_long(self, word: bytes) -> np.ndarray:
        ids = np.append(self.byte_ids[np.frombuffer(word, dtype=np.uint8)], np.int32(-1))
        n = len(word)
        ranks = np.append(self.pairs(ids[:-1], ids[1:]), NEVER)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        gone = 0
        while (best := ranks.min()) != NEVER:
            at = np.flatnonzero(ranks == best)
            if len(at) > 1:
                # Of occurrences that overlap, every other one, from the left.
                linked = np.append(False, after[at[:-1]] == at[1:])
                starts = np.flatnonzero(~linked)
                at = at[(np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))) % 2 == 0]
                last, following = before[at], after[after[at]]
                merged = np.full(len(at), best, dtype=np.int32)
                left = np.where(np.append(False, after[after[at[:-1]]] == at[1:]), best, ids[last])
                if (self.pairs(np.where(last < 0, -1, left), merged) < best).any() or (self.pairs(merged, ids[following]) < best).any():
                    at = at[:1]
            right = after[at]
            following = after[right]
            after[at], before[following] = following, at
            ids[at], ids[right], ranks[right] = best, -1, NEVER
            gone += len(at)
            for lefts in (before[at], at):
                lefts = lefts[lefts >= 0]
                ranks[lefts] = self.pairs(ids[lefts], ids[after[lefts]])
            if gone > 1024 and 2 * gone > len(ids):
                live = np.append(np.flatnonzero(ids[:-1] >= 0), len(ids) - 1)
                ids, ranks, gone = ids[live], ranks[live], 0
                after, before = np.arange(1, len(ids) + 1), np.arange(-1, len(ids) - 1)
        return ids[ids >= 0].astype(np.uint32)


def _width(n: int) -> int:
    """Rows of n bytes go into matrices this wide: powers of two and the midpoints between them."""
    power = 1 << max(1, (n - 1).bit_length())
    return power * 3 // 4 if n <= power * 3 // 4 else power


#: The pattern of this family of files (a fixed value), for which texts of common characters are cut by `re`.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=1)
def stand_ins() -> dict[int, str]:
    """Characters that the rank files' library and `regex` class differently, as their Unicode versions differ, to one of the library's class."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    out = {}
    for kind, like in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\t")):
        library = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks=single, special_tokens={})
        theirs, ours = set(bytes(library.encode_ordinary(every)).decode()), set(regex.findall(kind, every))
        out |= {ord(c): "!" for c in ours - theirs if ord(c) not in out} | {ord(c): like for c in theirs - ours}
    return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteCodec:
    """One for each worker process, whose words serve all of its tasks."""
    return ByteCodec(path, pattern)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _slices(batches):
            ids = codec(path, pattern).encode(some.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, content binary, of doc_id and ids; null ids are none. The content is UTF-8 where the ids stand for a whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _slices(batches):
            content = [codec(path, pattern).decode(np.array(i or [], dtype=np.int64)) for i in some.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(content, pa.binary())], names=["doc_id", "content"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, content binary")


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, of which only digests leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _slices(batches):
            coder = codec(path, pattern)
            ids = coder.encode(some.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    some.column("doc_id"),
                    pa.array(map(len, ids), pa.int64()),
                    pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(coder.decode(i)).hexdigest() for i in ids]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
