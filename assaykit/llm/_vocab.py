"""Ids of whole texts as the tokenizers library gives them, faster than by encoding each word anew.

A text of ASCII and Latin letters is cut into the words that the tokenizer's own pre-tokenizer
makes; each distinct word is encoded once by the library and remembered. Any other text goes to
the library whole. Only words are remembered, never texts, in a table of bounded size.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np

#: Characters whose classes and lower case are the same in every library and Unicode version.
OTHER = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ɏ]")
#: Words longer than this are not remembered.
LONG_WORD = 32


@contextmanager
def library_threads(on: bool) -> Iterator[None]:
    """Whether the library's batch calls inside use its threads; the setting is put back afterwards."""
    name = "TOKENIZERS_PARALLELISM"
    before = os.environ.get(name)
    os.environ[name] = "true" if on else "false"
    try:
        yield
    finally:
        if before is None:
            del os.environ[name]
        else:
            os.environ[name] = before


@lru_cache(maxsize=8)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def batch_ids(library, words: list[str], threads: bool = False) -> list[list[int]]:
    """Ids of each word by one call; without threads of the library's own where Spark's tasks fill the cores."""
    with library_threads(threads):
        return [e.ids for e in library.encode_batch_fast(words, add_special_tokens=False)]


class Remembered:
    """word -> value, for values made in batches. When full, words not met since the last time are forgotten."""

    def __init__(self, make: Callable[[list[str]], list], most: int = 1_200_000):
        self.make, self.half, self.known, self.older = make, most // 2, {}, {}

    def learn(self, lists: list[list[str]]) -> None:
        """Makes, in one batch, the values of all words that are not known."""
        new: set[str] = set()
        for words in lists:
            if None in (got := list(map(self.known.get, words))):
                new.update([w for w, v in zip(words, got) if v is None])
        if new:
            self._meet(list(new))

    def _meet(self, words: list[str]) -> dict[str, object]:
        """Values of distinct words that are not known; they are, afterwards."""
        met = dict(zip(words, map(self.older.get, words)))
        new = [w for w, v in met.items() if v is None]
        if new:
            met.update(zip(new, self.make(new)))
        if len(self.known) + len(met) > self.half:
            self.older, self.known = self.known, {}
        if len(met) <= self.half:
            self.known.update(met if max(map(len, met)) <= LONG_WORD else {w: v for w, v in met.items() if len(w) <= LONG_WORD})
        return met

    def of(self, words: list[str]) -> list:
        got = list(map(self.known.get, words))
        if None not in got:
            return got
        met = self._meet(list({w for w, v in zip(words, got) if v is None}))
        return [met[w] if v is None else v for w, v in zip(words, got)]


#: How byte-level files cut texts of OTHER's complement (a fixed value of theirs).
BYTE_LEVEL_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _cuts_by_words(path: str) -> bool:
    """Whether a file's texts are cut as above before any merge, and nothing else changes them."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    return plain and not spec.get("normalizer") and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])


class TextIds:
    """ids(text): what Tokenizer.encode(text, add_special_tokens=False) gives, as a uint32 array; every id comes from the library."""

    def __init__(self, path: str):
        self.library, self.by_word = tokenizer(path), _cuts_by_words(path)
        added = self.library.get_added_tokens_decoder().values()
        self.whole = re.compile("|".join([OTHER.pattern, *(re.escape(t.content) for t in added)]))
        self.words = Remembered(lambda new: [array("I", ids).tobytes() for ids in batch_ids(self.library, new)])

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each; the words that are new go to the library in one batch."""
        lists = [None if not self.by_word or self.whole.search(t) else BYTE_LEVEL_WORDS.findall(t) for t in texts]
        self.words.learn([words for words in lists if words])
        return [self.plain(t) if words is None else np.frombuffer(b"".join(self.words.of(words)), dtype=np.uint32) for t, words in zip(texts, lists)]

    def ids(self, text: str) -> np.ndarray:
        return self.many([text])[0]


@lru_cache(maxsize=2)
def text_ids(path: str) -> TextIds:
    """One for each worker process, whose words serve all of its tasks."""
    return TextIds(path)
