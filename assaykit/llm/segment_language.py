"""Language ID by unigram models marginalised over segmentations.

The pieces are those of a fixed public vocabulary. Each language has a probability for each
piece; the probability of a word is the sum, over all ways to cut it into pieces, of the
product of their probabilities, which a forward algorithm computes. A text's score is the sum
of its words' logarithms. Piece probabilities are fitted by expectation-maximisation over the
word counts of a bounded sample of labelled documents.

Words are lower-cased and cut at white space, and a word starts with the vocabulary's mark for
that; no piece crosses words, so a word's score is computed once and remembered, in a table of
bounded size. A character that no piece holds has one small probability in every language.

Defined results: a null text and one without a letter is `und` with score 0; a text of any
length is scored whole; equal texts score equally; on ties the first language by name; with no
labelled training row all is `und`; an empty table gives no rows; columns other than doc_id,
text and, for training, lang are not read. A null doc_id trains (its fold is that of the empty
text).
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import take_worker
from ._training import HELD_OUT, fold, sample_by

MARK = "▁"
#: Labelled documents of each language that are read to fit its model, about.
SAMPLE_DOCS = 200
EM_ROUNDS = 3
#: Weight of the pooled model in each language's, and the probability of a piece that was never seen or of an unknown character.
POOLED, FLOOR = 200.0, 1e-9
#: Words of a text that count as independent evidence when its score becomes a probability.
EVIDENCE = 16
LONG_WORD, KNOWN_WORDS = 48, 400_000
#: Characters of long words that are scanned side by side.
LONG_TOGETHER = 1 << 17
#: A forward value below this has lost digits or all of itself; such a word is scored with scaling.
LEAST_VALUE = 1e-250


def vocabulary(model_path: str) -> list[str]:
    """The pieces that can occur in lower-cased text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return sorted({p for p in pieces if p and p == p.lower() and MARK not in p[1:]})


class PieceTable:
    """Finds pieces by a rolling 64-bit hash of their characters, for many substrings at once.

    Numbers count from 1; 0 is an unknown character. A substring that is no piece could be taken
    for one only if their hashes agree in all 64 bits.
    """

    SLOTS = 1 << 20

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.powers = np.cumprod(np.array([1, *[self.base] * self.longest], dtype=np.uint64))
        self.slots, self.hashes, self.tries = np.zeros(self.SLOTS, dtype=np.int32), np.zeros(len(pieces) + 1, dtype=np.uint64), 1
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, piece in enumerate(pieces, 1):
            by_length[len(piece)].append(i)
        for who in by_length.values():
            self.hashes[who] = self.roll(np.array([list(map(ord, pieces[i - 1])) for i in who], dtype=np.uint64))[:, -1]
        for i, slot in enumerate(self.slot(self.hashes[1:]).tolist(), 1):
            tries = 1
            while self.slots[slot]:
                slot, tries = (slot + 1) % self.SLOTS, tries + 1
            self.slots[slot] = i
            self.tries = max(self.tries, tries)
        if len(set(self.hashes[1:].tolist())) < len(pieces):
            raise ValueError("two pieces have one hash")

    def slot(self, h):
        return (h * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(44)

    def roll(self, codes: np.ndarray) -> np.ndarray:
        """Hashes of all beginnings of each row, from none to all of it."""
        out = np.zeros((len(codes), codes.shape[1] + 1), dtype=np.uint64)
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * self.base + codes[:, j] + np.uint64(1)
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        at = self.slot(h).astype(np.int64)
        piece = self.slots[at]
        out = np.where((piece > 0) & (self.hashes[piece] == h), piece, -1)
        for _ in range(1, self.tries):
            open_ = np.flatnonzero((out < 0) & (piece > 0))
            if not len(open_):
                break
            at = (at + 1) % self.SLOTS
            piece = self.slots[at]
            out[open_] = np.where((piece[open_] > 0) & (self.hashes[piece[open_]] == h[open_]), piece[open_], -1)
        return out


class Lattice:
    """The pieces of a batch of words, shortest first; cells: end, length, which words, which pieces there."""

    def __init__(self, words: list[str], table: PieceTable):
        self.words, self.size = words, np.array([len(w) for w in words], dtype=np.int64)
        width = int(self.size.max(initial=0))
        flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        codes = np.zeros((len(words), width), dtype=np.uint64)
        codes[np.arange(width) < self.size[:, None]] = flat
        hashes = table.roll(codes)
        self.cells = []
        for j in range(1, width + 1):
            first = int(np.searchsorted(self.size, j))
            for k in range(1, min(j, table.longest) + 1):
                found = table.find(hashes[first:, j] - hashes[first:, j - k] * table.powers[k])
                if k == 1:
                    found[found < 0] = 0
                hit = np.flatnonzero(found >= 0)
                if len(hit):
                    self.cells.append((j, k, hit + first, found[hit]))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """(words, ends, languages): probability of each start of a word."""
        alpha = np.zeros((len(self.words), int(self.size.max(initial=0)) + 1, p.shape[1]))
        alpha[:, 0] = 1.0
        for j, k, who, which in self.cells:
            alpha[who, j] += alpha[who, j - k] * p[which]
        return alpha

    def expected(self, p: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often each piece is expected, the words occurring `times` in each language."""
        alpha = self.forward(p)
        beta = np.zeros_like(alpha)
        rows = np.arange(len(self.words))
        beta[rows, self.size] = 1.0
        for j, k, who, which in reversed(self.cells):
            beta[who, j - k] += beta[who, j] * p[which]
        share = times / np.maximum(alpha[rows, self.size], 1e-300)
        out = np.zeros_like(p)
        for j, k, who, which in self.cells:
            np.add.at(out, which, alpha[who, j - k] * p[which] * beta[who, j] * share[who])
        return out


class LongWords:
    """Lattices of words of any length, cut into chunks of CHUNK characters that are scanned side by side.

    A forward value depends on the `longest` values before it. From each of these places by itself, all
    chunks are scanned at once, a character of each at a time; that gives every chunk's effect on the values
    before it, and a walk over the chunks their true beginnings. Values are scaled as they shrink, with the
    logarithms of the scales kept beside them.
    """

    CHUNK, EASE = 128, 4
    #: The code of places that no word has; no piece holds it.
    OUTSIDE = np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, words: list[str], table: PieceTable):
        self.longest, none, copy = table.longest, len(table.hashes), len(table.hashes) + 1
        self.sizes = [len(w) for w in words]
        self.chunks = [-(-n // self.CHUNK) for n in self.sizes]
        self.begin = np.cumsum([0, *self.chunks])
        cells = int(self.begin[-1]) * self.CHUNK
        codes, place = np.full(cells, self.OUTSIDE, dtype=np.uint64), np.zeros(cells, dtype=np.int64)
        for w, n, at in zip(words, self.sizes, self.begin * self.CHUNK):
            codes[at : at + n] = np.frombuffer(w.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
            place[at : at + n] = np.arange(1, n + 1)
        # The piece of each length that ends at each character; behind a word's end its last value is copied.
        self.ending = np.full((self.longest + 1, cells), none, dtype=np.int32)
        rolled = np.zeros(cells, dtype=np.uint64)
        for k in range(1, min(self.longest, cells) + 1):
            rolled = codes[: cells - k + 1] * table.powers[k - 1] + (rolled[1:] if k > 1 else rolled)
            found = table.find(rolled)
            self.ending[k, k - 1 :] = np.where(place[k - 1 :] >= k, np.where(found >= 0, found, 0 if k == 1 else none), copy if k == 1 else none)

    def _backwards(self) -> LongWords:
        """The same lattices read from the other end."""
        out = object.__new__(LongWords)
        out.__dict__ |= self.__dict__
        out.ending = np.full_like(self.ending, self.ending.max(initial=0))
        none = int(self.ending[0, 0]) if self.ending.size else 0
        out.ending[:] = none
        out.ending[1] = none + 1
        for n, at in zip(self.sizes, self.begin * self.CHUNK):
            for k in range(1, min(self.longest, n) + 1):
                out.ending[k, at + k - 1 : at + n] = self.ending[k, at + k - 1 : at + n][::-1]
        return out

    def _scan(self, p: np.ndarray, start: np.ndarray, chunks: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start: (longest, chunks, ..., languages), the values before each of these chunks, latest last. The last values, their log scales, and if kept all of both."""
        m, count = self.longest, len(chunks)
        ring, scale = start.copy(), np.zeros((count, p.shape[1]))
        more = (slice(None),) + (None,) * (start.ndim - 3)
        cells = self.ending.reshape(m + 1, -1, self.CHUNK)[:, chunks]
        values = np.empty((self.CHUNK, *start.shape[1:])) if keep else np.empty(0)
        scales = np.empty((self.CHUNK, count, p.shape[1])) if keep else np.empty(0)
        none = len(p) - 2
        for j in range(self.CHUNK):
            now = np.zeros(start.shape[1:])
            for k in range(1, m + 1):
                which = cells[k, :, j]
                if (which != none).any():
                    now += ring[(j - k) % m] * p[which][more]
            ring[j % m] = now
            if j % self.EASE == self.EASE - 1:
                top = ring.max(axis=(0, *range(2, ring.ndim - 1)))
                ring /= top[more]
                now = ring[j % m]
                scale += np.log(top)
            if keep:
                values[j], scales[j] = now, scale
        order = [(self.CHUNK - m + i) % m for i in range(m)]
        return ring[order], scale, values, scales

    def _starts(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(longest, chunks, languages) values before each chunk, their log scales, and each word's log probability."""
        m, languages, count = self.longest, p.shape[1], int(self.begin[-1])
        starts, scales, logs = np.zeros((m, count, languages)), np.zeros((count, languages)), np.zeros((len(self.sizes), languages))
        # A word's first chunk begins with a value that is known; only the others need their effect on any.
        first = self.begin[:-1]
        starts[-1, first] = 1.0
        after, after_scale, _, _ = self._scan(p, starts[:, first], first)
        later = np.setdiff1d(np.arange(count), first)
        place = np.searchsorted(later, np.arange(count))
        units = np.zeros((m, len(later), m, languages))
        units[np.arange(m), :, np.arange(m)] = 1.0
        ends, scale, _, _ = self._scan(p, units, later) if len(later) else (units, np.zeros((0, languages)), None, None)
        for w, (a, b) in enumerate(zip(self.begin, self.begin[1:])):
            now, log = after[:, w], after_scale[w]
            for c in range(a + 1, b):
                top = now.max(axis=0)
                now, log = now / top, log + np.log(top)
                starts[:, c], scales[c] = now, log
                now, log = np.einsum("oig,ig->og", ends[:, place[c]], now), log + scale[place[c]]
            logs[w] = np.log(now[-1]) + log
        return starts, scales, logs

    @staticmethod
    def _extended(p: np.ndarray) -> np.ndarray:
        """p with a row of noughts, for no piece, and one of ones, for a copy."""
        return np.concatenate([p, np.zeros((1, p.shape[1])), np.ones((1, p.shape[1]))])

    def logs(self, p: np.ndarray) -> np.ndarray:
        """(words, languages): log of each word's probability."""
        return self._starts(self._extended(p))[2]

    def _values(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward value and log scale at each character, and the words' log probabilities."""
        starts, before, logs = self._starts(p)
        _, _, values, scales = self._scan(p, starts, np.arange(int(self.begin[-1])), True)
        flat = lambda x: x.transpose(1, 0, 2).reshape(-1, p.shape[1])
        return flat(values), flat(scales + before), logs

    def add_expected(self, p: np.ndarray, times: np.ndarray, seen: np.ndarray) -> None:
        """Adds to `seen` how often each piece is expected, the words occurring `times` in each language."""
        p = self._extended(p)
        ahead, ahead_log, logs = self._values(p)
        back, back_log, _ = self._backwards()._values(p)
        for w, (n, at) in enumerate(zip(self.sizes, self.begin * self.CHUNK)):
            one = lambda x, edge: np.concatenate([np.full((1, p.shape[1]), edge), x[at : at + n]])  # noqa: B023, E731
            a, la, b, lb = one(ahead, 1.0), one(ahead_log, 0.0), one(back, 1.0)[::-1], one(back_log, 0.0)[::-1]
            for k in range(1, min(self.longest, n) + 1):
                which = self.ending[k, at + k - 1 : at + n]
                hit = np.flatnonzero(which < len(p) - 2)
                if len(hit):
                    share = np.exp(la[hit] + lb[hit + k] - logs[w]) * a[hit] * b[hit + k] * p[which[hit]] * times[w]
                    np.add.at(seen, which[hit], share)


@dataclass
class SegmentationModel:
    """pieces[i] has probabilities p[i + 1]; row 0 is that of an unknown character."""

    languages: list[str]
    pieces: list[str]
    p: np.ndarray
    table: PieceTable = field(init=False)

    def __post_init__(self) -> None:
        self.table = PieceTable(self.pieces)

    def log_words(self, words: list[str]) -> np.ndarray:
        """(words, languages): log of each word's probability, over all its segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        short, long = [i for i, w in enumerate(words) if len(w) <= LONG_WORD], [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        for at in range(0, len(short), 4096):
            some = sorted(short[at : at + 4096], key=lambda i: len(words[i]))
            lattice = Lattice([words[i] for i in some], self.table)
            value = lattice.forward(self.p)[np.arange(len(some)), lattice.size]
            exact = value.min(axis=1, initial=1.0) >= LEAST_VALUE
            rows = np.array(some, dtype=np.int64)
            out[rows[exact]] = np.log(value[exact])
            long += rows[~exact].tolist()
        for some in _together(long, words):
            out[some] = LongWords([words[i] for i in some], self.table).logs(self.p)
        return out

    def score(self, words: list[str], logs: np.ndarray) -> tuple[str, float]:
        total = logs.sum(axis=0)
        eased = (total - total.max()) * min(1.0, EVIDENCE / max(1, len(words)))
        best = int(np.argmax(total))
        return self.languages[best], float(1.0 / np.exp(eased).sum())


def _together(which: Iterable[int], words: list[str]) -> Iterator[list[int]]:
    """Numbers of words, in groups of about LONG_TOGETHER characters."""
    group, size = [], 0
    for i in which:
        group.append(i)
        size += len(words[i])
        if size > LONG_TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


def fit(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = EM_ROUNDS) -> SegmentationModel:
    """counts: for each language, how often each word (with its mark) occurs."""
    languages = sorted(counts)
    model = SegmentationModel(languages, pieces, np.full((len(pieces) + 1, len(languages)), FLOOR))
    every = sorted({w for c in counts.values() for w in c}, key=lambda w: (len(w), w))
    each = np.array([[counts[g].get(w, 0) for g in languages] for w in every], dtype=float).reshape(len(every), len(languages))
    short = sum(len(w) <= LONG_WORD for w in every)
    words, times = every[:short], each[:short]
    lattices = [(Lattice(words[a : a + 8192], model.table), times[a : a + 8192]) for a in range(0, len(words), 8192)]
    long = [(LongWords([every[i] for i in some], model.table), each[some]) for some in _together(range(short, len(every)), every)]
    p = np.full_like(model.p, 1.0 / max(1, len(pieces)))
    for _ in range(rounds):
        p[0] = FLOOR
        seen = sum((lattice.expected(p, t) for lattice, t in lattices), np.zeros_like(p))
        for lattice, t in long:
            lattice.add_expected(p, t, seen)
        seen[0] = 0
        pooled = seen.sum(axis=1, keepdims=True) / max(seen.sum(), 1e-300)
        p = np.maximum((seen + POOLED * pooled) / (seen.sum(axis=0) + POOLED), FLOOR)
    p[0] = FLOOR
    model.p = p
    return model


def train(docs: DataFrame, model_path: str, sample_docs: int = SAMPLE_DOCS) -> SegmentationModel:
    """Fits on about sample_docs labelled documents of each language outside the held-out fold."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & (fold() != HELD_OUT))
    sample, _ = sample_by(rows, "lang", sample_docs)
    words = sample.select("lang", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")).alias("w")).filter("w <> ''")
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, w, n in words.groupBy("lang", "w").count().toLocalIterator():
        counts[lang][MARK + w] = n
    return fit(dict(counts), vocabulary(model_path))


class Scorer:
    """Scores texts; remembers words' values."""

    def __init__(self, model: SegmentationModel):
        self.model, self.row, self.logs, self.n = model, {}, np.zeros((KNOWN_WORDS, len(model.languages))), 0

    def _rows(self, texts: list[list[str]]) -> None:
        get = self.row.get
        new = list({w for words in texts for w in words if get(w) is None})
        if self.n + len(new) > len(self.logs):
            self.row, self.n = {}, 0
            new = list({w for words in texts for w in words})
            if len(new) > len(self.logs):
                self.logs = np.zeros((len(new), len(self.model.languages)))
        if new:
            self.logs[self.n : self.n + len(new)] = self.model.log_words([MARK + w for w in new])
            self.row.update(zip(new, range(self.n, self.n + len(new))))
            self.n += len(new)

    def many(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [(t or "").lower().split() for t in texts]
        if not self.model.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        self._rows(split)
        langs, scores = [], []
        for text, words in zip(texts, split):
            if not text or not any(map(str.isalpha, text)):
                lang, score = "und", 0.0
            else:
                lang, score = self.model.score(words, self.logs[np.fromiter(map(self.row.__getitem__, words), dtype=np.int64, count=len(words))])
            langs.append(lang)
            scores.append(score)
        return langs, scores


def _parts(model: SegmentationModel) -> tuple:
    return model.languages, model.pieces, model.p


_SCORER: dict[str, Scorer] = {}


def _scorer(name: str, parts: tuple) -> Scorer:
    """One for each worker process; its words serve all of that worker's tasks."""
    take_worker("language", _SCORER.clear)
    if name not in _SCORER:
        _SCORER.clear()
        _SCORER[name] = Scorer(SegmentationModel(*parts))
    return _SCORER[name]


def score_languages(docs: DataFrame, model: SegmentationModel) -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(_parts(model))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, shared.value)
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for at in range(0, batch.num_rows, 128):
                a, b = scorer.many(batch.column("text").slice(at, 128).to_pylist())
                langs += a
                scores += b
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify_languages(spark: SparkSession, docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    scored = score_languages(docs, train(docs, model_path))
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "lang_pred", "score")


def keep_languages(docs: DataFrame, model_path: str, least_score: float) -> DataFrame:
    """The rows of docs whose language is determined with at least that score, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(_parts(train(docs, model_path)))
    name = uuid.uuid4().hex

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        scorer, out = _scorer(name, shared.value), []
        values = texts.tolist()
        for at in range(0, len(values), 128):
            out += [lang != "und" and score >= least_score for lang, score in zip(*scorer.many(values[at : at + 128]))]
        return pd.Series(out, dtype=bool)

    return docs.filter(known("text"))
