"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Fixed patterns find e-mail addresses, IP addresses, card and phone numbers. Those entities are
the seeds of a bootstrap, and so are secrets: long runs of letters and digits in a random-looking
mixture. An instance is a seed, any other token with a digit or an @, a run of such tokens, or,
in contexts of few ordinary words, any token at all. The words beside an instance make its lexical
patterns:

* two words to the left, or one on each side, of which one at least has a letter or digit, with the instance's form (its length if it is one
  run of digits, hexadecimal digits or letters and digits; its punctuation otherwise), with its
  family (digits, digits with letters, an address, letters), and alone. Alone counts only where
  sown instances of several families show that the context doesn't go with one;
* one word on the left or on the right, with the form; only fixed patterns' matches sow these.

On the graph of patterns and instances, Spark scores in turns:

* a pattern by the lower confidence bound of its distinct instances' mean score, so that a pattern
  is judged by how many it has and by how far they spread beyond the seeds;
* an instance that is no seed by its most confident pattern. Those above CONFIDENT sow patterns
  in the next turn, also patterns that no seed has.

A pattern below GATE, or sown less than LEAST_SEEDS times, lends nothing. GATE is three times the
share of random numbers that pass a card's check. Patterns that reach LEAST_SCORE after ROUNDS
turns are believed, and what stands in them, wherever it occurs, is personal data of kind
`context`. The graph holds no text beyond tokens and contexts; tokens and context words of more
than LONG characters are held as digests.

Tokens without a digit or an @ are most of a text. They are counted in the contexts that hold
instances of several families, found by a bit map of fixed size and then exactly; where there are
at most PLAIN of them for each instance, they are instances themselves.

Defined results: a null or empty text has no spans; texts of any length are read whole; equal
texts get equal spans; matches of one kind don't overlap, those of different kinds may;
rows repeated get a row each and count once in the graph; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Workspace, fresh, join_same, row_keys, take_worker

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
#: Turns of scoring; the least sown instances, and the least score, of a believed pattern; what a pattern must reach to lend its score; what an instance must reach to sow.
ROUNDS, LEAST_SEEDS, LEAST_SCORE, GATE, CONFIDENT = 5, 5, 0.5, 0.3, 0.5
#: Ordinary words for each marked instance in a context that may count alone; the bound's normal quantile; places of a pattern's edges.
PLAIN, BOUND_Z, SALTS = 2, 1.645, 16
#: Characters of a token or context word that is held as it is; a secret's least length, and changes between letters and digits; bits of the map (as a power of two).
LONG, SECRET_LENGTH, SECRET_TURNS, MAP_BITS = 64, 32, 8, 22
#: What an instance is: a fixed pattern's match, a secret (1), or neither (0).
BASE = 2
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS, DIGIT = re.compile(r"[0-9]+"), re.compile(r"[0-9]")
EDGES = "\"'`.,;:!?()[]{}<>|*$&#=/\\"
#: Of these, what ends a run of tokens.
ENDS = EDGES.translate({ord("("): None, ord(")"): None})

MARKED, TOKEN = re.compile("[0-9@]"), re.compile(r"\S+")
HEX, RUN, TURN = re.compile("[0-9a-f]+"), re.compile(r"[^\W\d_]+|\d+"), re.compile(r"[0-9](?=[^\W\d_])|[^\W\d_](?=[0-9])")
SPANS = "array<struct<kind:string,start:int,stop:int>>"
INSTANCE = "struct<start:int,stop:int,token:string,seed:int,form:string,family:string,contexts:array<struct<c:string,k:long>>>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match holds one @, and starts as far left of it as the local part reaches or the last match ended."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = "".join(DIGITS.findall(m.group()))
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m.group())) <= 15]
    return out


def form(token: str) -> str:
    """Length of a run of digits (9), hexadecimal digits (x) or letters and digits (w); else the runs of digits (9) and letters (a) with the punctuation between."""
    if token.isdigit():
        return f"9:{len(token)}"
    if token.isalnum():
        kind = "a" if token.isalpha() else "x" if HEX.fullmatch(token) else "w"
        return f"{kind}:{len(token)}" if kind != "w" or len(token) < 32 else "w:32+"
    return _brief(RUN.sub(lambda m: "9" if m.group().isdigit() else "a", token))


def family(token: str) -> str:
    """What forms come down to: an address, digits with letters, digits, or letters."""
    if "@" in token:
        return "@"
    letters = any(map(str.isalpha, token))
    return "a" if letters and not DIGIT.search(token) else "a9" if letters else "9"


def is_secret(token: str) -> bool:
    """A run of letters and digits, at least SECRET_LENGTH, that changes between the two at least SECRET_TURNS times."""
    return len(token) >= SECRET_LENGTH and token.isalnum() and len(TURN.findall(token)) >= SECRET_TURNS


def _brief(word: str) -> str:
    return word if len(word) <= LONG else f"{len(word)}#{xxhash.xxh64_hexdigest(word)}"


@lru_cache(maxsize=1 << 18)
def _word(word: str) -> tuple[str, int, bool]:
    """A context word as patterns hold it, its hash, and whether it holds a letter or digit."""
    brief = _brief(DIGIT.sub("0", word.lower()))
    return brief, xxhash.xxh64_intdigest(brief), any(map(str.isalnum, word))


def _words_before(text: str, at: int, n: int) -> list[str]:
    out: list[str] = []
    while at and len(out) < n:
        while at and text[at - 1].isspace():
            at -= 1
        stop = at
        while at and not text[at - 1].isspace():
            at -= 1
        if at < stop:
            out.append(text[at:stop])
    return out[::-1]


def _word_after(text: str, at: int) -> str:
    while at < len(text) and text[at].isspace():
        at += 1
    stop = at
    while stop < len(text) and not text[stop].isspace():
        stop += 1
    return text[at:stop]


def _mixed(a, b, side: int):
    """Hash of a two-word context from its words' hashes: numbers, or arrays of them."""
    return a * MIX[0] ^ b * MIX[1] ^ MIX[2 + side]


def _key(a: int, b: int, side: int) -> int:
    k = ((a * int(MIX[0])) ^ (b * int(MIX[1])) ^ int(MIX[2 + side])) & ((1 << 64) - 1)
    return k - (1 << 64) if k >> 63 else k


def _contexts(text: str, start: int, stop: int) -> list[dict]:
    """c: a lexical context of a span; k: its hash, null for one of a single word. Words are those beside the tokens that the span lies in."""
    while start and not text[start - 1].isspace():
        start -= 1
    while stop < len(text) and not text[stop].isspace():
        stop += 1
    left = [_word(w) for w in _words_before(text, start, 2)]
    right = [_word(w) for w in [_word_after(text, stop)] if w]
    out = []
    if len(left) == 2 and (left[0][2] or left[1][2]):
        out.append({"c": f"{left[0][0]} {left[1][0]} _", "k": _key(left[0][1], left[1][1], 0)})
    if left and right and (left[-1][2] or right[0][2]):
        out.append({"c": f"{left[-1][0]} _ {right[0][0]}", "k": _key(left[-1][1], right[0][1], 1)})
    if left and left[-1][2]:
        out.append({"c": f"{left[-1][0]} _", "k": None})
    if right and right[0][2]:
        out.append({"c": f"_ {right[0][0]}", "k": None})
    return out


def _patterns(s: str) -> Column:
    """pattern, k, wide and weak of each pattern of an instance. wide: a context alone; weak: a context of one word."""
    wide, weak = F.lit(True), F.lit(False)

    def each(c: Column) -> Column:
        one = lambda kind, is_wide, is_weak: F.struct(F.concat_ws(" ", c["c"], kind).alias("pattern"), c["k"].alias("k"), is_wide.alias("wide"), is_weak.alias("weak"))
        exact = lambda is_weak: one(F.concat(F.lit("="), f"{s}.form"), ~wide, is_weak)
        return F.when(c["k"].isNull(), F.array(exact(~weak))).otherwise(F.array(exact(weak), one(F.concat(F.lit("~"), f"{s}.family"), ~wide, weak), one(F.lit("*"), wide, weak)))

    return F.flatten(F.transform(f"{s}.contexts", each))


def _bare(text: str, a: int, b: int) -> tuple[int, int]:
    """A span without the punctuation at its ends."""
    while a < b and text[a] in EDGES:
        a += 1
    while a < b and text[b - 1] in EDGES:
        b -= 1
    return a, b


def candidates(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or an @, and runs of such with one space between them, bare of punctuation, that touch no base span.

    Of those that overlap, a run comes after its tokens.
    """
    done, spans, at = 0, sorted((a, b) for _, a, b in taken), 0
    first, last, parts = 0, -2, 0

    def touches(a: int, b: int) -> bool:
        """Spans that end before this token are passed for good; a run is looked up from its first token on."""
        nonlocal at
        while at < len(spans) and spans[at][1] <= first and spans[at][1] <= a:
            at += 1
        for x, y in spans[at:]:
            if x >= b:
                return False
            if a < y:
                return True
        return False

    def run() -> Iterator[tuple[int, int]]:
        a, b = _bare(text, first, last)
        if parts > 1 and a < b and not touches(a, b):
            yield a, b

    for m in MARKED.finditer(text):
        if m.start() < done:
            continue
        a, b = m.span()
        while a > done and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        done = b
        # Punctuation other than brackets ends a run, and so does a base span.
        if parts and a == last + 1 and text[last] in " \xa0" and text[last - 1] not in ENDS and text[a] not in ENDS and not touches(a, b):
            parts, last = parts + 1, b
        else:
            yield from run()
            first, last, parts = a, b, int(not touches(a, b))
        a, b = _bare(text, a, b)
        if a < b and not touches(a, b):
            yield a, b
    yield from run()


def _instance(text: str, a: int, b: int, seed: int) -> dict:
    token = text[a:b].lower()
    return {"start": a, "stop": b, "token": _brief(token), "seed": seed or int(is_secret(token)), "form": form(token), "family": family(token), "contexts": _contexts(text, a, b)}


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
_CONTEXTS = pa.list_(pa.struct([("c", pa.string()), ("k", pa.int64())]))
_SEEN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("token", pa.string()), ("seed", pa.int32()), ("form", pa.string()), ("family", pa.string()), ("contexts", _CONTEXTS)]))


def _keyed(docs: DataFrame) -> DataFrame:
    return row_keys(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "th")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: its base spans, and the marked instances that it holds with their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("personal data", _word.cache_clear)
        for batch in batches:
            spans, seen = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                tokens = [(a, b, BASE) for _, a, b in base] + ([(a, b, 0) for a, b in candidates(text, base)] if MARKED.search(text) else [])
                spans.append([{"kind": k, "start": a, "stop": b} for k, a, b in base])
                seen.append([_instance(text, *t) for t in tokens])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(spans, _SPANS), pa.array(seen, _SEEN)], names=["doc_id", "th", "spans", "seen"])

    return _keyed(docs).mapInArrow(run, f"doc_id long, th long, spans {SPANS}, seen array<{INSTANCE}>")


def bit_map(keys: DataFrame) -> np.ndarray:
    """A map of MAP_BITS bits, set at the keys k; what reaches the driver is at most one row for each 32 bits."""
    at = f"shiftrightunsigned(k, {64 - MAP_BITS})"
    words = keys.groupBy(F.expr(f"{at} div 32").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({at} % 32 as int)))").alias("b")).collect()
    out = np.zeros((1 << MAP_BITS) // 32, dtype=np.uint32)
    for r in words:
        out[r["w"]] = r["b"]
    return out


def _plain_hits(text: str, bits: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Which word of a text without digits or @ stands in a mapped context: word number, side, and the context's words' numbers."""
    words = text.split()
    if len(words) < 3:
        return
    seen = [_word(w) for w in words]
    h = np.fromiter((w[1] for w in seen), dtype=np.uint64, count=len(words))
    lexical = np.fromiter((w[2] for w in seen), dtype=bool, count=len(words))
    for side, beside in ((0, slice(1, -1)), (1, slice(2, None))):
        keys = _mixed(h[:-2], h[beside], side)
        slot = (keys >> np.uint64(64 - MAP_BITS)).astype(np.int64)
        mapped = bits[slot >> 5] >> (slot & 31).astype(np.uint32) & np.uint32(1)
        for i in np.flatnonzero(mapped.astype(bool) & (lexical[:-2] | lexical[beside])).tolist():
            at = i + 2 - side
            if not MARKED.search(words[at]):
                yield at, int(keys[i].astype(np.int64)), side, i


def count_plain(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """k, n: how many tokens without digits or @ stand in each context of the map, and in those that share its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("personal data", _word.cache_clear)
        for batch in batches:
            n: Counter[int] = Counter()
            for value in batch.column("text"):
                n.update(k for _, k, *_ in _plain_hits(value.as_py() or "", bits))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], names=["k", "n"])

    return _keyed(docs).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def plain_instances(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """doc_id, th, s, k: tokens without digits or @ in the contexts of the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("personal data", _word.cache_clear)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for doc_id, th, value in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), batch.column("text")):
                text = value.as_py() or ""
                hits = list(_plain_hits(text, bits))
                places = [m.span() for m in TOKEN.finditer(text)] if hits else []
                for at, k, *_ in hits:
                    a, b = _bare(text, *places[at])
                    s = _instance(text, a, b, 0)
                    s["contexts"] = [c for c in s["contexts"] if c["k"] == k]
                    if a < b:
                        for column, v in zip(out, (doc_id, th, s, k)):
                            column.append(v)
            kinds = (pa.int64(), pa.int64(), _SEEN.value_type, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "th", "s", "k"])

    return _keyed(docs).mapInArrow(run, f"doc_id long, th long, s {INSTANCE}, k long")


def instances(docs: DataFrame, found: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """doc_id, th, s of all instances, and the contexts k that may count alone."""
    marked = found.select("doc_id", "th", F.explode("seen").alias("s"))
    each = marked.select("s.token", "s.family", F.explode("s.contexts").alias("c")).filter("c.k is not null")
    able = each.groupBy(F.col("c.k").alias("k")).agg(F.count_distinct("family").alias("families"), F.count_distinct("token").alias("tokens"), F.count("*").alias("marked"))
    able = work.table(able.filter((F.col("families") > 1) & (F.col("tokens") >= LEAST_SEEDS)).select("k", "marked"), "able")
    plain = work.table(count_plain(docs, bit_map(able)), "plain") if not able.isEmpty() else None
    if plain is None:
        return marked, able.select("k")
    few = able.join(plain, "k", "left").filter(F.coalesce("n", F.lit(0)) <= PLAIN * F.col("marked")).select("k")
    few = work.table(few, "few")
    if few.isEmpty():
        return marked, few
    hits = plain_instances(docs, bit_map(few)).join(few, "k", "left_semi").select("doc_id", "th", "s")
    return marked.unionByName(work.table(hits, "plain_instances")), few


def lower_bound(mean: Column, n: Column) -> Column:
    """Of the share of which `mean` was seen in n: Wilson's bound, one-sided at 95 %."""
    z2 = BOUND_Z**2
    return (mean + z2 / (2 * n) - BOUND_Z * F.sqrt((mean * (1 - mean) + z2 / (4 * n)) / n)) / (1 + z2 / n)


def believed_patterns(each: DataFrame, alone: DataFrame, work: Workspace, rounds: int = ROUNDS) -> DataFrame:
    """pattern, score of the patterns that are believed after some turns on the graph; each: s; alone: k of contexts that may count alone."""
    links = each.select(F.explode(_patterns("s")).alias("p"), "s.token", "s.family", "s.seed").select("p.*", "token", "family", "seed")
    links = links.filter(~F.col("wide")).unionByName(links.filter("wide").join(alone, "k", "left_semi").select(links.columns))
    edges = links.groupBy("pattern", "wide", "weak", "token", "family").agg(F.max("seed").alias("seed"))
    # A pattern of too few instances can never be believed, nor lend a score.
    able = edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_SEEDS).select("pattern")
    salt = F.pmod(F.xxhash64("token"), F.lit(SALTS)).cast("int")
    edges = work.table(edges.join(able, "pattern").withColumn("salt", salt), "edges")
    scores = edges.select("token", F.lit(0.0).alias("score")).distinct()
    good = (F.col("sown") >= LEAST_SEEDS) & (F.col("confidence") >= GATE) & (~F.col("wide") | (F.col("families") > 1))
    for r in range(rounds):
        scores = work.table(scores, f"instances{r}")
        value = F.when(F.col("seed") > 0, 1.0).otherwise(F.col("score"))
        sown = F.when(F.col("weak"), F.col("seed") == BASE).otherwise(value >= CONFIDENT)
        held = edges.join(scores, "token").withColumn("v", value).withColumn("sow", sown)
        sums = [F.avg("v").alias("mean"), F.count("*").alias("n"), F.sum(F.col("sow").cast("int")).alias("sown"), F.size(F.collect_set(F.when(F.col("sow"), F.col("family")))).alias("families")]
        patterns = held.groupBy("pattern", "wide").agg(*sums).withColumn("confidence", lower_bound(F.col("mean"), F.col("n")))
        patterns = work.table(patterns.filter(good).select("pattern", "confidence"), f"patterns{r}")
        # A pattern may hold a third of all instances: its edges meet it in SALTS places.
        dealt = patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        best = edges.join(dealt, ["pattern", "salt"]).groupBy("token").agg(F.max("confidence").alias("best"))
        scores = scores.join(best, "token", "left").select("token", F.coalesce("best", F.lit(0.0)).alias("score"))
    return patterns.filter(F.col("confidence") >= LEAST_SCORE).select("pattern", F.col("confidence").alias("score"))


def _apart(spans: str) -> Column:
    """Of spans that overlap, the one that starts first, and of those the longest."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] == b["start"], b["stop"] - a["stop"]).otherwise(a["start"] - b["start"]))
    none = F.array().cast(SPANS)
    return F.aggregate(order, none, lambda out, s: F.when((F.size(out) == 0) | (F.try_element_at(out, F.lit(-1))["stop"] <= s["start"]), F.concat(out, F.array(s))).otherwise(out))


def find_spans(spark: SparkSession, docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """One row per row of docs: doc_id, th, spans, more: the base spans by kind and start, and those found by context."""
    work = work or Workspace(spark, "pii")
    found = work.table(scan(docs), "found")
    each, alone = instances(docs, found, work)
    good = work.table(believed_patterns(each, alone, work), "believed")
    places = each.filter(F.col("s.seed") < BASE).select("doc_id", "th", "s.start", "s.stop", F.explode(_patterns("s")).alias("p")).select("doc_id", "th", "start", "stop", "p.pattern")
    places = places.join(good, "pattern", "left_semi")
    more = places.groupBy("doc_id", "th").agg(F.collect_set(F.struct(F.lit(CONTEXT).alias("kind"), "start", "stop")).alias("more")).withColumn("more", _apart("more"))
    none = F.array().cast(SPANS)
    return join_same(found.drop("seen"), more, ["doc_id", "th"], "left").select("doc_id", "th", "spans", F.coalesce("more", none).alias("more"))


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def find_personal_data(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows = find_spans(spark, docs)
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long) as n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_joined("spans"), 256).alias("base_sha256"), _joined(F.concat("spans", "more")).alias("spans"))


def _cuts(spans: DataFrame) -> DataFrame:
    """Overlapping spans become one of the first one's kind: doc_id, th, cuts in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("personal data", _word.cache_clear)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            out = []
            for found in batch.column("found").to_pylist():
                cuts: list[dict] = []
                for s in sorted(found, key=lambda s: (s["start"], -s["stop"])):
                    if cuts and s["start"] < cuts[-1]["stop"]:
                        cuts[-1]["stop"] = max(cuts[-1]["stop"], s["stop"])
                    else:
                        cuts.append(dict(s))
                out.append(cuts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(out, kind)], names=["doc_id", "th", "cuts"])

    return spans.mapInArrow(run, f"doc_id long, th long, cuts {SPANS}")


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with each run of spans replaced by its first kind in brackets; n_chars, where it is a column, follows the text."""
    work = Workspace(spark, "redaction")
    found = find_spans(spark, docs, work).filter("size(spans) + size(more) > 0").select("doc_id", "th", F.concat("spans", "more").alias("found"))
    cuts = work.table(_cuts(found.dropDuplicates(["doc_id", "th"])), "cuts")
    th, at = fresh(docs.columns, "th", "cuts")
    cuts = cuts.select("doc_id", F.col("th").alias(th), F.col("cuts").alias(at))
    keyed = docs.withColumn(th, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    rows = join_same(keyed, cuts.hint("shuffle_hash"), ["doc_id", th], "left")
    before = f"if(i = 0, 0, {at}[i - 1].stop)"
    pieces = F.expr(f"transform({at}, (c, i) -> concat(substring(text, {before} + 1, c.start - {before}), '[', upper(c.kind), ']'))")
    clean = F.concat(F.array_join(pieces, ""), F.expr(f"substring(text, element_at({at}, -1).stop + 1)"))
    hit = F.col(at).isNotNull()
    out = rows.withColumn("text", F.when(hit, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
