"""Cheapest repair of conversations by lazy weighted determinisation.

A repaired conversation's roles match `(s?(ua)+)?` by their initials. Edits of a row: Keep costs 0,
Rerole to user or assistant 2, Delete 3; Insert of an empty user or assistant row costs 2 anywhere.
Blank rows and repeated ones must go; an undeleted truncated row adds 1.

The costs of finishing from each of the grammar's four states form a vector. Less its least entry it
is a state of a deterministic automaton that is built as rows ask for it: a table holds, for a state
and a row's symbol, the next state and what the step adds. A scan of the table from the last row to
the first gives the least cost. The trace then goes back over the scan, from the first row on, along
arcs that the costs hold tight, and takes the least letter of D, I, K and R at each turn. Equal cost
and equal rows read leave no edit string a prefix of another, so that is the least string of all, and
it fixes the repaired rows too.

Rows are dealt out by ranges of (conversation, turn, role, text), so no conversation has to fit one
task. One that lies inside a task is repaired there. One that meets a task's edge, or is longer than
ROWS, goes on as blocks: each block's costs are a 4 x 4 matrix in (min, +); the blocks' matrices give
the costs at every block's end, these the state in which it is entered, and then each is traced by
itself. Only the digest of a repaired conversation reads its blocks' lines one after another.

Defined results: rows of a conversation stand by turn (nulls first), then role, then text; a null conv_id
is a conversation; in the checksum, in role and in text null is one space; turns that are null count in
no gap; a conversation of which no row is left has zeros and an empty audit; rows repeated whole are
rows of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Workspace

#: Rows and bytes of text that a task holds of one conversation at most before it writes a block.
ROWS, BYTES = 4096, 4 << 20
#: The grammar's states: nothing yet, after the system row, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Which state an inserted row, or one of another role, leads to, and what its role is.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("", "system", "user", "assistant")
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
RETYPED, DELETED, INSERTED = 2, 3, 2
INF = 1 << 60
#: Symbol of a row that must go; others are twice the place of the initial, plus 1 if truncated.
GONE = 8
SPACE = " \t\n\x0b\x0c\r"


def _closed(costs: Iterable[int]) -> tuple[int, ...]:
    """Costs from each state where rows may be inserted first."""
    out = list(costs)
    for _ in range(3):
        out = [min(c, INSERTED + out[NEXT[x]]) for x, c in enumerate(out)]
    return tuple(min(c, INF) for c in out)


#: Costs after the last row.
END = _closed((0, INF, INF, 0))


def _kept(x: int, symbol: int) -> int | None:
    """The state after a kept row, None where the grammar refuses it."""
    role = "sua".find("sua?"[symbol >> 1]) + 1
    if role == SYSTEM:
        return SYSTEM if x == START else None
    return role if role and NEXT[x] == role else None


class CostAutomaton:
    """States are normalised cost vectors; the table is filled as it is asked."""

    def __init__(self):
        self.ids: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.table: list[list[tuple[int, int] | None]] = []
        self.moves: dict[tuple[int, int, int], tuple[str, int, tuple[str, ...], str | None]] = {}

    def state(self, costs: Iterable[int]) -> tuple[int, int]:
        """Number of the normalised vector, and what was taken off."""
        costs = tuple(costs)
        least = min(costs)
        if least >= INF:
            raise ValueError("no state can finish")
        vector = tuple(INF if c >= INF else c - least for c in costs)
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append([None] * (GONE + 1))
        return self.ids[vector], least

    def before(self, state: int, symbol: int) -> tuple[int, int]:
        """State before a row of this symbol, given the one after it, and what the step adds."""
        step = self.table[state][symbol]
        if step is None:
            after, costs = self.vectors[state], []
            for x in range(4):
                least = DELETED + after[x]
                if symbol != GONE:
                    broken, kept = symbol & 1, _kept(x, symbol)
                    least = min(least, RETYPED + broken + after[NEXT[x]], INF if kept is None else broken + after[kept])
                costs.append(least)
            step = self.table[state][symbol] = self.state(_closed(costs))
        return step

    def scan(self, symbols: bytes, end: Iterable[int]) -> tuple[list[int], int]:
        """States before each row and after the last, and the cost that was taken off all of them."""
        state, cost = self.state(end)
        states = [state]
        for symbol in reversed(symbols):
            step = self.table[state][symbol]
            state, added = step or self.before(state, symbol)
            cost += added
            states.append(state)
        states.reverse()
        return states, cost

    def move(self, x: int, symbol: int, after: int) -> tuple[str, int, tuple[str, ...], str | None]:
        """Tight edits at a row that is met in x: their letters, the next x, lines to insert, and the row's role (None: deleted, empty: its own)."""
        at = (x, symbol, after)
        if at not in self.moves:
            before, added = self.before(after, symbol)
            here, there = self.vectors[before], self.vectors[after]
            letters, lines = "", []
            while True:
                broken, kept = symbol & 1, None if symbol == GONE else _kept(x, symbol)
                if here[x] + added == DELETED + there[x]:
                    found = letters + "D", x, tuple(lines), None
                elif here[x] == INSERTED + here[NEXT[x]]:
                    x = NEXT[x]
                    letters += "I"
                    lines.append(ROLE[x] + ":")
                    continue
                elif kept is not None and here[x] + added == broken + there[kept]:
                    found = letters + "K", kept, tuple(lines), ""
                else:
                    found = letters + "R", NEXT[x], tuple(lines), ROLE[NEXT[x]]
                break
            self.moves[at] = found
        return self.moves[at]

    def trace(self, symbols: bytes, states: list[int], x: int, last: bool) -> Iterator[tuple[str, int, tuple[str, ...], str | None]]:
        """A move for each row, and after the last row of a conversation one of insertions."""
        for symbol, after in zip(symbols, states[1:]):
            found = self.move(x, symbol, after)
            x = found[1]
            yield found
        if last:
            rest = []
            while x not in (START, ASSISTANT):
                x = NEXT[x]
                rest.append(ROLE[x] + ":")
            yield "I" * len(rest), x, tuple(rest), None


AUTOMATON = CostAutomaton()


class Facts:
    """What a stretch of a conversation's rows has: symbols, faults, turns and its ends; adjoining stretches add up."""

    def __init__(self, turns: list, roles: list[str], texts: list[str], repeated: Iterable[int] = ()):
        self.blank = self.duplicate = self.truncated = 0
        symbols, seen, again = bytearray(), set(), set(repeated)
        for k, (role, text) in enumerate(zip(roles, texts)):
            said, known = text.rstrip(SPACE), (role, text) in seen or k in again
            seen.add((role, text))
            if not said:
                self.blank += 1
            elif known:
                self.duplicate += 1
            broken = said and not known and said[-1] not in ".!?"
            self.truncated += bool(broken)
            symbols.append(GONE if not said or known else 2 * "sua".find(role[:1]) + bool(broken) if role[:1] and role[0] in "sua" else 6 + bool(broken))
        self.symbols = bytes(symbols)
        initials = [r[:1] for r in roles]
        self.illegal = sum(pair not in LEGAL for pair in zip(initials, initials[1:]))
        self.first, self.last = (initials[0], initials[-1]) if initials else (None, None)
        numbers = [t for t in turns if t is not None]
        self.least, self.most = (numbers[0], numbers[-1]) if numbers else (None, None)
        self.distinct = len(set(numbers))

    def add(self, later: Facts) -> None:
        """Takes in the stretch that follows; symbols stay behind."""
        self.blank, self.duplicate, self.truncated = self.blank + later.blank, self.duplicate + later.duplicate, self.truncated + later.truncated
        self.illegal += later.illegal + (self.last is not None and later.first is not None and (self.last, later.first) not in LEGAL)
        self.distinct += later.distinct - (self.most is not None and self.most == later.least)
        self.first, self.last = later.first if self.first is None else self.first, self.last if later.last is None else later.last
        self.least, self.most = later.least if self.least is None else self.least, self.most if later.most is None else later.most

    def counts(self) -> list[int]:
        """gaps, blank, duplicate, truncated, illegal."""
        return [0 if self.least is None else self.most - self.least + 1 - self.distinct, self.blank, self.duplicate, self.truncated, self.illegal]


def _lines(roles: list[str], texts: list[str], moves: Iterable[tuple[str, int, tuple[str, ...], str | None]]) -> tuple[str, list[str], int]:
    """Audit, repaired lines, and the state at the end."""
    audit, lines, x = [], [], START
    for k, (letters, x, before, role) in enumerate(moves):
        audit.append(letters)
        lines += before
        if role is not None:
            lines.append(f"{role or roles[k]}:{texts[k]}")
    return "".join(audit), lines, x


def repair(turns: list, roles: list[str], texts: list[str]) -> tuple:
    """The result of a whole conversation: counts, cost, audit, digest of its lines."""
    facts = Facts(turns, roles, texts)
    states, cost = AUTOMATON.scan(facts.symbols, END)
    cost += AUTOMATON.vectors[states[0]][START]
    audit, lines, _ = _lines(roles, texts, AUTOMATON.trace(facts.symbols, states, START, True))
    return *facts.counts(), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damage(rows: DataFrame) -> DataFrame:
    """Rows of conversations with faults put in by checksum; kept is false for dropped ones, which stay so that their conversation does."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text["role"].alias("role"), text["text"].alias("text"), (F.crc32(F.concat_ws(":", text["conv_id"], text["turn"])) % 20).alias("fault"))
    out = out.withColumn("text", F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))).withColumn("kept", F.col("fault") != 0)
    twice = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.withColumn("copy", F.explode(twice)).select("conv_id", "turn", "role", "text", "kept")


class _Rows:
    """Rows of Arrow output, let go in batches."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size + 100
        if self.size > BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
        self.rows, self.size = [], 0


_LONGS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = [*((n, pa.int64()) for n in _LONGS), ("audit", pa.string()), ("repaired_sha256", pa.string())]
_BLOCK = [("rid", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
_SQL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>", pa.bool_(): "boolean"}


def _mapped(df: DataFrame, fields: list[tuple[str, pa.DataType]], run: Callable[[Iterator[pa.RecordBatch], _Rows], Iterator[pa.RecordBatch]]) -> DataFrame:
    """df through run, which fills rows of conv_id and these fields."""
    kind = df.schema["conv_id"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None
        for batch in batches:
            if rows is None:
                rows = _Rows(pa.schema([("conv_id", batch.schema.field("conv_id").type), *fields]))
                stream = run(_chain(batch, batches), rows)
                yield from stream
        if rows is not None:
            yield from rows.flush()

    return df.mapInArrow(go, ", ".join([f"conv_id {kind}", *(f"{n} {_SQL[t]}" for n, t in fields)]))


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _form(batches: Iterator[pa.RecordBatch], out: _Rows, most: int) -> Iterator[pa.RecordBatch]:
    """Results of the conversations that lie inside a task, and blocks of the others, of so many rows at most; rows come in order."""
    key, held, size, edge, begun = None, None, 0, True, False
    nothing, no_block = (None,) * len(_RESULT), (None,) * len(_BLOCK)

    def block() -> tuple:
        return (key, *nothing, held[0], *held[1:])

    for batch in batches:
        conv, rid, turn, role, text, kept = (batch.column(c).to_pylist() for c in ("conv_id", "rid", "turn", "role", "text", "kept"))
        for k in range(len(conv)):
            if not begun or conv[k] != key:
                if begun:
                    yield from out.add(block() if edge else (key, *repair(*held[1:]), *no_block), size)
                    edge = False
                key, held, size, begun = conv[k], (rid[k], [], [], []), 0, True
            elif len(held[2]) >= most or size >= BYTES:
                yield from out.add(block(), size)
                held, size, edge = (rid[k], [], [], []), 0, True
            if kept[k]:
                held[1].append(turn[k])
                held[2].append(role[k])
                held[3].append(text[k])
                size += len(text[k])
    yield from out.add(block(), size)


def _repeated(blocks: DataFrame) -> DataFrame:
    """rid, again: which rows of a block stand earlier in their conversation."""
    each = blocks.select("conv_id", "rid", F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "row")).select("conv_id", "rid", "pos", "row.roles", "row.texts", (F.col("rid") + F.col("pos")).alias("at"))
    first = each.groupBy("conv_id", "roles", "texts").agg(F.min("at").alias("at")).select("at")
    return each.select("rid", "pos", "at").join(first, "at", "left_anti").groupBy("rid").agg(F.collect_list(F.col("pos").cast("long")).alias("again"))


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names))


_FACTS = [("rid", pa.int64()), ("symbols", pa.binary()), ("counted", pa.list_(pa.int64())), ("ends", pa.list_(pa.string())), ("turns", pa.list_(pa.int64())), ("matrix", pa.list_(pa.int64()))]


def _summarise(batches: Iterator[pa.RecordBatch], out: _Rows) -> Iterator[pa.RecordBatch]:
    """Each block's symbols, counts, ends, and its costs from every state to every other."""
    for batch in batches:
        for conv, rid, turns, roles, texts, again in _columns(batch, "conv_id", "rid", "turns", "roles", "texts", "again"):
            f = Facts(turns, roles, texts, again or ())
            matrix = []
            for y in range(4):
                states, cost = AUTOMATON.scan(f.symbols, [0 if x == y else INF for x in range(4)])
                matrix += [min(INF, c + cost) for c in AUTOMATON.vectors[states[0]]]
            yield from out.add((conv, rid, f.symbols, [f.blank, f.duplicate, f.truncated, f.illegal, f.distinct], [f.first, f.last], [f.least, f.most], matrix), len(f.symbols))


def _sums(counted: list[int], ends: list[str | None], turns: list[int | None]) -> Facts:
    f = Facts([], [], [])
    f.blank, f.duplicate, f.truncated, f.illegal, f.distinct = counted
    (f.first, f.last), (f.least, f.most) = ends, turns
    return f


_ENDS = [("rid", pa.int64()), ("end", pa.list_(pa.int64())), ("last", pa.bool_()), ("stats", pa.list_(pa.int64()))]


def _backwards(batches: Iterator[pa.RecordBatch], out: _Rows) -> Iterator[pa.RecordBatch]:
    """Costs at each block's end, whether it is the last, and with the first block the conversation's counts; blocks come latest first."""
    waiting = None
    for batch in batches:
        for conv, rid, counted, ends, turns, matrix in _columns(batch, "conv_id", "rid", "counted", "ends", "turns", "matrix"):
            f = _sums(counted, ends, turns)
            last = waiting is None or waiting[0] != conv
            if not last:
                yield from out.add((*waiting, None))
                f.add(sums)
            elif waiting:
                yield from out.add((*waiting, [*sums.counts(), cost + costs[START]]))
            end, cost = (END, 0) if last else (costs, cost)
            waiting, sums = (conv, rid, list(end), last), f
            # Closed costs at the end make closed ones at the beginning.
            costs = [min(INF, *(matrix[4 * y + x] + end[y] for y in range(4))) for x in range(4)]
            least = min(costs)
            costs, cost = [c - least if c < INF else INF for c in costs], cost + least
    yield from out.add((*waiting, [*sums.counts(), cost + costs[START]]))


def _exits(batches: Iterator[pa.RecordBatch], out: _Rows) -> Iterator[pa.RecordBatch]:
    """For each state in which a block can be entered, the one in which it is left."""
    for batch in batches:
        for conv, rid, symbols, end in _columns(batch, "conv_id", "rid", "symbols", "end"):
            states, _ = AUTOMATON.scan(symbols, end)
            left = []
            for x in range(4):
                if AUTOMATON.vectors[states[0]][x] < INF:
                    for _, x, _, _ in AUTOMATON.trace(symbols, states, x, False):
                        pass
                left.append(x)
            yield from out.add((conv, rid, left))


def _forwards(batches: Iterator[pa.RecordBatch], out: _Rows) -> Iterator[pa.RecordBatch]:
    """The state in which each block is entered; blocks come earliest first."""
    key, x = object(), START
    for batch in batches:
        for conv, rid, left in _columns(batch, "conv_id", "rid", "left"):
            x = x if conv == key else START
            yield from out.add((conv, rid, x))
            key, x = conv, left[x]


def _trace(batches: Iterator[pa.RecordBatch], out: _Rows) -> Iterator[pa.RecordBatch]:
    """Each block's part of the audit and its repaired lines."""
    for batch in batches:
        for conv, rid, roles, texts, symbols, end, last, stats, x in _columns(batch, "conv_id", "rid", "roles", "texts", "symbols", "end", "last", "stats", "entry"):
            states, _ = AUTOMATON.scan(symbols, end)
            audit, lines, _ = _lines(roles, texts, AUTOMATON.trace(symbols, states, x, last))
            joined = "\n".join(lines) if lines else None
            yield from out.add((conv, rid, audit, joined, stats), len(joined or ""))


def _digest(batches: Iterator[pa.RecordBatch], out: _Rows) -> Iterator[pa.RecordBatch]:
    """Results of conversations whose blocks come one after another."""

    def result() -> tuple:
        return key, *stats, "".join(audit), digest.hexdigest()

    key, begun = None, False
    for batch in batches:
        for conv, part, lines, counted in _columns(batch, "conv_id", "audit", "lines", "stats"):
            if not begun or conv != key:
                if begun:
                    yield from out.add(result())
                key, begun, stats, audit, digest, empty = conv, True, counted, [], hashlib.sha256(), True
            audit.append(part)
            if lines is not None:
                digest.update((lines if empty else "\n" + lines).encode())
                empty = False
    if begun:
        yield from out.add(result())


def repair_conversations(spark: SparkSession, rows: DataFrame, block_rows: int = ROWS) -> DataFrame:
    """One row per conv_id of rows (conv_id, turn long, role, text, kept): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows that are not kept only name their conversation. The result is the same for any length of blocks.
    """
    work, order = Workspace(spark, "conversations"), ["conv_id", "turn", "role", "text"]
    # The last key only parts rows that are equal in all others, so that a range can end among them.
    dealt = rows.withColumn("rid", F.monotonically_increasing_id()).repartitionByRange(*order, "rid").sortWithinPartitions(*order, "rid")
    formed = work.table(_mapped(dealt.withColumn("rid", F.monotonically_increasing_id()), [*_RESULT, *_BLOCK], partial(_form, most=block_rows)), "formed")
    results = [n for n, _ in _RESULT]
    whole, blocks = formed.filter("rid is null").select("conv_id", *results), formed.filter("rid is not null").select("conv_id", *(n for n, _ in _BLOCK))
    again = work.table(_repeated(blocks), "again")
    facts = work.table(_mapped(blocks.join(again, "rid", "left"), _FACTS, _summarise), "facts")

    def in_order(df: DataFrame, rid) -> DataFrame:
        return df.repartition("conv_id").sortWithinPartitions("conv_id", rid)

    ends = work.table(_mapped(in_order(facts.drop("symbols"), F.desc("rid")), _ENDS, _backwards), "ends").drop("conv_id")
    ended = facts.select("conv_id", "rid", "symbols").join(ends, "rid")
    exits = _mapped(ended, [("rid", pa.int64()), ("left", pa.list_(pa.int64()))], _exits)
    entries = work.table(_mapped(in_order(exits, F.asc("rid")), [("rid", pa.int64()), ("entry", pa.int64())], _forwards), "entries").drop("conv_id")
    traced = blocks.drop("turns").join(ended.drop("conv_id"), "rid").join(entries, "rid")
    pieces = _mapped(traced, [("rid", pa.int64()), ("audit", pa.string()), ("lines", pa.string()), ("stats", pa.list_(pa.int64()))], _trace)
    rest = _mapped(in_order(pieces, F.asc("rid")), _RESULT, _digest)
    return whole.unionByName(rest)
