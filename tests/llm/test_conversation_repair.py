import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from assaykit.llm import conversation_repair as repair
from assaykit.llm.queries import ORACLE_SQL, op13_conversation_repair


def brute_repair(rows):
    """Cheapest edit strings first, then ASCII-least, by a best-first search over whole strings."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, x, lines = heapq.heappop(heap)
        if (i, x) in done:
            continue
        done.add((i, x))
        if i == len(rows) and x in (0, 3):
            return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())

        def put(letter, role, text, more, used):
            to = "sua".find(role[:1] or "?") + 1
            if (to, x) in {(1, 0), (2, 0), (2, 1), (2, 3), (3, 2)}:
                heapq.heappush(heap, (cost + more, audit + letter, i + used, to, (*lines, f"{role}:{text}")))

        for role in ("user", "assistant"):
            put("I", role, "", 2, 0)
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, x, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                put("K", role, text, more, 1)
                for new in ("user", "assistant"):
                    put("R", new, text, 2 + more, 1)


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        here = out.setdefault(conv, [])
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        k, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        here += [] if k == 0 else [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    for here in out.values():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


ROLES = ["user", "assistant", "system", "user", "assistant", "user", "assistant", "tool", "", " "]
TEXTS = ["", "a.", "b", "c!", " \x0b", "d e", "f?", "g. \n", " ", "h. i.", "é."]


def conversations(seed, n, longest=9):
    rng = random.Random(seed)
    return [(c, rng.choice([None, *range(12)]) if rng.random() < 0.2 else t, rng.choice([*ROLES, None]) if rng.random() < 0.3 else ROLES[t % 2], rng.choice([*TEXTS, None]) if rng.random() < 0.5 else f"line {t}.") for c in range(n) for t in range(rng.randrange(longest))]


def results(frame):
    got = [tuple(r) for r in frame.collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


def test_whole_conversations_equal_brute_force():
    rng = random.Random(1)
    for _ in range(4000):
        rows = [(rng.choice([None, *range(9)]), rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(rng.randrange(9))]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        assert repair.repair(*(list(c) for c in zip(*rows))) == brute_repair(rows) if rows else repair.repair([], [], []) == brute_repair(rows)


@pytest.mark.parametrize("block_rows", [1, 3, repair.ROWS])
def test_blocks_of_any_length_equal_brute_force(spark, block_rows):
    rows = conversations(3, 60) + [(900, t, ROLES[(t * t) % 7], f"t{t % 40}" + ".x"[t % 3 == 0]) for t in range(150)] + [(None, 1, "user", "hi."), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = results(repair.repair_conversations(spark, repair.damage(frame), block_rows))
    assert got == {c: brute_repair(r) for c, r in damaged(rows).items()}


def test_query_its_sql_and_brute_force_agree(spark, tmp_path):
    rows = conversations(7, 300) + [(901, t, "user", "same.") for t in range(30)]
    rows.append((next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "dropped."))
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, audit string, kept int")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    want = {c: brute_repair(r) for c, r in damaged(rows).items()}
    assert results(op13_conversation_repair(spark, str(tmp_path))) == want
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        assert {r[0]: r[1:] for r in db.sql(ORACLE_SQL["op13_conversation_repair"]).fetchall()} == want


def test_one_conversation_longer_than_a_task(spark):
    rows = [(1, k // 3, ROLES[k % 2], f"text {k % 700}.") for k in range(3000)] + [(0, 0, "user", "a."), (2, 0, "user", "b.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    blocks, whole = (results(repair.repair_conversations(spark, repair.damage(frame), n)) for n in (64, 100_000))
    assert blocks == whole == {c: brute_repair(r) for c, r in damaged(rows).items()}


def test_rows_that_are_equal_in_everything(spark):
    rows = [(1, None, "user", "again.")] * 500
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert results(repair.repair_conversations(spark, repair.damage(frame), 16)) == {1: brute_repair(damaged(rows)[1])}


def test_few_automaton_states():
    assert len(repair.AUTOMATON.vectors) < 64


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_conversations(spark, repair.damage(frame)).count() == 0
