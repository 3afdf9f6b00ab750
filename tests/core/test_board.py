"""Boards read from Markdown; dependencies against a search in Python."""

import random

from assaykit.operators import board
from assaykit.sources import markdown
from assaykit.sources.scratch import keeper

PAGE = """# One

| id | task | deps | status |
|---|:--|---|---|
| T0 | a \\| b | — | DONE |
| T1 | c | T0 | PENDING |
| T2 | d | T0, T1 | PENDING | left out |
| T3 | e | all | PENDING |
| T4 | f | T9 | PENDING |
| T5 | g
| T6 | h | T0 | BLOCKED — no key |

```
| id | deps |
|---|---|
| fenced | x |
```

| no | dashes |
| a | b |

## Two
| id | id |
|---|---|
| x | y |
"""


def parsed(spark, tmp_path):
    (tmp_path / "a.md").write_text(PAGE)
    (tmp_path / "b.md").write_text("no table\n")
    return markdown.read_tables(spark, str(tmp_path))


def test_tables_rows_and_cells(spark, tmp_path):
    rows = {(r.section, r.row): r.fields for r in parsed(spark, tmp_path).collect()}
    # The line without a last bar is none of cells and ends its table.
    assert set(rows) == {("One", k) for k in range(1, 6)} | {("Two", 1)}
    assert rows["One", 1] == {"id": "T0", "task": "a | b", "deps": "—", "status": "DONE"}
    assert rows["One", 3] == {"id": "T2", "task": "d", "deps": "T0, T1", "status": "PENDING"}
    assert rows["Two", 1] == {"id": "x", "id 2": "y"}


def test_boards_from_tables(spark, tmp_path):
    tasks = board.parse_board(parsed(spark, tmp_path).filter("section = 'One'"))
    assert {(r.id, tuple(r.deps), r.status, r.reason) for r in tasks.collect()} == {
        ("T0", (), "DONE", ""), ("T1", ("T0",), "PENDING", ""), ("T2", ("T0", "T1"), "PENDING", ""), ("T3", ("all",), "PENDING", ""), ("T4", ("T9",), "PENDING", ""),
    }
    assert [tuple(r) for r in board.eligible(tasks).collect()] == [("One", 2, "T1")]
    assert [tuple(r) for r in board.next_task(tasks).collect()] == [("One", 2, "T1")]


def brute_report(tasks):
    out = {}
    for b in {t[0] for t in tasks}:
        here = {}
        for _, pos, i, deps, status in sorted(t for t in tasks if t[0] == b):
            here.setdefault(i, (deps, status))
        edges = {i: {d for dep in deps for d in ((set(here) - {i}) if dep == "all" else {dep})} for i, (deps, _) in here.items()}
        for i in here:
            seen, todo = set(), list(edges[i])
            while todo:
                d = todo.pop()
                if d in here and d not in seen:
                    seen.add(d)
                    todo += edges[d]
            others = seen - {i}
            out[b, i] = (len(others), sum(here[d][1] != "DONE" for d in others), sorted(d for d in edges[i] if d not in here), i in seen)
    return out


def test_dependencies_equal_a_search(spark):
    rng = random.Random(6)
    tasks = [
        (b, k, f"T{k % 11}", rng.sample([f"T{j}" for j in range(13)], rng.randrange(3)) + (["all"] if rng.random() < 0.05 else []), rng.choice(["DONE", "PENDING", "BLOCKED"]))
        for b in "abcdef" for k in range(12)
    ]
    df = spark.createDataFrame(tasks, "board string, pos int, id string, deps array<string>, status string")
    got = {(r.board, r.id): (r.needs, r.open, r.unknown, r.cycle) for r in board.dependency_report(df, keeper(spark, "t")).collect()}
    assert got == brute_report(tasks)
    ready = {(r.board, r.id) for r in board.eligible(df).collect()}
    first = {}
    for b, pos, i, deps, status in sorted(tasks):
        first.setdefault((b, i), (deps, status))
    done = lambda b, d: first.get((b, d), (0, ""))[1] == "DONE"
    assert ready == {k for k, (deps, status) in first.items() if status == "PENDING" and all(done(k[0], d) for d in deps if d != "all") and ("all" not in deps or all(done(*o) for o in first if o[0] == k[0] and o != k))}


def test_a_long_chain_and_an_empty_board(spark):
    chain = [("b", k, f"T{k}", [f"T{k - 1}"] if k else [], "PENDING") for k in range(200)]
    schema = "board string, pos int, id string, deps array<string>, status string"
    report = board.dependency_report(spark.createDataFrame(chain, schema), keeper(spark, "t"))
    assert {r.needs for r in report.collect()} == set(range(200))
    empty = spark.createDataFrame([], schema)
    assert board.dependency_report(empty, keeper(spark, "t")).count() == board.eligible(empty).count() == 0


def test_small_boards_shuffle_no_pairs_and_large_ones_are_joined(spark):
    rng = random.Random(9)
    tasks = [
        (b, k, f"T{k}", None if k == 3 else rng.sample([f"T{j}" for j in range(n + 2)], rng.randrange(3)) + (["all", None] if k == 7 else []), rng.choice(["DONE", "PENDING", None]))
        for b, n in (("small", 9), (None, 12), ("large", 30)) for k in range(n)
    ]
    df = spark.createDataFrame(tasks, "board string, pos int, id string, deps array<string>, status string")
    want = brute_report([(b, k, i, [d for d in deps or [] if d is not None], s) for b, k, i, deps, s in tasks if b]) | {
        (None, i): r for (_, i), r in brute_report([("", k, i, [d for d in deps or [] if d is not None], s) for b, k, i, deps, s in tasks if b is None]).items()
    }
    written = []
    for most, frames in ((12, 3), (100, 1), (0, 3)):
        keep, written[:] = keeper(spark, "t"), []
        out = board.dependency_report(df, lambda f: written.append(keep(f)) or written[-1], most)
        assert {(r.board, r.id): (r.needs, r.open, r.unknown, r.cycle) for r in out.collect()} == want
        # Boards that are followed whole write no pairs.
        assert len(written) == 1 if frames == 1 else len(written) >= frames
