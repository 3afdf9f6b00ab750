"""Task boards and the claims ledger.

A task has a board, an id, a pos on its board, a status and deps, ids of the same board; "all" in deps
stands for every other task of it.

Defined results: an id that stands on a board more than once is its first row's; a dep that the board
does not have is unknown, and its task never ready; a task is ready by its own deps alone, so one on a
cycle waits until another of the cycle is DONE; a null board is a board; a task without an id is no task; an empty board gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import same

#: Tasks of a board that is followed as a whole; larger boards are joined.
MOST_TOGETHER = 256


def parse_board(tables: DataFrame, board: str = "section") -> DataFrame:
    """board, pos, id, deps, status, reason of the rows of Markdown tables with the columns id, deps and status."""
    field = lambda name: F.trim(F.coalesce(F.col("fields")[name], F.lit("")))
    named = F.filter(F.transform(F.split(field("deps"), ","), lambda d: F.trim(d)), lambda d: ~d.isin("", "—", "-"))
    status = F.regexp_extract(field("status"), r"^([A-Z_]*)", 1)
    return tables.select(F.col(board).alias("board"), F.col("row").alias("pos"), field("id").alias("id"), named.alias("deps"), status.alias("status"), F.regexp_extract(field("status"), r"^BLOCKED\s*—\s*(.*)$", 1).alias("reason")).filter("id <> ''")


def _tasks(board: DataFrame) -> DataFrame:
    """One row per board and id."""
    return board.filter("id is not null").groupBy("board", "id").agg(F.min_by(F.struct("pos", "deps", "status"), "pos").alias("t")).select("board", "id", "t.*")


def dependencies(board: DataFrame) -> DataFrame:
    """board, id, dep, dep_status of each direct dependency; dep_status is null where the board has no such task."""
    tasks = _tasks(board)
    ids = tasks.select("board", F.col("id").alias("dep"), F.coalesce("status", F.lit("")).alias("dep_status"))
    named = same(tasks.select("board", "id", F.explode(F.array_distinct(F.filter("deps", lambda d: d != "all"))).alias("dep")), ids, ["board", "dep"], "left")
    every = same(tasks.filter(F.array_contains("deps", "all")).select("board", "id"), ids, ["board"]).filter("id <> dep")  # the tasks of one board
    return named.unionByName(every).distinct()


def eligible(board: DataFrame) -> DataFrame:
    """board, pos, id of PENDING tasks whose dependencies are all DONE."""
    waiting = dependencies(board).filter(F.coalesce(F.col("dep_status") != "DONE", F.lit(True))).select("board", "id").distinct()
    pending = _tasks(board).filter("status = 'PENDING'").select("board", "pos", "id")
    return same(pending, waiting, ["board", "id"], "left_anti")


def next_task(board: DataFrame) -> DataFrame:
    """The first eligible task of each board."""
    return eligible(board).groupBy("board").agg(F.min_by(F.struct("pos", "id"), "pos").alias("t")).select("board", "t.pos", "t.id")


def closure(edges: DataFrame, keep: Callable[[DataFrame], DataFrame], rounds: int = 64) -> DataFrame:
    """All pairs (board, id, dep) that a chain of edges joins; keep(df) writes a frame and reads it again.

    Each round joins the pairs found so far with each other, so chains double in length.
    """
    pairs, n = keep(edges.select("board", "id", "dep").distinct()), -1
    for _ in range(rounds):
        if (now := pairs.count()) == n:
            return pairs
        n = now
        onward = pairs.select("board", F.col("id").alias("dep"), F.col("dep").alias("beyond"))
        pairs = keep(pairs.unionByName(same(pairs, onward, ["board", "dep"]).select("board", "id", F.col("beyond").alias("dep"))).distinct())
    raise RuntimeError("dependencies did not settle")


def board_report(ids: list[str], deps: list[list[str] | None], done: list[bool]) -> list[tuple[int, int, list[str], bool]]:
    """needs, open, unknown, cycle of each task of one board; what a task reaches is a number with a bit for each task."""
    at, every = {i: k for k, i in enumerate(ids)}, (1 << len(ids)) - 1
    reach, unknown = [], []
    for k, named in enumerate(deps):
        some = {d for d in named or [] if d is not None and d != "all"}
        bits = every & ~(1 << k) if "all" in (named or []) else 0
        for d in some & at.keys():
            bits |= 1 << at[d]
        reach.append(bits)
        unknown.append(sorted(some - at.keys()))
    for k in range(len(ids)):
        beyond = reach[k]
        if beyond:
            reach = [r | beyond if r >> k & 1 else r for r in reach]
    waiting = sum(1 << k for k, d in enumerate(done) if not d)
    return [((r & ~(1 << k)).bit_count(), (r & waiting & ~(1 << k)).bit_count(), unknown[k], bool(r >> k & 1)) for k, r in enumerate(reach)]


def _followed(tasks: DataFrame) -> DataFrame:
    """The report of boards of at most MOST_TOGETHER tasks; tasks are shuffled, pairs of them are not."""
    whole = tasks.groupBy("board").agg(F.collect_list(F.struct("id", "deps", (F.coalesce("status", F.lit("")) == "DONE").alias("done"))).alias("t"))
    names = ["board", "id", "needs", "open", "unknown", "cycle"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field("board").type, pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_()]
            out: list[tuple] = []
            for k in range(batch.num_rows):
                name, rows = batch.column("board")[k].as_py(), batch.column("t")[k].as_py()
                ids = [r["id"] for r in rows]
                out += [(name, i, *r) for i, r in zip(ids, board_report(ids, [r["deps"] for r in rows], [r["done"] for r in rows]))]
                if out and (len(out) >= 10_000 or k == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []

    return whole.mapInArrow(run, f"board {tasks.schema['board'].dataType.simpleString()}, id string, needs long, open long, unknown array<string>, cycle boolean")


def dependency_report(board: DataFrame, keep: Callable[[DataFrame], DataFrame], most: int = MOST_TOGETHER) -> DataFrame:
    """board, id, needs (tasks that it needs, directly or not, itself left out), open (of these not DONE), unknown (ids the board lacks, its own deps only), cycle (it needs itself).

    Boards of at most `most` tasks are followed each in one pass; those of more by joins of pairs.
    """
    large = keep(_tasks(board).groupBy("board").count().filter(F.col("count") > most).select("board"))
    if large.isEmpty():
        return _followed(_tasks(board))
    return _followed(_tasks(same(board, large, ["board"], "left_anti"))).unionByName(_joined_report(same(board, large, ["board"], "left_semi"), keep))


def _joined_report(board: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    edges = keep(dependencies(board))
    tasks = _tasks(board)
    unknown = edges.filter("dep_status is null").groupBy("board", "id").agg(F.array_sort(F.collect_set("dep")).alias("unknown"))
    known = edges.filter("dep_status is not null")
    ids = tasks.select("board", F.col("id").alias("dep"), F.coalesce("status", F.lit("")).alias("dep_status"))
    reach = same(closure(known, keep), ids, ["board", "dep"])
    other = F.col("id") != F.col("dep")
    counts = reach.groupBy("board", "id").agg(F.count(F.when(other, 1)).alias("needs"), F.count(F.when(other & (F.col("dep_status") != "DONE"), 1)).alias("open"), F.bool_or(~other).alias("cycle"))
    out = same(same(tasks.select("board", "id"), counts, ["board", "id"], "left"), unknown, ["board", "id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("board", "id", zero("needs"), zero("open"), F.coalesce("unknown", F.array().cast("array<string>")).alias("unknown"), F.coalesce("cycle", F.lit(False)).alias("cycle"))


def append_claims(ledger: DataFrame, claims: DataFrame, order: str) -> DataFrame:
    """Ledger ids go on from the ledger's last number, in the order of a column of the new claims."""
    last = ledger.agg(F.coalesce(F.max(F.regexp_extract("id", r"^C(\d+)$", 1).cast("int")), F.lit(0)).alias("last"))
    n = F.expr(f"row_number() over (order by {order})")  # claims of one task: a few rows
    rows = claims.withColumn("n", n).crossJoin(F.broadcast(last))
    return rows.withColumn("id", F.format_string("C%03d", F.col("n") + F.col("last"))).drop("n", "last")


def orphan_claims(ledger: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Claims whose artifact does not exist."""
    return ledger.join(artifacts.select("artifact").distinct(), "artifact", "left_anti")
