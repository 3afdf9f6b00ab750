"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame operations only.

A text's paragraphs are its lines, and parts of lines. A line is read as units: words with the blanks
before them, and the single code points of words longer than LONG_WORD, so that scripts without blanks
and long runs of digits have units too. A part ends after a unit where a hash of it and the WINDOW - 1
units before it is divisible by EVERY, wherever the line began and in any script, so that an insertion
changes the parts that it touches and no others. There is no other limit: a stretch without such a place
is one part. Each paragraph's digest, with the number of times that the
text has it, is a key. A sketch deals every key to three cells; a cell holds a count, the keys'
exclusive or, and that of their checksums. Two versions' sketches subtract cell by cell: what
they share cancels. A cell that is left with one key gives that key away; taking it out of its
other cells lays more of them bare. A key has one cell in each third of a sketch, and the thirds are
peeled in turn, so that no key is given away twice at once. If this peeling empties the sketch, the keys
that it gave are the differing paragraphs, and which version has each; they are counted and leave the
sketch. If cells are left over, the pair is tried anew with a sketch of four times as many cells, until it
succeeds. How many keys differ is guessed from one key in SAMPLED, so that few pairs fail; pairs of all
sizes are peeled together.

Everything of one pair stays in one partition: all rounds of peeling follow a single exchange
of keys. The text itself is exchanged once, by stretches of the order, in which a document's neighbour
stands behind it; a stretch gets the beginning of the next one as a row more.

Likeness of two texts: |A and B| / |A or B| of their keys, from the sizes and the recovered
difference; 1 for two texts without paragraphs.

Defined results: a null or empty text, or one of white space, has no paragraphs; equal texts
have equal fingerprints; texts of any length are read whole; a null doc_id comes first in the
order; rows repeated with the same doc_id and text count as one document in the order and each
gets its row; those that share a doc_id only are ordered by a hash of the text; a table of one
document has itself as next; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Workspace, row_keys

#: Words of more code points are read as code points; units that a part's end depends on, and one in so many ends one.
LONG_WORD, WINDOW, EVERY = 24, 3, 12
UNITS = r"[ \t\r]*[^ \t\r\n]+|\n|[ \t\r]+"
#: Cells of the least sketch, how many times more the next size has, rounds of peeling all thirds, how many of them one plan has, and sizes.
CELLS, GROWTH, ROUNDS, WRITTEN, SIZES = 48, 4, 6, 2, 16
#: One key in so many is compared to guess how many differ; cells of a first sketch for each of these.
SAMPLED, ROOM = 4, 2
ID = ["did", "th"]
PAIR = [*ID, "which"]
LOWEST = -(1 << 63)
#: Stretches of the order and rows drawn to part it for each partition; so many failed pairs are looked up by a broadcast.
STRETCHES, DRAWN, FEW = 4, 32, 200_000


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(7)).bitwiseAND(F.lit((1 << 32) - 1))


def _cells(key: Column, part: Column, m: Column) -> list[Column]:
    """One cell in each third of a sketch of m cells; part is m / 3."""
    return [F.pmod(F.xxhash64(key, F.lit(i), m), part) + i * part for i in range(3)]


def _documents(docs: DataFrame) -> DataFrame:
    """Documents by keys without nulls; rows repeated whole stay repeated."""
    rows = row_keys(docs)
    return rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("did"), "th", "text")


def stretches(texts: DataFrame, rows: int, partitions: int) -> DataFrame:
    """The rows dealt out by stretches b of the order of did, th, stretch b in partition p; turn puts a stretch's rows in order before did and th.

    Stretches begin at drawn documents. The last one goes on with what stands before the first beginning (turn 1), and
    each ends with the document with which the next one begins (turn 2).
    """
    drawn = F.when(F.pmod(F.xxhash64("th", "did"), F.lit(max(1, rows // (DRAWN * partitions)))) == 0, F.struct(*ID))
    begins = texts.agg(F.sort_array(F.collect_set(drawn)).alias("l"), F.min(F.struct(*ID)).alias("first"))
    begins = begins.select(F.expr("if(size(l) > 0, l, array(first))").alias("l"), F.expr(f"greatest(1, ceil(size(l) / {STRETCHES * partitions}))").alias("step"))
    l = begins.selectExpr("filter(l, (v, i) -> i % step = 0) as l").first()["l"]  # noqa: E741
    l = [(b["did"], b["th"]) for b in l if b is not None] or [(LOWEST, LOWEST)]  # noqa: E741
    did, th = (f"cast(split('{','.join(str(b[k]) for b in l)}', ',') as array<bigint>)" for k in (0, 1))
    steps = ", ".join(str(1 << k) for k in reversed(range(len(l).bit_length())))
    at = lambda a: f"get({a}, k + s - 1)"
    before = f"k + s <= {len(l)} and ({at(did)} < did or {at(did)} = did and {at(th)} <= th)"
    found = texts.withColumn("k", F.expr(f"aggregate(array({steps}), 0, (k, s) -> if({before}, k + s, k))"))  # beginnings up to this row
    here = f"struct(pmod(k - 1, {len(l)}) as b, if(k = 0, 1, 0) as turn)"
    ends = f"struct(pmod(k - 2, {len(l)}) as b, 2 as turn)"
    places = f"if(k > 0 and get({did}, k - 1) = did and get({th}, k - 1) = th, array({here}, {ends}), array({here}))"
    placed = found.select(*ID, "text", F.explode(F.expr(places)).alias("r")).select(F.pmod("r.b", F.lit(partitions)).alias("p"), "r.b", "r.turn", *ID, "text")
    return placed.repartitionById(partitions, F.col("p"))


def with_next(docs: DataFrame, partitions: int) -> DataFrame:
    """did, th, text, n_chars, copies, own keys, and the next document's next_text and other keys; one row for all copies."""
    by = ["p", "b", "turn", *ID]
    each = stretches(_documents(docs), docs.count(), partitions).groupBy(*by).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    each = each.withColumn("own", paragraph_keys_of("text"))
    order = Window.partitionBy("p", "b").orderBy("turn", *ID)
    each = each.select("*", F.lead("text").over(order).alias("next_text"), F.lead("own").over(order).alias("other")).filter("turn < 2")
    return each.drop("p", "b", "turn").withColumn("n_chars", F.char_length("text").cast("long"))


def _hashes(text: str) -> str:
    quoted = UNITS.replace("\\", "\\\\")
    units = f"flatten(transform(regexp_extract_all({text}, '{quoted}', 0), w -> if(char_length(w) > {LONG_WORD}, split(w, ''), array(w))))"
    window = ", ".join([*(f"get(f, i - {k})" for k in range(WINDOW - 1, 0, -1)), "u"])
    marked = f"array_join(transform(f, (u, i) -> if(pmod(xxhash64({window}), {EVERY}) = 0, concat(u, chr(1)), u)), '')"
    # One array of units, to which the inner function looks back.
    whole = f"transform(array({units}), f -> {marked})[0]"
    return f"transform(filter(transform(split({whole}, '[\\u0001\\n]'), p -> trim(BOTH ' \\t\\r' FROM p)), p -> p <> ''), p -> xxhash64(p))"


def paragraph_hashes(text: str) -> Column:
    """SQL text of a string -> array of 64-bit digests, repeats included."""
    return F.expr(_hashes(text))


def paragraph_keys_of(text: str) -> Column:
    """SQL text of a string -> array of its keys: each different digest with the number of its repeats."""
    starts = "filter(transform(s, (h, i) -> if(i = 0 or get(s, i - 1) <> h, i, -1)), i -> i >= 0)"
    counted = "transform(a, (i, j) -> xxhash64(get(s, i), cast(coalesce(get(a, j + 1), size(s)) - i as bigint)))"
    sorted_ = f"transform(array(sort_array(l)), s -> transform(array({starts}), a -> {counted})[0])[0]"
    # Without repeats the keys stay in the text's order: what versions share are long stretches then, which the compression of tables and shuffles finds.
    return F.expr(f"transform(array({_hashes(text)}), l -> if(size(array_distinct(l)) = size(l), transform(l, h -> xxhash64(h, 1L)), {sorted_}))[0]")


def paragraph_keys(docs: DataFrame, work: Workspace, partitions: int) -> DataFrame:
    """Of each document: its keys, those of its edited text and of the next document, one after another, and how many are of each: a, b0, b1.

    With sha (of the edited text), n_chars, copies.
    """
    both = with_next(docs, partitions)
    both = both.withColumn("text", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))"))
    both = both.select(*ID, "n_chars", "copies", F.unhex(F.sha2("text", 256)).alias("sha"), "own", paragraph_keys_of("text").alias("edited"), "other")
    counts = [F.size(c).alias(n) for c, n in (("own", "a"), ("edited", "b0"), ("other", "b1"))]
    return work.table(both.select(*ID, "n_chars", "copies", "sha", *counts, F.concat("own", "edited", "other").alias("keys")), "keys")


def sketch(keyed: DataFrame, by: list[str], part: Column, m: Column) -> DataFrame:
    """Rows of a key with its sign c -> cells: count, exclusive or of keys k and of checksums x; signs subtract."""
    dealt = keyed.select(*by, "key", "c", F.explode(F.array(*_cells(F.col("key"), part, m))).alias("cell"))
    return dealt.groupBy(*by, "cell").agg(F.sum("c").alias("c"), F.bit_xor("key").alias("k"), F.bit_xor(_check(F.col("key"))).alias("x"))


def _peel_third(state: DataFrame, third: int) -> DataFrame:
    """state: PAIR, part, cell, c, k, x. Cell -1 counts in c the recovered keys that only the one has, -2 those of the other."""
    k, c, x, part, cell = F.col("k"), F.col("c"), F.col("x"), F.col("part"), F.col("cell")
    pure = (cell >= third * part) & (cell < (third + 1) * part) & (F.abs(c) == 1) & (x == _check(k))
    row = lambda cell, c, k, x: F.struct(cell.alias("cell"), c.alias("c"), k.alias("k"), x.alias("x"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    # A key has one cell in this third, which is empty once the key is out.
    others = [row(at, -c, k, x) for i, at in enumerate(_cells(k, part, 3 * part)) if i != third]
    out = F.when(pure, F.array(row(F.when(c > 0, -one).otherwise(F.lit(-2).cast("long")), one, zero, zero), *others)).otherwise(F.array(row(cell, c, k, x)))
    rows = state.select(*PAIR, "part", F.explode(out).alias("r")).select(*PAIR, "part", "r.*")
    left = rows.groupBy(*PAIR, "part", "cell").agg(F.sum("c").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("x").alias("x"))
    return left.filter("c <> 0 or k <> 0 or x <> 0")


def differing(pairs: DataFrame) -> DataFrame:
    """pairs: PAIR, part, one, other (arrays of keys). Gives the difference of their sketches of 3 * part cells, without empty cells."""
    signed = F.expr("concat(transform(one, v -> struct(v as key, 1L as c)), transform(other, v -> struct(v as key, -1L as c)))")
    keyed = pairs.select(*PAIR, "part", F.explode(signed).alias("r")).select(*PAIR, "part", "r.key", "r.c")
    return sketch(keyed, [*PAIR, "part"], F.col("part"), 3 * F.col("part")).filter("c <> 0 or k <> 0 or x <> 0")


def first_part(one: str, other: str) -> Column:
    """A third of a pair's first sketch, which has room for the keys that differ by a guess from one key in SAMPLED."""
    some = lambda a: F.filter(a, lambda k: F.pmod(k, F.lit(SAMPLED)) == 0)
    differ = SAMPLED * (F.size(F.array_except(some(one), some(other))) + F.size(F.array_except(some(other), some(one))))
    parts = [CELLS * GROWTH**k // 3 for k in range(SIZES)]
    fitting = lambda d: F.element_at(F.filter(F.array(*[F.lit(p).cast("long") for p in parts]), lambda p: (d * ROOM <= 3 * p) | (p == parts[-1])), 1)
    return F.transform(F.array(differ), fitting)[0]


def recover(rows: DataFrame, work: Workspace, partitions: int, pairs: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """PAIR, plus, minus of the pairs that differ: how many keys only the one, only the other has.

    pairs makes PAIR, one, other of the rows, which are dealt by ID, so that no round moves them. A pair is first tried
    with a sketch of its first size; what does not peel is tried with the next one.
    """
    now, found = pairs(rows.repartition(partitions, *ID)).withColumn("part", first_part("one", "other")), []
    for turn in range(SIZES):
        state = differing(now)
        for k in range(0, ROUNDS, WRITTEN):
            for third in [*range(3)] * WRITTEN:
                state = _peel_third(state, third)
            state = work.table(state, f"peeled{turn}-{k}")
            found.append(state.filter("cell < 0"))
            left = state.filter("cell >= 0")
            if left.isEmpty():
                break
            state = left.repartition(partitions, *ID)
        else:
            again = left.select(*PAIR, (GROWTH * F.col("part")).alias("part")).distinct()
            now = pairs(rows).join(F.broadcast(again) if again.count() <= FEW else again, PAIR).repartition(partitions, *ID)
            continue
        break
    else:
        raise RuntimeError("peeling did not end")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    sums = every.groupBy(*PAIR, "part").agg(*[F.sum(F.when(F.col("cell") == cell, F.col("c")).otherwise(0)).alias(n) for n, cell in (("plus", -1), ("minus", -2))])
    # The last sketch of a pair is the one that peeled.
    return sums.groupBy(*PAIR).agg(F.max(F.struct("part", "plus", "minus")).alias("r")).select(*PAIR, "r.plus", "r.minus")


def fingerprint_strings(keyed: DataFrame, by: list[str], m: int = CELLS) -> DataFrame:
    """by, fingerprint: the cells in use as cell:count:keys:checksums, in order."""
    cells = sketch(keyed, by, F.lit(m // 3), F.lit(m))
    text = F.concat_ws(":", "cell", "c", F.lower(F.hex("k")), F.lower(F.hex("x")))
    lists = cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("cell", text.alias("t")))).alias("l"))
    return lists.select(*by, F.array_join(F.transform("l", lambda s: s["t"]), ",").alias("fingerprint"))


def _likeness(a: Column, b: Column, differ: Column) -> Column:
    return F.when(a + b == 0, 1.0).otherwise((a + b - differ) / (a + b + differ))


def compare_with_edits(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    work = Workspace(spark, "fingerprints")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = paragraph_keys(docs, work, partitions)
    others = "array(struct(0 as which, slice(keys, a + 1, b0) as other), struct(1 as which, slice(keys, a + b0 + 1, b1) as other))"
    compared = lambda rows: rows.select(*ID, F.expr("slice(keys, 1, a)").alias("one"), F.explode(F.expr(others)).alias("r")).select(*ID, "r.which", "one", "r.other")
    found = recover(keys.select(*ID, "keys", "a", "b0", "b1"), work, partitions, compared)
    differ = found.groupBy(*ID).agg(*[F.sum(F.when(F.col("which") == w, F.col("plus") + F.col("minus"))).alias(f"d{w}") for w in (0, 1)])
    near = keys.drop("keys").join(differ, ID, "left")
    likeness = [_likeness(F.col("a"), F.col(f"b{w}"), F.coalesce(F.col(f"d{w}"), F.lit(0))).alias(n) for w, n in ((0, "near_edited"), (1, "near_next"))]
    near = work.table(near.select(*ID, "n_chars", "copies", "sha", *likeness), "near")
    dealt = keys.select(*ID, "a", F.expr("slice(keys, 1, a + b0)").alias("keys")).repartition(partitions, *ID)
    both = dealt.select(*ID, F.explode(F.expr("transform(keys, (k, i) -> struct(if(i < a, 0, 1) as v, k as key))")).alias("r"))
    prints = fingerprint_strings(both.select(*ID, "r.v", "r.key", F.lit(1).cast("long").alias("c")), [*ID, "v"])
    lists = prints.groupBy(*ID).agg(F.collect_list(F.struct("v", "fingerprint")).alias("f"))
    of = lambda v: F.coalesce(F.get(F.filter("f", lambda s: s["v"] == v), F.lit(0))["fingerprint"], F.lit(""))
    out = near.repartition(partitions, *ID).join(lists, ID, "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(
        F.nullif("did", F.lit(LOWEST)).alias("doc_id"), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), of(0).alias("fingerprint"), of(1).alias("edited_fingerprint"), "near_edited", "near_next"
    )
