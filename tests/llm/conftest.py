import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, name int, idx int, level int, key string, score string, spans string, copies int, cuts int, did int, h string, row int"

PROSE = "The quick brown fox jumps over the lazy dog and then it sleeps in the warm sun for a while.\nAnother line of the same text follows here.\n"


def table(spark, rows):
    """(doc_id, text[, lang]) rows with columns whose names the operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "x", 1, 2, 3, "k", "s", "p", 4, 5, 6, "h", 7) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, a very long text, ties and repeated rows."""
    long = " ".join(f"word{i % 977} line{i % 13}.\n" if i % 9 == 0 else f"w{i % 1009}" for i in range(60_000))
    rows = [
        (1, PROSE), (2, None), (3, ""), (4, " \t\n "), (5, long), (6, PROSE), (6, PROSE), (7, "x"), (7, "y"), (None, PROSE + "tail"), (None, None),
        (8, "日本語のテキスト 🙂 mit ß und é"), (9, "12 34 !!"), (10, "a" * 5000), (11, "\n\n\n"), (12, PROSE.upper()), (-3, "minus"), (2**40, "far"),
    ]
    return table(spark, rows), rows


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])
