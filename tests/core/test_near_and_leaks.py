"""Near options and spelled-out answers against all pairs and all places."""

import random
import re

from assaykit.operators import leaks, near


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_near_options_equal_all_pairs(spark):
    rng = random.Random(2)
    words = {"".join(rng.choices("abé", k=rng.randrange(0, 6))) for _ in range(150)} | {"Brand#11", "Brand#12", "Brand#1", "brand#11", "a" * 40, "a" * 41}
    df = spark.createDataFrame([(w,) for w in [*words, *words]] + [(None,)], "rest string")
    got = {tuple(r) for r in near.near_pairs(df, "rest").collect()}
    assert got == {(a, b) for a in words for b in words if a < b and edits(a, b) == 1}
    plan = near.near_pairs(df, "rest")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def brute_plain(w):
    low = w.lower()
    if len(low) > 3:
        for pattern, put in ((r"(?<=[b-df-hj-np-tv-z])ies$", "y"), (r"(?<=s|x|z)es$|(?<=ch|sh)es$", ""), (r"(?<=[^su])s$", "")):
            if re.search(pattern, low):
                return re.sub(pattern, put, low)
    return low


def brute_remove(text, answers):
    forms = {tuple(brute_plain(w) for w in re.findall(r"[^\W_]+", a)) for a in answers if a} - {()}
    spans = [m.span() for m in re.finditer(r"[^\W_]+", text)]
    plain = [brute_plain(text[s:e]) for s, e in spans]
    gone = [False] * len(text)
    for i in range(len(plain)):
        for form in forms:
            if tuple(plain[i : i + len(form)]) == form:
                for k in range(spans[i][0], spans[i + len(form) - 1][1]):
                    gone[k] = True
    return "".join(c for c, g in zip(text, gone) if not g)


ANSWERS = ["Phase 2", "kinase inhibitor", "Therapy", "box", "bus", "glass", "virus", "Ärzte", "phase 2 study", "", None, "--", "ab c"]


def test_leaks_equal_a_search_at_every_place(spark):
    rng = random.Random(3)
    words = ["phase", "Phases", "2", "KINASE", "inhibitors", "therapies", "Boxes", "bus", "buses", "glasses", "viruses", "ärzte", "study", "studies", "ab", "c", "and", "trial", "Phase-2", "x"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", ", ", "-", ".\n", "  (", "/"]) for _ in range(rng.randrange(0, 15))) for _ in range(200)]
    rows = [(k, t, 1, "a") for k, t in enumerate(texts)] + [(0, "other text of therapy", 1, "a"), (7, texts[7], 1, "a"), (500, None, 1, "a"), (501, "", 1, "a"), (None, "No therapy.", 1, "a")]
    df = spark.createDataFrame(rows, "id long, state string, n int, th string")
    answers = spark.createDataFrame([(a,) for a in ANSWERS], "answer string")
    got = sorted(((r.id, r.state) for r in leaks.remove_answers(df.drop("th"), answers, "id", "state", "answer").collect()), key=repr)
    assert got == sorted(((i, None if t is None else brute_remove(t, ANSWERS)) for i, t, *_ in rows), key=repr)


def test_no_answers_leave_texts_alone(spark):
    df = spark.createDataFrame([(1, "a b")], "id long, state string")
    none = spark.createDataFrame([], "answer string")
    assert [tuple(r) for r in leaks.remove_answers(df, none, "id", "state", "answer").collect()] == [(1, "a b")]
