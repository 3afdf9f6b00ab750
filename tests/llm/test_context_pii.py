import hashlib
import itertools
import math
import random
import re

from assaykit.llm.context_pii import base_spans, candidates, find_personal_data, is_secret, redact

from .conftest import table

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d[-1::-2]) + sum(sum(divmod(2 * v, 10)) for v in d[-2::-2])
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_base_spans_match_the_patterns():
    r = random.Random(3)
    texts = ["a@b.c@d.e a@b.c_x@d.e x@y.z.", "1.2.3.4.5.6.7.8 0001.2.3.004 256.1.1.1", "4111 1111-1111 1111", "+1 (555) 123-4567 +49.30.1234567.", "@@a@.b a@b a@b..c"]
    for alphabet in ("ab.@-_ 0", "012 -.+()5", "a@.1 "):
        texts += ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(8000)]
    for text in texts:
        assert base_spans(text) == brute(text), repr(text)


def test_long_runs_take_linear_time():
    text = "a" * 200_000 + "@" + "1" * 200_000 + "." + "a" * 200_000
    assert base_spans(text)[0] == ("email", 0, len(text))
    assert base_spans("1" * 100_000 + "@") == []


def test_candidates_touch_no_base_span():
    text = 'key = "ab12cd34", mail bob1@x.org, id 77-88-99-00.'
    base = base_spans(text)
    assert [text[a:b] for a, b in candidates(text, base)] == ["ab12cd34", "77-88-99-00"]


def test_contexts_of_seeds_discover_identifiers(spark):
    """A number that fails the card check is found by its context and shape; the same number elsewhere is not."""
    odd_shape = [(i, f"Please write to my address user{i}@mail.example.org today.") for i in range(40)] + [(50, "Please write to my address +1 (555) 12-1 today.")]
    assert {r.doc_id: r.spans for r in find_personal_data(spark, table(spark, odd_shape)).collect()}[50] == ""
    cards = [(i, f"my card number {n} expires") for i, n in enumerate(LUHN)] + [(90, "my card number 4111111111111112 expires"), (91, "the part labelled 4111111111111112 here")]
    found = {r.doc_id: r for r in find_personal_data(spark, table(spark, cards)).collect()}
    assert found[90].n_card == 0 and found[90].spans == "context:15:31" and found[91].spans == ""
    assert found[0].spans == "card:15:31"


def test_contexts_find_identifiers_of_other_shapes(spark):
    """A short number where phones stand, found by their family; spaced ones; a code in contexts that discovered numbers, not base kinds, have sown."""
    rows = [(i, f"my phone is +1 (555) 123-{4000 + i} call soon") for i in range(30)]
    rows += [(100, "my phone is 555-0134 call soon"), (101, "my phone is 555 0134 call soon"), (102, "the part is 555-0134 in stock")]
    rows += [(200 + i, f"my phone is 555-{2000 + i} call soon") for i in range(8)]
    rows += [(300 + i, f"reach desk number 555-{2000 + i} at night") for i in range(8)] + [(350, "reach desk number 777-1234 at night")]
    found = {r.doc_id: r.spans for r in find_personal_data(spark, table(spark, rows)).collect()}
    assert found[100] == "context:12:20" and found[101] == "context:12:20" and found[102] == ""
    assert found[350] == "context:18:26"


def test_a_context_alone_needs_seeds_of_several_families(spark):
    mails = [(i, f"contact me at user{i}@mail.example.org or") for i in range(20)]
    phones = [(50 + i, f"contact me at +1 (555) 123-{4000 + i} or") for i in range(20)]
    code = [(99, "contact me at AB12-cd34 or")]
    assert {r.doc_id: r.spans for r in find_personal_data(spark, table(spark, mails + code)).collect()}[99] == ""
    assert {r.doc_id: r.spans for r in find_personal_data(spark, table(spark, mails + phones + code)).collect()}[99] == "context:14:23"


def test_candidates_span_several_tokens():
    text = "call 555 0134 now, or 12 34, 56 78 90 1 or a@b.org 123 4567."
    found = [text[a:b] for a, b in candidates(text, base_spans(text))]
    assert found == ["555", "0134", "555 0134", "12", "34", "12 34", "56", "78", "90", "1", "56 78 90 1", "123", "4567", "123 4567"]
    long = "x9" * 5000
    assert [b - a for a, b in candidates(f"id {long} end", [])] == [10_000] and is_secret(long) and not is_secret("a" * 30 + "1" * 30)


def test_secrets_sow_contexts_that_find_other_values(spark):
    rows = [(i, f'set token = "{hashlib.sha1(str(i).encode()).hexdigest()}" then go on') for i in range(12)] + [(50, 'set token = "short-77b" then go on'), (51, 'it has "short-77b" in it')]
    found = {r.doc_id: r.spans for r in find_personal_data(spark, table(spark, rows)).collect()}
    assert found[0] == "context:13:53" and found[50] == "context:13:22" and found[51] == ""


def test_tokens_without_digits_are_found_where_few_stand(spark):
    """A code of letters in a context of several families of seeds; not where ordinary words stand as often."""
    rows = [(i, f"contact me at user{i}@mail.example.org or") for i in range(20)] + [(50 + i, f"contact me at +1 (555) 123-{4000 + i} or") for i in range(20)]
    code = [(99, "contact me at ABCDEFGH or")]
    words = [(200 + i, f"contact me at {a}{b} or") for i, (a, b) in enumerate(itertools.product("abcdefghijklm", "nopqrstuvw"))]
    assert {r.doc_id: r.spans for r in find_personal_data(spark, table(spark, rows + code)).collect()}[99] == "context:14:22"
    assert {r.doc_id: r.spans for r in find_personal_data(spark, table(spark, rows + code + words)).collect()}[99] == ""


def wilson(mean, n, z=1.645):
    return (mean + z * z / (2 * n) - z * math.sqrt((mean * (1 - mean) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def brute_contexts(rows):
    """The method by its description, for texts of plain words and lone tokens: context spans of each document."""
    kind = lambda t: "@" if "@" in t else "9" if t.isdigit() else "a" if t.isalpha() else "a9"
    shape = lambda t: f"9:{len(t)}" if t.isdigit() else f"x:{len(t)}" if re.fullmatch("[0-9a-f]+", t) and not t.isalpha() else re.sub("[a-z]+", "a", re.sub("[0-9]+", "9", t))
    held = lambda w: re.sub("[0-9]", "0", w)
    places = []  # doc, start, stop, token, seed, contexts
    for doc_id, text in rows:
        words = text.split(" ")
        at = 0
        for i, w in enumerate(words):
            a, b = at, at + len(w)
            at = b + 1
            left, right = [held(x) for x in words[max(0, i - 2) : i]], [held(x) for x in words[i + 1 : i + 2]]
            two = ([f"{left[0]} {left[1]} _"] if len(left) == 2 else []) + ([f"{left[-1]} _ {right[0]}"] if left and right else [])
            one = ([f"{left[-1]} _"] if left else []) + ([f"_ {right[0]}"] if right else [])
            places.append((doc_id, a, b, w, 2 if base_spans(w) else 0, two, one))
    marked = [p for p in places if re.search("[0-9@]", p[3])]
    alone = set()
    for c in {c for p in marked for c in p[5]}:
        there = [p for p in marked if c in p[5]]
        plain = sum(c in p[5] for p in places) - len(there)
        if len({kind(p[3]) for p in there}) > 1 and len({p[3] for p in there}) >= 5 and plain <= 2 * len(there):
            alone.add(c)
    def patterns(p):
        mine = re.search("[0-9@]", p[3])
        out = [(f"{c} ={shape(p[3])}", 0) for c in p[5] if mine or c in alone] + [(f"{c} ~{kind(p[3])}", 0) for c in p[5] if mine or c in alone]
        return out + [(f"{c} *", 1) for c in p[5] if c in alone] + [(f"{c} ={shape(p[3])}", 2) for c in p[6] if mine]
    members, seed = {}, {}
    for p in places:
        seed[p[3]] = p[4]
        for q in patterns(p):
            members.setdefault(q, set()).add(p[3])
    score, believed = dict.fromkeys(seed, 0.0), {}
    for _ in range(5):
        good = {}
        for (name, how), tokens in members.items():
            v = {t: 1.0 if seed[t] else score[t] for t in tokens}
            sown = [t for t in tokens if (seed[t] == 2 if how == 2 else v[t] >= 0.5)]
            bound = wilson(sum(v.values()) / len(v), len(v))
            if len(sown) >= 5 and bound >= 0.3 and (how != 1 or len({kind(t) for t in sown}) > 1):
                good[name] = bound
        score = {t: max((good[n] for (n, _), ts in members.items() if n in good and t in ts), default=0.0) for t in seed}
        believed = {n for n, c in good.items() if c >= 0.5}
    out = {}
    for p in places:
        if not p[4] and any(n in believed for n, _ in patterns(p)):
            out.setdefault(p[0], []).append(f"context:{p[1]}:{p[2]}")
    return out


def test_the_graph_scores_as_by_brute_force(spark):
    r = random.Random(11)
    hits = 0
    for trial in range(3):
        cues = [f"{a} {b}" for a in ("call", "card", "mail") for b in ("is", "at", "no")]
        rows = []
        for i in range(260):
            cue = r.choice(cues)
            token = r.choice([r.choice(LUHN), f"{r.randrange(10**15, 10**16)}", f"u{i}@mail.example.org", str(r.randrange(10, 99)), f"{r.randrange(10**8):08x}1f", r.choice(["maybe", "never", "soon"])])
            if cue.endswith("no") and r.random() < 0.7:
                token = r.choice(LUHN)
            rows.append((i, " ".join([r.choice(["well", "now", "so"]), cue, token, r.choice(["or", "and", "then", "but"]), r.choice(["yes", "no"])])))
        got = {x.doc_id: [s for s in x.spans.split(",") if s.startswith("context")] for x in find_personal_data(spark, table(spark, rows)).collect()}
        want = brute_contexts(rows)
        hits += len(want)
        assert {d: s for d, s in got.items() if s} == want
    assert hits


def luhn_numbers(n):
    out, k = [], 0
    while len(out) < n:
        digits = f"4{k:014d}"
        total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits))
        out.append(digits + str(-total % 10))
        k += 7919
    return out


LUHN = luhn_numbers(30)


def test_odd_rows(spark, odd):
    df, rows = odd
    got = sorted(map(tuple, find_personal_data(spark, df).collect()), key=str)
    want = []
    for doc_id, text in rows:
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(text or ""))
        n = [sum(k == kind for k, *_ in brute(text or "")) for kind in ("email", "ip", "card", "phone")]
        want.append((doc_id, *n, hashlib.sha256(joined.encode()).hexdigest(), joined))
    assert got == sorted(want, key=str)


def test_redaction_leaves_clean_rows_alone(spark, odd, empty):
    df, rows = odd
    assert sorted(((r.doc_id, r.text) for r in redact(spark, df).collect()), key=str) == sorted(rows, key=str)
    text = "é mail a@b.co, ip 10.0.0.1 and +1 (555) 123-4567 end"
    out = redact(spark, table(spark, [(1, text), (1, text), (2, None)]))
    assert out.columns == df.columns
    clean = "é mail [EMAIL], ip [IP] and [PHONE] end"
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str) == [(1, clean, len(clean))] * 2 + [(2, None, 0)]
    assert redact(spark, empty).count() == 0 and find_personal_data(spark, empty).count() == 0
