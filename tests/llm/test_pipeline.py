import random

import public_tokenizers
import pytest

import corpus_pipeline
from assaykit.llm._vocab import tokenizer
from assaykit.llm.context_pii import base_spans
from assaykit.llm.shingle_links import shingles
from assaykit.llm.simhash_pivots import fingerprints

from .conftest import table


def corpus():
    r, words = random.Random(9), "the of and to in is that for with as on by this from be".split()
    make = lambda n: " ".join(r.choice(words) + r.choice(words) for _ in range(n))
    texts = [make(r.randrange(30, 700)) for _ in range(40)]
    texts += [texts[0], texts[1], texts[1]]
    near = texts[2].split()
    near[10] = "changed"
    texts += [" ".join(near), "", None, "123 456 !!", f"write to a.b@mail.example.org {make(40)}"]
    return list(enumerate(texts))


def brute(rows):
    rows = [(i, t) for i, t in rows if t and any(map(str.isalpha, t))]
    top = {t: i for i, t in rows}
    rows = [(i, t) for i, t in rows if top[t] == i]
    sets, prints = [set(shingles(t).tolist()) for _, t in rows], fingerprints([t for _, t in rows]).tolist()
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) or (prints[a] ^ prints[b]).bit_count() <= 4:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    rows = [rows[i] for i in range(len(rows)) if i == min((k for k in range(len(rows)) if group[k] == group[i]), key=lambda k: rows[k][0])]
    out = []
    for i, t in rows:
        for kind, a, b in sorted(base_spans(t), key=lambda s: -s[1]):
            t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
        out.append((i, t))
    return out


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows = corpus()
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in brute(rows)}
    have, used = {}, {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.length
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert have == want and max(used.values()) <= 1024


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_keep_columns(spark, odd, empty, name, tmp_path):
    stage, last = dict(corpus_pipeline.STAGES)[name], corpus_pipeline.STAGES[-1][0]
    df, _ = odd
    out = stage(spark, df, str(tmp_path))
    assert out.count() > 0 and stage(spark, empty, str(tmp_path)).count() == 0
    if name != last:
        assert out.columns == df.columns
