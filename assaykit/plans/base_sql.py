"""SQL forms of the frames in sources/adapters.py, as common table expressions."""

from __future__ import annotations

from ..operators.bootstrap import POISSON_STEPS
from ..operators.calibration import COLDEST, HOTTEST
from ..operators.checks import MOST_LISTED
from ..operators.screen import PENALTY, PLACES, RATE, STEPS


def bucket(*parts: str) -> str:
    """32-bit hash of the parts joined by a bar."""
    return f"CAST('0x' || substr(sha256({' || chr(124) || '.join(parts)}), 1, 8) AS BIGINT)"


def unit(*parts: str) -> str:
    return f"(CAST({bucket(*parts)} AS DOUBLE) / 4294967296e0)"


def poisson_means(rows: str, group: str, n: int = 1000) -> str:
    """group, b, mean of rows (group, item_id, v) under Poisson weights; eight replicates take one digest."""
    steps = " + ".join(f"CASE WHEN u >= {step!r}e0 THEN 1 ELSE 0 END" for step in POISSON_STEPS)
    digest = f"SELECT {group}, v, k, sha256('poisson|' || k || '|' || item_id) AS h FROM {rows} CROSS JOIN range({n // 8}) r(k)"
    word = f"SELECT {group}, v, k * 8 + j AS b, CAST(CAST('0x' || substr(h, j * 8 + 1, 8) AS BIGINT) AS DOUBLE) / 4294967296e0 AS u FROM ({digest}) CROSS JOIN range(8) s(j)"
    return f"(SELECT {group}, b, sum(w * v) / nullif(sum(w), 0) AS mean FROM (SELECT {group}, v, b, {steps} AS w FROM ({word})) GROUP BY ALL)"


def prefix(digest: str, rows: str) -> str:
    """The digits under which content_hash folds a digest: two up to a million rows, one more for each 16 times as many."""
    return f"substr({digest}, 1, (SELECT min(k) FROM range(2, 16) r(k) WHERE (SELECT count(*) FROM {rows}) <= {MOST_LISTED} * CAST(power(16, k) AS HUGEINT)))"


def share(cond: str) -> str:
    return f"avg(CASE WHEN {cond} THEN 1e0 ELSE 0e0 END)"


def pick(values: list[str | None], key: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {cases} END"


CTE = {
    "items": f"""
  SELECT sha256('documents|' || d.doc_id || '|' || t.template_id || '|7') AS item_id, 'fresh' AS tier, d.source,
         CAST(d.doc_id AS VARCHAR) AS source_record_id, CAST(DATE '2024-01-01' + CAST(d.doc_id % 366 AS INTEGER) AS DATE) AS record_date,
         CASE WHEN {bucket('CAST(d.doc_id AS VARCHAR)')} % 5 = 0 THEN 'dev' ELSE 'test' END AS split,
         t.template_id, 'noul' AS qtype, d.lang, d.n_chars, CASE WHEN t.v = 1 THEN 'yes' ELSE 'no' END AS gold, CASE WHEN t.v = 1 THEN 0 ELSE 1 END AS gold_index
  FROM (SELECT doc_id, 'quality' AS template_id, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) t
  JOIN documents d USING (doc_id)""",
    "predictions": f"""
  SELECT i.item_id, m.model, i.gold_index, m.base + (1e0 - m.base) * {unit('m.model', 'i.item_id')} AS p,
         10e0 + 90e0 * {unit("'latency'", 'm.model', 'i.item_id')} AS latency_ms, 0.5e0 + 0.5e0 * {unit("'mass'", 'm.model', 'i.item_id')} AS label_mass,
         {bucket("'fits'", 'm.model', 'i.item_id')} % 20 <> 0 AS supported
  FROM items i CROSS JOIN (VALUES ('m-small', 0.2e0), ('m-mid', 0.3e0), ('m-large', 0.4e0)) m(model, base)""",
    "scored": """
  SELECT i.*, p.model, p.p, p.latency_ms, p.label_mass, p.supported,
         CASE WHEN i.gold_index = 0 THEN p.p >= 1e0 - p.p ELSE p.p > 1e0 - p.p END AS ok,
         greatest(p.p, 1e0 - p.p) AS conf, (p.p - 1e0) * (p.p - 1e0) + (1e0 - p.p) * (1e0 - p.p) AS brier, -ln(greatest(p.p, 1e-12)) AS nll
  FROM items i JOIN predictions p USING (item_id)""",
    "logits": """
  SELECT 'emb-' || vec_id AS item_id, CAST(vec_id % 3 AS INTEGER) AS grp, CASE WHEN vec_id % 2 = 0 THEN 'choice' ELSE 'score' END AS qtype,
         list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS logits, CAST(label AS INTEGER) AS gold_index
  FROM embeddings""",
    "logit_scored": """
  SELECT *, list_position(probs, list_max(probs)) - 1 = gold_index AS ok, list_max(probs) AS conf,
         list_sum(list_transform(probs, lambda p, i: pow(p - CASE WHEN i - 1 = gold_index THEN 1e0 ELSE 0e0 END, 2))) AS brier,
         -ln(greatest(probs[gold_index + 1], 1e-12)) AS nll
  FROM (SELECT *, list_transform(logits, lambda z: exp(z - list_max(logits)) / list_sum(list_transform(logits, lambda y: exp(y - list_max(logits))))) AS probs FROM logits)""",
    "trials": f"""
  SELECT 'NCT' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS nct_id, 'Trial of ' || o_orderpriority AS title,
         'Trial of ' || o_orderpriority || ' begins. It is a Phase ' || (o_orderkey % 4 + 1) || ' study of ' || o_custkey || '.' AS brief_summary,
         'Status ' || o_orderstatus AS detailed_description, o_orderpriority AS condition,
         {pick(['Phase 1', 'Phase 2', 'Phase 3', 'Phase 4', None], 'o_orderkey')} AS phase,
         {pick(['RANDOMIZED', 'NON_RANDOMIZED', None], 'o_orderkey')} AS allocation,
         {pick(['TREATMENT', 'PREVENTION', 'DIAGNOSTIC'], 'o_orderkey')} AS primary_purpose,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {pick(['DRUG', 'DEVICE', 'BEHAVIORAL'], 'o_orderkey')} END AS one_type,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 2 = 0 END AS healthy_volunteers,
         CAST(o_orderdate AS DATE) AS first_posted, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INTEGER) AS DATE) AS last_updated
  FROM orders""",
    "drug_labels": """
  SELECT 'set-' || p_partkey AS set_id, CAST(DATE '2023-01-01' + CAST(p_partkey % 1000 AS INTEGER) AS DATE) AS effective_date,
         'Warning ' || p_size AS s_boxed, 'A ' || p_brand AS s_class, p_name || ' of ' || p_brand AS s_ind, p_type AS s_route,
         p_brand AS pharm_class, CASE WHEN p_size < 10 THEN 'risk' END AS boxed_warning, p_type AS route
  FROM part""",
    "papers": """
  SELECT CAST(doc_id AS VARCHAR) AS pmid, CAST(DATE '2024-01-01' + CAST(doc_id % 366 AS INTEGER) AS DATE) AS entry_date, 'On ' || source AS title, text AS abstract,
         doc_id % 4 AS pub, doc_id % 3 AS tag, 'Topic ' || (doc_id % 7) AS topic, CASE WHEN doc_id % 7 < 4 THEN 1 ELSE 2 END AS level
  FROM documents""",
    "brands": """
  SELECT sha256('part|' || p_partkey || '|brand') AS item_id, p_partkey AS record, p_brand AS gold, (SELECT list(DISTINCT p_brand ORDER BY p_brand) FROM part) AS options
  FROM part""",
}
NEEDS = {"predictions": ["items"], "scored": ["items", "predictions"], "logit_scored": ["logits"]}


def twin(body: str, *names: str) -> str:
    """The query with the expressions that it needs before it."""
    order: list[str] = []
    for name in names:
        for n in [*NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    return ("WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order) + "\n" if order else "") + body


def exact_means(rows: str, group: str, n: int = 1000) -> str:
    """group, b, mean of rows (group, v) under resamples of the group's size; for groups of one leaf of ranks."""
    ranked = f"SELECT {group}, v, row_number() OVER (PARTITION BY {group} ORDER BY v) - 1 AS r FROM {rows} WHERE v IS NOT NULL"
    sizes = f"SELECT {group}, count(v) AS size FROM {rows} GROUP BY {group} HAVING count(v) > 0"
    digest = f"SELECT {group}, size, b, k, sha256('draw|' || {group} || '|0|' || b || '|' || k) AS h FROM (SELECT {group}, size, unnest(range((size + 7) // 8)) AS k FROM ({sizes})) CROSS JOIN range({n}) x(b)"
    word = f"SELECT {group}, b, CAST('0x' || substr(h, j * 8 + 1, 8) AS BIGINT) % size AS r FROM ({digest}) CROSS JOIN range(8) s(j) WHERE k * 8 + j < size"
    return f"(SELECT {group}, b, avg(v) AS mean FROM ({word}) JOIN ({ranked}) USING ({group}, r) GROUP BY ALL)"


def temperatures(rows: str, by: str = "qtype") -> str:
    """by, t: where the mean loss is least, by halving a bracket of inverse temperatures."""
    w = "exp(mid * (z - list_max(logits)))"
    slope = f"avg(list_sum(list_transform(logits, lambda z: {w} * z)) / list_sum(list_transform(logits, lambda z: {w})) - logits[gold_index + 1])"
    return f"""(WITH RECURSIVE s AS (
      SELECT DISTINCT {by}, 0 AS k, 1e0 / CAST({HOTTEST} AS DOUBLE) AS lo, 1e0 / CAST({COLDEST} AS DOUBLE) AS hi FROM {rows}
      UNION ALL SELECT {by}, k + 1, CASE WHEN g > 0 THEN lo ELSE mid END, CASE WHEN g > 0 THEN mid ELSE hi END FROM (
        SELECT {by}, k, lo, hi, mid, {slope} AS g FROM (SELECT *, (lo + hi) / 2 AS mid FROM s WHERE k < 60) JOIN {rows} USING ({by}) GROUP BY ALL))
    SELECT {by}, 2 / (lo + hi) AS t FROM s WHERE k = 60)"""


def bag_of_words(rows: str) -> str:
    """template_id, n, bow of rows (item_id, template_id, split, gold yes or no, text): the steps of operators/screen.py, unrolled."""
    words = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> ''))"
    parts = [
        f"bow AS MATERIALIZED (SELECT item_id, template_id, split, CAST(gold = 'yes' AS INTEGER) AS y, gold, list_distinct(list_transform({words}, lambda w: {bucket('w')} % {PLACES})) AS x FROM {rows})",
        "bow_x AS MATERIALIZED (SELECT item_id, template_id, split, unnest(x) AS p, 1e0 / sqrt(len(x)) AS v FROM bow)",
        "bow_n AS MATERIALIZED (SELECT template_id, count(*) AS n FROM bow WHERE split = 'dev' GROUP BY template_id HAVING count(DISTINCT gold) > 1)",
        "ahead1 AS (SELECT '' AS template_id, 0 AS p, 0e0 AS w WHERE false)", "w0 AS (SELECT * FROM ahead1)",
    ]

    def margin(split: str, ahead: str) -> str:
        dot = f"SELECT x.item_id, x.template_id, sum(v * w) AS s FROM bow_x x JOIN {ahead} a USING (template_id, p) WHERE split = '{split}' GROUP BY ALL"
        return f"SELECT b.item_id, b.template_id, b.y, n, 2 * (coalesce(s, 0e0) + coalesce(c.w, 0e0)) AS m FROM bow b JOIN bow_n USING (template_id) LEFT JOIN ({dot}) d USING (item_id, template_id) LEFT JOIN {ahead} c ON c.template_id = b.template_id AND c.p = -1 WHERE b.split = '{split}'"

    for k in range(1, STEPS + 1):
        parts += [
            f"r{k} AS MATERIALIZED (SELECT item_id, template_id, n, 1e0 / (1e0 + exp(-m)) - y AS r FROM ({margin('dev', f'ahead{k}')}))",
            f"""w{k} AS MATERIALIZED (SELECT template_id, p, coalesce(w, 0e0) - CAST({RATE} AS DOUBLE) * (g + CASE WHEN p = -1 THEN 0e0 ELSE CAST({PENALTY} AS DOUBLE) * coalesce(w, 0e0) END) AS w FROM (
              SELECT template_id, p, sum(r * v) / any_value(n) AS g FROM r{k} JOIN bow_x USING (item_id, template_id) GROUP BY ALL UNION ALL SELECT template_id, -1, sum(r) / any_value(n) FROM r{k} GROUP BY template_id)
              LEFT JOIN ahead{k} USING (template_id, p))""",
            f"ahead{k + 1} AS MATERIALIZED (SELECT template_id, p, a.w + CAST({(k - 1) / (k + 2)!r} AS DOUBLE) * (a.w - coalesce(b.w, 0e0)) AS w FROM w{k} a LEFT JOIN w{k - 1} b USING (template_id, p))",
        ]
    score = f"SELECT template_id, round(avg(CASE WHEN (m > 0) = (y = 1) THEN 1e0 ELSE 0e0 END), 6) AS bow FROM ({margin('test', f'w{STEPS}')}) GROUP BY template_id"
    return f"(WITH {', '.join(parts)} SELECT t.template_id, t.n, s.bow FROM (SELECT template_id, count(*) AS n FROM bow WHERE split = 'test' GROUP BY template_id) t LEFT JOIN ({score}) s USING (template_id))"
