"""DuckDB SQL for the operators that SQL can express, over the same tables and by no method of ours: links by joins on
shared shingles, phrases by joins on whole windows, counts by grouping, components by recursion."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_COMPONENTS = """
reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, l.v FROM reach r JOIN both_ways l ON l.u = r.b),
found AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
"""

MINHASH = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM words WHERE len(w) > 0),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS shingle FROM places),
sizes AS (SELECT doc_id AS id, count(shingle) AS n FROM words LEFT JOIN sets USING (doc_id) GROUP BY ALL),
nodes AS (SELECT id FROM sizes),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM sets a JOIN sets b USING (shingle)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
both_ways AS (SELECT u, v FROM shared s JOIN sizes a ON a.id = u JOIN sizes b ON b.id = v
  WHERE 100 * s.n >= 75 * (a.n + b.n - s.n)),
{_COMPONENTS}
SELECT s.id AS doc_id, s.n AS n_shingles, f.component_id, f.component_id = s.id AS kept FROM sizes s JOIN found f USING (id)
"""

DECONTAMINATION = rf"""
WITH docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_ALNUM} AS w FROM benchmark),
item_places AS (SELECT item, w, unnest(range(1, greatest(len(w) - 11, 2))) AS p FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, w[p:p + 12] AS gram FROM item_places),
lengths AS (SELECT DISTINCT len(gram) AS n FROM windows),
doc_places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, lengths WHERE len(w) >= n),
found AS (SELECT g.doc_id, g.p, g.n, x.item FROM (SELECT doc_id, p, n, w[p:p + n - 1] AS gram FROM doc_places) g
  JOIN windows x USING (gram)),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS place FROM found) z GROUP BY 1),
which AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM found GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN which USING (doc_id)
"""

STUPID_BACKOFF = rf"""
WITH docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
tokens AS (SELECT doc_id, p, w[p] AS a1, CASE WHEN p > 1 THEN concat_ws(' ', w[p - 1], w[p]) END AS a2,
  CASE WHEN p > 2 THEN concat_ws(' ', w[p - 2], w[p - 1], w[p]) END AS a3
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM docs) z),
t1 AS (SELECT a1, count(*) AS n FROM tokens GROUP BY 1), o1 AS (SELECT doc_id, a1, count(*) AS n FROM tokens GROUP BY 1, 2),
t2 AS (SELECT a2, count(*) AS n FROM tokens GROUP BY 1), o2 AS (SELECT doc_id, a2, count(*) AS n FROM tokens GROUP BY 1, 2),
t3 AS (SELECT a3, count(*) AS n FROM tokens GROUP BY 1), o3 AS (SELECT doc_id, a3, count(*) AS n FROM tokens GROUP BY 1, 2),
rest AS (SELECT doc_id, (SELECT count(*) FROM tokens) - len(w) AS n FROM docs),
others AS (SELECT k.doc_id, k.p, t1.n - o1.n AS c1, coalesce(t2.n - o2.n, 0) AS c2, coalesce(t3.n - o3.n, 0) AS c3, rest.n AS c0
  FROM tokens k JOIN t1 USING (a1) JOIN o1 USING (doc_id, a1) LEFT JOIN t2 USING (a2) LEFT JOIN o2 USING (doc_id, a2)
  LEFT JOIN t3 USING (a3) LEFT JOIN o3 USING (doc_id, a3) JOIN rest USING (doc_id)),
context AS (SELECT *, lag(c1) OVER d AS b1, lag(c2) OVER d AS b2 FROM others WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
scores AS (SELECT doc_id, CASE WHEN c3 > 0 THEN ln(c3 / b2) ELSE CASE WHEN p > 2 THEN ln(0.4) ELSE 0 END
  + CASE WHEN c2 > 0 THEN ln(c2 / b1) ELSE CASE WHEN p > 1 THEN ln(0.4) ELSE 0 END
    + CASE WHEN c1 > 0 THEN ln(c1 / c0) ELSE -ln(greatest(c0, 1)) END END END AS s FROM context)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(x.mean, 4) AS mean_log_score
FROM docs d LEFT JOIN (SELECT doc_id, sum(s) / count(*) AS mean FROM scores GROUP BY 1) x USING (doc_id)
"""

VECTORS = f"""
WITH RECURSIVE vectors AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
sized AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM vectors),
both_ways AS (SELECT a.id AS u, b.id AS v FROM sized a JOIN sized b ON a.label = b.label AND len(a.v) = len(b.v) AND a.id <> b.id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
nodes AS (SELECT vec_id AS id FROM embeddings),
{_COMPONENTS}
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, component_id = id AS kept
FROM found LEFT JOIN (SELECT u AS id, count(*) AS n FROM both_ways GROUP BY 1) links USING (id)
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

TOP_K = f"""
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND {_FINITE}),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM whole q JOIN whole c
  ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scores)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED = rf"""
WITH docs AS (SELECT doc_id, {_TERMS} AS w FROM documents),
sizes AS (SELECT doc_id, len(w) AS n FROM docs WHERE len(w) > 0),
corpus AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM sizes),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM docs) z GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, corpus GROUP BY term, nd),
wanted AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) z),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), corpus GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 50
"""


def _codes(rounds: int = 6) -> str:
    """Assignment and update, written out for each round."""
    off = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"

    def assigned(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (SELECT id, part, any_value(x) AS x, arg_min(entry, off * 16 + entry) AS entry, min(off) AS off
  FROM (SELECT id, part, x, entry, CAST({off} AS BIGINT) AS off FROM parts JOIN b{r} USING (part)) z GROUP BY id, part)"""

    steps = []
    for r in range(rounds):
        steps.append(assigned(r))
        steps.append(f"""m{r} AS (SELECT part, entry, i, sum(y) AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS y,
  unnest(range(1, len(x) + 1)) AS i FROM a{r}) z GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(f.c, o.c) AS c FROM b{r} o LEFT JOIN (SELECT part, entry,
  list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM m{r} GROUP BY ALL) f USING (part, entry))""")
    steps.append(assigned(rounds))
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS id, vec_id, label,
  list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {_FINITE}),
parts AS MATERIALIZED (SELECT id, part, v[part * (len(v) // 8) + 1:(part + 1) * (len(v) // 8)] AS x FROM kept, range(8) r(part)),
b0 AS MATERIALIZED (SELECT part, id AS entry, x AS c FROM parts WHERE id < 16),
{", ".join(steps)},
codes AS (SELECT id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(off) AS BIGINT) AS error
  FROM a{rounds} GROUP BY id),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS digest FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM kept JOIN codes USING (id), books
"""


ORACLES = {"op2_minhash": MINHASH, "op6_positional_index": DECONTAMINATION, "op8_stupid_backoff": STUPID_BACKOFF,
           "op9_int8_tiles": VECTORS, "op11_histogram_selection": TOP_K, "op12_ball_tree": RANKED, "op13_equal_average": _codes()}
