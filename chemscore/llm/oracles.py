"""DuckDB SQL of the training-data queries that SQL can express in full.

The others depend on a tokenizer file (4, 6, 10), mined rules (2), graded
template matches (5) or a fitted model (8); tests hold them against plain
versions, exact round trips or held-out labels.
"""

from __future__ import annotations

from chemscore.llm.secret_scan import RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"[x FOR x IN regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> '']"

OP1 = f"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS g
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit
           FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP3 = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id,
                  [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
           FROM embeddings
           WHERE embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS "rank", vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s)
WHERE r <= 5
"""


def _op7() -> str:
    parts = []
    for rank, r in enumerate(RULES):
        pattern = (("(?i)" if r.any_case else "") + r.pattern).replace("'", "''")
        parts.append(f"""
SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, i, len(g[i]) AS held, len(m[i]) AS size,
       list_sum([len(x) FOR x IN p[1:i]]) + coalesce(list_sum([len(x) FOR x IN m[1:i - 1]]), 0) AS start
FROM (SELECT doc_id, m, g, p, unnest(range(1, len(m) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS g,
                   regexp_split_to_array(t, '{pattern}') AS p FROM d)) WHERE len(g[i]) >= {r.least}""")
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    one = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    total = ", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
a AS (SELECT doc_id, {counts},
             string_agg({one}, ',' ORDER BY start, rank) FILTER (WHERE kind IN ({base})) AS base,
             string_agg({one}, ',' ORDER BY start, rank) AS spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, {total}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


OP9 = rf"""
WITH RECURSIVE d AS (
    SELECT CAST(doc_id AS BIGINT) AS doc_id,
           [x FOR x IN regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 4] AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id
      GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * common >= 75 * (na.n + nb.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

# crc32 of the id's digits, bit by bit (polynomial 0xEDB88320).
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"""

OP11 = f"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS r, coalesce("text", '') AS x
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, CAST({_CRC32} % 9 AS BIGINT) AS h,
             list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, sha256(concat(strlen(r), ':', r, x))) AS turns
      FROM t GROUP BY conv_id),
c AS (SELECT o.conv_id, list_concat(coalesce(f.turns, [])[1:o.h], o.turns[o.h + 1:]) AS s
      FROM o LEFT JOIN o f ON f.conv_id = o.conv_id - o.conv_id % 5),
m AS (SELECT conv_id, s[1:d] AS p, d = len(s) AS whole FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM c)),
n AS (SELECT p, CAST(len(p) AS BIGINT) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE whole) AS ends FROM m GROUP BY p),
k AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
o2 AS (SELECT n.p, depth, coalesce(n_children, 0) AS n_children,
              CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.p[depth].x) END AS saved FROM n LEFT JOIN k ON n.p = k.p),
a AS (SELECT p[1:d] AS p, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
      FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM o2) GROUP BY ALL)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children,
       CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens,
       sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN a ON n.p = a.p LEFT JOIN k ON n.p = k.p LEFT JOIN n u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.p = n.p[1:n.depth - 1]
"""

_TERMS = rf"[x FOR x IN regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') IF x <> '']"

OP12 = f"""
WITH d AS (SELECT rid, doc_id, CAST(len(t) AS BIGINT) AS n, t
           FROM (SELECT row_number() OVER () AS rid, CAST(doc_id AS BIGINT) AS doc_id, {_TERMS} AS t FROM documents) WHERE len(t) > 0),
c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
f AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM f GROUP BY term), c),
m AS (SELECT rid, doc_id, 75 + (25 * n * n_docs) // n_terms AS m FROM d, c),
b AS (SELECT row_number() OVER () AS q, * FROM (SELECT DISTINCT CAST(item_id AS BIGINT) AS item_id, "text" FROM benchmark)),
q AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest({_TERMS}) AS term FROM b) GROUP BY ALL),
s AS (SELECT q, item_id, m.rid, m.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN m ON m.rid = f.rid GROUP BY ALL)
SELECT item_id, CAST(r AS INTEGER) AS "rank", doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS r FROM s WHERE score > 0) WHERE r <= 20
"""

ORACLES = {
    "op1_decontaminate": OP1,
    "op3_top_k": OP3,
    "op7_secret_scan": _op7(),
    "op9_near_duplicates": OP9,
    "op11_prefix_trie": OP11,
    "op12_lexical_search": OP12,
}
