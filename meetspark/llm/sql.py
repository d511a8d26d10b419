"""DuckDB SQL for the queries that SQL can express."""

import math

from .licenses import PHRASES, TEMPLATES, THRESHOLD

_SPLIT = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '')"
_FOLD = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN firsts USING (k) WHERE m < doc_id),
places AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP2 = f"""
WITH d AS (SELECT doc_id, {_FOLD} AS w FROM documents),
b AS (SELECT item_id, {_FOLD} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f'w[i + {j}] IS NOT DISTINCT FROM {chr(39)}{x}{chr(39)}' for j, x in enumerate(phrase.split()))})) - 1 AS pos FROM d"
    for phrase, label in sorted(PHRASES.items())
)
_SETS = [(label, sorted(set(text.split()))) for label, texts in sorted(TEMPLATES.items()) for text in texts]
_TEMPLATES = ", ".join(f"('{label}', {words}, {math.ceil(THRESHOLD * len(words) - 1e-9)})" for label, words in _SETS)

_MOST = max(len(text.split()) for texts in TEMPLATES.values() for text in texts)

OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_FOLD} AS w FROM documents),
p AS ({_PLACES}),
l AS (SELECT doc_id, unnest(x) AS text, unnest(range(0, len(x))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM d)),
lw AS (SELECT doc_id, list(w ORDER BY line) AS lines FROM (SELECT doc_id, line, {_FOLD} AS w FROM l) WHERE len(w) > 0 GROUP BY doc_id HAVING count(*) > 1),
r AS (SELECT doc_id, i, lines[i][greatest(len(lines[i]) - {_MOST - 2}, 1):] AS head, flatten(list_transform(lines[i + 1:i + {_MOST - 1}], lambda x: x[1:{_MOST - 1}]))[1:{_MOST - 1}] AS tail
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM lw)),
b AS (SELECT doc_id, false AS wrapped, line, list_distinct({_FOLD}) AS block FROM l
      UNION ALL SELECT doc_id, true, i, list_distinct(list_concat(head, tail)) FROM r),
t(label, words, needed) AS (VALUES {_TEMPLATES}),
c AS (SELECT doc_id, wrapped, line, label, needed, len(list_intersect(block, words)) AS n, len(words) AS size FROM b, t),
best AS (SELECT doc_id, label, n / size AS score FROM c WHERE n >= needed QUALIFY n / size = max(n / size) OVER (PARTITION BY doc_id, wrapped, line, split_part(label, '-', 1))),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION SELECT doc_id, label FROM best) GROUP BY doc_id),
scores AS (SELECT doc_id, max(score) AS score FROM best GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN scores USING (doc_id)
"""

OP10 = f"""
WITH l AS (SELECT doc_id, unnest(x) AS text, unnest(range(0, len(x))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
k AS (SELECT doc_id, pos, text, {_SPLIT} AS w FROM l),
u AS (SELECT w, min((doc_id, pos)) AS first FROM k WHERE len(w) > 0 GROUP BY w),
v AS (SELECT first, gap, array_to_string(CASE WHEN gap = 0 THEN w ELSE list_concat(w[1:gap - 1], w[gap + 1:]) END, ' ') AS v
      FROM (SELECT first, w, unnest(range(0, len(w) + 1)) AS gap FROM u WHERE len(w) >= 5)),
b AS (SELECT v, gap, min(first) AS lo FROM v GROUP BY v, gap),
m AS (SELECT v, min(first) FILTER (gap = 0) AS whole, min(first) FILTER (gap > 0) AS variant FROM v GROUP BY v),
near AS (SELECT DISTINCT first, true AS near FROM v JOIN b USING (v, gap) JOIN m USING (v) WHERE CASE WHEN gap = 0 THEN variant < first ELSE lo < first OR whole < first END),
g AS (SELECT k.doc_id, k.pos, k.text, coalesce((k.doc_id, k.pos) > u.first OR near, false) AS gone FROM k LEFT JOIN u USING (w) LEFT JOIN near USING (first)),
r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(kept) AS kept_sha256 FROM documents LEFT JOIN r USING (doc_id)
"""

_NEAREST = "SELECT vec_id, v, sha, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (SELECT vec_id, v, sha, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT AS d FROM kept, c{r}) GROUP BY ALL"
_MEANS = """
a{r} AS (%s),
g{r} AS (SELECT cluster, list(((s - ((s %% n + n) %% n)) // n)::BIGINT ORDER BY i) AS m FROM (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) AS x(i) GROUP BY ALL) GROUP BY cluster),
c{n} AS (SELECT c, coalesce(g{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN g{r} ON c = cluster)""" % _NEAREST

OP11 = f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v, sha256('1:' || vec_id) AS sha FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT (row_number() OVER (ORDER BY sha, v) - 1)::INTEGER AS c, v AS m FROM kept QUALIFY c < 16),
{",".join(_MEANS.format(r=r, n=r + 1) for r in range(3))},
a3 AS ({_NEAREST.format(r=3)})
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c = cluster
"""

OP13 = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS s FROM documents),
u AS (SELECT *, ('0x' || s[1:8])::UBIGINT % (n + 1) AS a, ('0x' || s[9:16])::UBIGINT % (n + 1) AS b, ('0x' || s[17:24])::UBIGINT AS h3, ('0x' || s[25:32])::UBIGINT AS h4 FROM h),
f AS (SELECT *, least(a, b)::BIGINT AS lo, greatest(a, b)::BIGINT AS hi,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substring(t, 1, lo) AS x, substring(t, lo + 1, hi - lo) AS y, substring(t, hi + 1) AS z FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1, "op2_decontaminate": OP2, "op8_licenses": OP8, "op10_line_dedup": OP10, "op11_centroids": OP11, "op13_fill_in_middle": OP13}
