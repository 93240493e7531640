"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES = {
    "op1_dartminhash": r"""WITH RECURSIVE n AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS w, coalesce(text, '') AS raw FROM documents),
k AS (SELECT doc_id, CASE WHEN w = '' THEN chr(0) || raw ELSE w END AS k, string_split(w, ' ') AS l, w <> '' AS has FROM n),
t AS (SELECT min(doc_id) AS id, k, any_value(l) AS l, any_value(has) AS has FROM k GROUP BY k),
g AS (SELECT id, array_to_string(l[i:i + least(5, len(l)) - 1], ' ') AS s, count(*) AS c FROM t, unnest(range(1, len(l) - least(5, len(l)) + 2)) AS u(i) WHERE has GROUP BY ALL),
z AS (SELECT id, sum(c) AS n FROM g GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, sum(least(a.c, b.c)) AS i FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z za ON za.id = a JOIN z zb ON zb.id = b WHERE i >= 0.8 * (za.n + zb.n - i)),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(n, m) AS (SELECT a, a FROM both_ UNION SELECT both_.b, r.m FROM r JOIN both_ ON both_.a = r.n),
c AS (SELECT n, min(m) AS m FROM r GROUP BY n)
SELECT k.doc_id, coalesce(c.m, t.id) AS class_id, k.doc_id = coalesce(c.m, t.id) AS kept FROM k JOIN t USING (k) LEFT JOIN c ON c.n = t.id""",
    "op5_hnsw": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r(n, m) AS (SELECT a, a FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n),
c AS (SELECT n, min(m) AS m FROM r GROUP BY n), l AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(l.n, 0) AS n_links, coalesce(c.m, vec_id) AS component_id, vec_id = coalesce(c.m, vec_id) AS kept FROM v LEFT JOIN l ON l.a = vec_id LEFT JOIN c ON c.n = vec_id""",
    "op6_chat_perspectives": """WITH t AS (SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS text FROM conversations), w AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT t.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role, CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker END AS name FROM t JOIN w USING (conv_id)),
h AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM r), s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, speaker, text)::BIGINT AS e, row_number() OVER (PARTITION BY conv_id, perspective, turn // 256 ORDER BY turn, speaker, text) AS place FROM s)
SELECT conv_id, perspective, turn, place, role, name, segment, e - length(segment) AS start, e AS "end", CASE WHEN role = 'assistant' THEN e - length(segment) + length(head) ELSE e - length(segment) END AS mask_start,
CASE WHEN role = 'assistant' THEN e - 1 ELSE e - length(segment) END AS mask_end, role = 'assistant' AS learn FROM o""",
}
