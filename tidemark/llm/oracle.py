"""DuckDB SQL for the operator queries that SQL can express, over whole tables."""

from __future__ import annotations

#: Words, and lower case of A-Z only, as the queries take them.
_SPACE = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = """
WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, unnest(range(0, CAST(length(h) // 2 AS BIGINT) - 99)) AS pos FROM t),
w AS (SELECT r, pos, md5(substr(h, 2 * pos + 1, 200)) AS k FROM p JOIN t USING (r)),
f AS (SELECT r, pos, row_number() OVER (PARTITION BY k ORDER BY r, pos) > 1 AS again FROM w),
g AS (SELECT r, pos, pos - coalesce(lag(pos) OVER o, -101) > 100 AS new FROM f WHERE again WINDOW o AS (PARTITION BY r ORDER BY pos)),
i AS (SELECT r, pos, sum(CAST(new AS INT)) OVER (PARTITION BY r ORDER BY pos) AS run FROM g),
s AS (SELECT r, run, min(pos) AS a, max(pos) + 100 AS b FROM i GROUP BY 1, 2),
c AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
k AS (SELECT r, count(*) AS n, sum(b - a) AS lost, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM c JOIN t USING (r) GROUP BY 1)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(lost, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM t LEFT JOIN k USING (r)"""

OP4 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_SPACE}')) AS BIGINT) AS size, length(coalesce(text, '')) AS chars,
  md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || coalesce(text, '')) AS h FROM documents),
e AS (SELECT doc_id, source, size, -ln((CAST('0x' || substr(h, 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
  / greatest(least(1.0::DOUBLE, 6.5::DOUBLE * size / greatest(chars, 1)), 1e-6::DOUBLE) AS key FROM d),
s AS (SELECT source, sum(size)::DOUBLE AS z, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM e GROUP BY 1),
l AS (SELECT *, z * 3 AS most, z * 3 / w AS level FROM s),
b AS (SELECT *, coalesce(sum(most) OVER o, 0) AS capped, coalesce(sum(w) OVER o, 0) AS used, sum(z) OVER () AS total, sum(w) OVER () AS weight FROM l
  WINDOW o AS (ORDER BY level, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (total - capped) / (weight - used) AS share FROM b),
m AS (SELECT coalesce(max(CASE WHEN share <= level THEN share END), 0) AS lv FROM v),
g AS (SELECT source, CAST(z AS BIGINT) AS source_size, least(most, w * lv) AS target FROM v, m),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g),
q AS (SELECT *, CAST(round(target - epochs * source_size) AS BIGINT) AS rest FROM p),
c AS (SELECT e.*, source_size, target, epochs, rest, coalesce(sum(size) OVER (PARTITION BY e.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM e JOIN q ON e.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - done)) AS BIGINT) AS taken, epochs FROM c"""

OP6 = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL),
u AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
c AS (WITH RECURSIVE r(id, to_id) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.to_id) SELECT id, min(to_id) AS component_id FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS k FROM l GROUP BY 1)
SELECT v.vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""

_TWICE = "length({0}) + " + " + ".join(f"length({{0}}) - length(replace({{0}}, '{c}', ''))" for c in ("\\", "<", "["))

OP7 = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS LAST, role, t) AS said,
  string_agg(CASE WHEN role = 'assistant' THEN t ELSE '' END, '' ORDER BY turn NULLS LAST, role, t) AS loss,
  sum(24 + {_TWICE.format("role")} + length(role) - length(replace(role, chr(10), '')) + {_TWICE.format("t")}) AS chars FROM r GROUP BY 1)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g"""

OP9 = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_SPACE}') AS ws FROM documents),
e AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) END AS sh FROM w),
x AS (SELECT r, unnest(sh) AS g FROM e),
n AS (SELECT r, doc_id, len(sh) AS n FROM e),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT p.doc_id AS a, q.doc_id AS b FROM pairs JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
y AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (WITH RECURSIVE z(id, to_id) AS (SELECT doc_id, doc_id FROM n UNION SELECT z.id, y.b FROM z JOIN y ON y.a = z.to_id) SELECT id, min(to_id) AS component_id FROM z GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id FROM n JOIN c ON c.id = n.doc_id"""

#: crc32 of an id's decimal digits, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: [ascii(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, d: xor(xor(c, d) >> 1, 3988292384 * (xor(c, d) & 1))), 4294967295)"""
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"


def _tree(rows: str, name: str) -> str:
    """CTEs over leaves (g, idx, digest): {name}_u, every node with its place, and {name}_p, each leaf's siblings by level."""
    return f"""{name}_c AS (SELECT g, count(*) AS n FROM {rows} GROUP BY 1),
{name}_u AS (SELECT 0 AS lv, g, idx, n, digest FROM {rows} JOIN {name}_c USING (g)
  UNION ALL SELECT lv + 1, g, idx // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name}_u WHERE n > 1 GROUP BY lv, g, idx // 3),
{name}_p AS (SELECT a.lv, a.g, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lo, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS hi
  FROM {name}_u a JOIN {name}_u b ON a.lv = b.lv AND a.g = b.g AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY 1, 2, 3)"""


OP11 = f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce('1' || source, '0') AS g, {_LEAF.format("text")} AS digest, {_LEAF.format("text")} AS leaf,
  CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} ELSE {_LEAF.format("text")} END AS tampered FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx FROM t),
{_tree("d", "x")},
r AS (SELECT 0 AS g, g AS name, digest, row_number() OVER (ORDER BY g) - 1 AS idx FROM x_u WHERE n = 1),
{_tree("r", "y")},
way AS (SELECT doc_id, d.idx AS leaf_at, d.g, p.lv, lo, hi FROM d JOIN x_p p ON p.g = d.g AND p.idx = d.idx // CAST(3 ** p.lv AS BIGINT)
  UNION ALL SELECT doc_id, d.idx, d.g, 100 + p.lv, lo, hi FROM d JOIN r ON r.name = d.g JOIN y_p p ON p.idx = r.idx // CAST(3 ** p.lv AS BIGINT)),
step AS (SELECT *, row_number() OVER (PARTITION BY g, leaf_at ORDER BY lv) AS k FROM way),
f AS (SELECT g, idx AS leaf_at, 1 AS k, tampered AS digest FROM d
  UNION ALL SELECT f.g, f.leaf_at, f.k + 1, sha256(lo || digest || hi) FROM f JOIN step s ON s.g = f.g AND s.leaf_at = f.leaf_at AND s.k = f.k),
e AS (SELECT g, leaf_at, arg_max(digest, k) AS folded_root FROM f GROUP BY 1, 2),
q AS (SELECT g, leaf_at, sha256(string_agg(lo || hi, '' ORDER BY k)) AS proof_sha256 FROM step GROUP BY 1, 2),
z AS (SELECT digest AS root FROM y_u WHERE n = 1)
SELECT doc_id, leaf, r.digest AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM d JOIN r ON r.name = d.g JOIN e ON e.g = d.g AND e.leaf_at = d.idx LEFT JOIN q ON q.g = d.g AND q.leaf_at = d.idx, z"""

OP12 = rf"""
WITH a AS (SELECT row_number() OVER () AS r, doc_id, {_CRC} AS h, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents),
b AS (SELECT *, len(w) AS n, (h // 10) % nullif(len(w), 0) AS c, 1 + (len(w) - (h // 10) % nullif(len(w), 0)) // (3 + (h // 10) % 8) AS p FROM a),
d AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: CASE WHEN i < c THEN w[i + 1] ELSE w[c + (i - c) % p + 1] END) ELSE w END AS w FROM b),
x AS (SELECT r, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM d),
y AS (SELECT r, n, i, word, md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS five FROM x),
s AS (SELECT a.r, b.i - a.i AS q, a.i FROM y a JOIN y b ON a.r = b.r AND a.five = b.five AND b.i > a.i AND 4 * (b.i - a.i) <= a.n WHERE b.i + 5 <= b.n),
t AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS stretch FROM s),
u AS (SELECT r, q, min(i) AS start, max(i) - min(i) + 5 + q AS length FROM t GROUP BY r, q, stretch),
v AS (SELECT r, start, length, min(q) AS period FROM u WHERE length >= greatest(6, 4 * q) GROUP BY 1, 2, 3),
o AS (SELECT r, count(*) AS n_runs, first((start, length, period) ORDER BY length DESC, start, period) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM v GROUP BY 1),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.r = x.r AND x.i >= v.start + v.period AND x.i < v.start + v.length) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period, 1000 * best[2] // best[3] AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN o USING (r) LEFT JOIN k USING (r)"""

ORACLES = {
    "op3_suffix_dedup": OP3,
    "op4_source_mix": OP4,
    "op6_embedding_dedup": OP6,
    "op7_chat_format": OP7,
    "op9_jaccard_join": OP9,
    "op11_merkle_manifest": OP11,
    "op12_periodic_runs": OP12,
}
