"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import licenses


def mixing(short: int, seed: int = 7) -> str:
    """op7: the whole order of each source at once, where the operator looks for the cut bin by bin."""
    return rf"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS own, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
p AS (SELECT *, CASE WHEN size < {short} THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS prior FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM p GROUP BY source),
r AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
l AS (SELECT *, 2.0::DOUBLE * source_size AS lim, 2.0::DOUBLE * source_size / weight AS reached FROM r),
v AS (SELECT *, row_number() OVER o AS turn,
  (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM l WINDOW o AS (ORDER BY reached, source IS NULL, source), b AS (ORDER BY reached, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, turn) AS level FROM v WHERE level <= reached),
t AS (SELECT source, source_size, CASE WHEN f.level IS NULL THEN lim ELSE least(lim, f.level * weight) END AS target FROM v LEFT JOIN f ON true),
c AS (SELECT p.source, prior, any_value(source_size) AS source_size, any_value(target) AS target, sum(size) AS words FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source GROUP BY p.source, prior),
e AS (SELECT *, (target - 2 * coalesce(sum(words) OVER (PARTITION BY source ORDER BY prior DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(words * prior) OVER (PARTITION BY source ORDER BY prior DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS factor FROM c),
g AS (SELECT source, arg_max(factor, prior) AS factor FROM e WHERE factor * prior <= 2 * (1 + 1e-12::DOUBLE) GROUP BY source),
x AS (SELECT e.source, e.prior, source_size, target, words, least(2.0::DOUBLE, coalesce(g.factor * prior, 2.0::DOUBLE)) AS expected FROM e LEFT JOIN g ON e.source IS NOT DISTINCT FROM g.source),
y AS (SELECT *, floor(expected + 1e-9::DOUBLE)::BIGINT AS whole FROM x),
z AS (SELECT source, prior, source_size, target, whole, greatest(0, expected - whole) AS pr, target - sum(whole * words) OVER (PARTITION BY source) AS need FROM y),
q AS (SELECT doc_id, size, z.source, source_size, target, whole, need, pr, (('0x' || md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || own)[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM p JOIN z ON p.source IS NOT DISTINCT FROM z.source AND p.prior = z.prior),
k AS (SELECT *, CASE WHEN pr > 1e-9 AND size > 0 THEN (u / (1 - u)) / (pr / (1 - pr)) END AS odds FROM q),
n AS (SELECT *, sum(CASE WHEN odds IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY odds / (1 + odds), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM (SELECT *, CASE WHEN size > 0 THEN whole + coalesce(odds IS NOT NULL AND upto - size / 2.0::DOUBLE <= need, false)::BIGINT ELSE 0 END AS copies FROM n)"""


def license_scan(dice: float = 0.8) -> str:
    """op6: every unit against every template, where the operator asks for few words first."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"  # noqa: E731
    rows = ", ".join(f"({quoted(k)}, [{', '.join(map(quoted, licenses.bigrams(v)))}])" for k, v in sorted(licenses.TEMPLATES.items()))
    return rf"""
WITH t(license, grams) AS (VALUES {rows}),
u AS (SELECT doc_id, unnest(list_distinct(list_concat(list_concat(string_split(text, chr(10)), string_split_regex(text, '\n[ \t\r]*\n')), [text]))) AS unit FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(lower(unit), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM u),
g AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
m AS (SELECT doc_id, license, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM g, t),
b AS (SELECT doc_id, license, max(dice) AS dice FROM m WHERE dice >= {dice} GROUP BY doc_id, license)
SELECT documents.doc_id, count(license) AS n_licenses, coalesce(string_agg(license, ',' ORDER BY license), '') AS licenses, list(license ORDER BY dice DESC, license)[1] AS best_license, max(dice) AS best_dice FROM documents LEFT JOIN b USING (doc_id) GROUP BY documents.doc_id"""


def near_duplicates(percent: int = 85) -> str:
    """op10: all pairs of texts that share a shingle, and what links reach, where the operator searches a forest."""
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN list_filter([array_to_string(w, ' ')], lambda x: x <> '') ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM t),
e AS MATERIALIZED (SELECT doc_id, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS lo, b.doc_id AS hi, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT lo, hi FROM p JOIN s u ON u.doc_id = lo JOIN s v ON v.doc_id = hi WHERE 100 * i >= {percent} * (len(u.g) + len(v.g) - i)),
n AS MATERIALIZED (SELECT lo AS a, hi AS b FROM l UNION ALL SELECT hi, lo FROM l),
r(a, b) AS (SELECT a, b FROM n UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a),
c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT s.doc_id, coalesce(len(g), 0)::BIGINT AS n_shingles, least(s.doc_id, coalesce(c.least, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(c.least, s.doc_id)) AS kept FROM s LEFT JOIN c ON c.doc_id = s.doc_id"""
