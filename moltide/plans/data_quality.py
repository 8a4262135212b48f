"""Queries of problems 1 to 3: faulty rows, implausible readings, drifting schemas."""

from __future__ import annotations

from moltide.operators import drift, parse_faults, spikes
from moltide.plans.tables import table


def p1_found(spark, sf_dir):
    return parse_faults.judged(table(spark, sf_dir, "xyz_lines"), table(spark, sf_dir, "elements"))


def p1_atoms(spark, sf_dir):
    return parse_faults.sound_atoms(table(spark, sf_dir, "xyz_lines"), table(spark, sf_dir, "elements"))


def p1_headers(spark, sf_dir):
    return parse_faults.sound_headers(table(spark, sf_dir, "xyz_lines"), table(spark, sf_dir, "elements"))


def p2_found(spark, sf_dir):
    return spikes.faulty(table(spark, sf_dir, "atoms"), table(spark, sf_dir, "frames"))


def p3_found(spark, sf_dir):
    return drift.changes(table(spark, sf_dir, "file_headers"))


def p3_statistics(spark, sf_dir):
    return drift.path_statistics(table(spark, sf_dir, "file_headers")).drop("written_at")


def p3_table(spark, sf_dir):
    return drift.consistent_table(table(spark, sf_dir, "file_headers"))


QUERIES = {"p1_found": p1_found, "p1_atoms": p1_atoms, "p1_headers": p1_headers, "p2_found": p2_found, "p3_found": p3_found, "p3_statistics": p3_statistics, "p3_table": p3_table}
_names = [(n, g.split()[0]) for g in drift.HEADER_NAMES for n in g.split()] + [(f"properties.{n}", f"properties.{g.split()[0]}") for g in drift.ENTRY_NAMES for n in g.split()]
#: Every path of every header with its kind and value; Properties entries have the fields of the first atom line as value.
_every = r"""h AS (SELECT DISTINCT header_id, series_id, file_id, frame, written_at, header_text AS t, first_atom FROM file_headers WHERE header_id IS NOT NULL AND series_id IS NOT NULL AND file_id IS NOT NULL),
m AS (SELECT header_id, series_id, file_id, frame, written_at, first_atom, unnest(regexp_extract_all(t, '([A-Za-z_][\w.\-]*)\s*[=:]\s*("[^"]*"|\[\s*\[[^=]*?\]\s*\]|\[[^\]]*\]|[^\s,;]+)')) AS pair FROM h),
p AS (SELECT header_id, series_id, file_id, frame, written_at, first_atom, lower(regexp_extract(pair, '^[\w.\-]+')) AS k, trim(replace(regexp_replace(pair, '^[\w.\-]+\s*[=:]\s*', ''), '"', '')) AS v FROM m),
plain AS (SELECT header_id, series_id, file_id, frame, written_at, k AS path, CASE WHEN regexp_full_match(v, '[+-]?\d+') THEN 'whole' WHEN regexp_full_match(v, '{one}') THEN 'decimal' WHEN regexp_full_match(v, '{one}([\s,]+{one}){2}') THEN 'numbers3'
    WHEN regexp_full_match(v, '{one}([\s,]+{one}){8}') THEN 'numbers9' WHEN regexp_full_match(v, '\[\s*\[[^\[\]]*\]\s*,?\s*\[[^\[\]]*\]\s*,?\s*\[[^\[\]]*\]\s*\]') THEN 'bracketed' ELSE 'text' END AS kind, v, 0 AS ord FROM p WHERE k <> 'properties'),
lists AS (SELECT header_id, series_id, file_id, frame, written_at, string_split(v, ':') AS s, list_filter(regexp_split_to_array(coalesce(first_atom, ''), '\s+'), lambda z: z <> '') AS f FROM p WHERE k = 'properties'),
entries AS (SELECT header_id, series_id, file_id, frame, written_at, 'properties.' || lower(s[3 * i + 1]) AS path, upper(s[3 * i + 2]) || ':' || s[3 * i + 3] AS kind,
    array_to_string(f[1 + coalesce(list_sum([CAST(s[3 * j + 3] AS INT) for j in range(i)]), 0)::BIGINT : coalesce(list_sum([CAST(s[3 * j + 3] AS INT) for j in range(i + 1)]), 0)::BIGINT], ' ') AS v, i AS ord FROM lists, unnest(range(len(s) // 3)) u(i)),
every AS (SELECT * FROM plain UNION ALL SELECT * FROM entries)""".replace("{one}", drift.ONE)
#: Numbers of a value that no letter follows (a unit makes it a text to be read up to its digits).
_numbers = "list_filter(regexp_extract_all(v, '[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eEdD][+-]?\\d+)?'), lambda z: TRUE)"
SQL: dict[str, str] = {
    "p1_found": r"""
WITH RECURSIVE l AS (SELECT DISTINCT line_id, file_id, line_no, coalesce(raw_line, '') AS t FROM xyz_lines WHERE file_id IS NOT NULL AND line_no IS NOT NULL),
n AS (SELECT file_id, line_no, CAST(trim(t) AS BIGINT) AS n FROM l WHERE regexp_full_match(t, '\s*\d{1,9}\s*')),
b(file_id, at0, n) AS (SELECT file_id, line_no, n FROM n WHERE line_no = 1 UNION ALL SELECT n.file_id, n.line_no, n.n FROM b JOIN n ON n.file_id = b.file_id AND n.line_no = b.at0 + b.n + 2),
h AS (SELECT b.file_id, b.at0, b.n, l.line_id, l.t, regexp_extract(l.t, '(?i)\bproperties\s*=\s*"?([A-Za-z_]\w*:[A-Za-z]:\d+(?::[A-Za-z_]\w*:[A-Za-z]:\d+)*)', 1) AS spec FROM b JOIN l ON l.file_id = b.file_id AND l.line_no = b.at0 + 1),
w AS (SELECT *, CASE WHEN spec = '' THEN 4 ELSE list_sum([CAST(x AS INTEGER) for x in regexp_extract_all(spec, ':(\d+)', 1)]) END AS want FROM h),
a AS (SELECT l.line_id, l.t, w.want, list_filter(regexp_split_to_array(l.t, '[ \t\r\n]+'), lambda x: x <> '') AS f FROM w JOIN l ON l.file_id = w.file_id AND l.line_no BETWEEN w.at0 + 2 AND w.at0 + 1 + w.n),
ar AS (SELECT line_id, CASE WHEN (length(t) - length(replace(t, '"', ''))) % 2 = 1 THEN 'quoting' WHEN len(f) <> want THEN 'column_count' WHEN f[1] NOT IN (SELECT symb FROM elements) THEN 'bad_symbol'
  WHEN len(list_filter(f[2:4], lambda x: NOT (regexp_full_match(x, '[+-]?(\d+\.?\d*|\.\d+)([eEdD][+-]?\d+)?') AND coalesce(isfinite(TRY_CAST(translate(x, 'dD', 'ee') AS DOUBLE)), FALSE)))) > 0 THEN 'bad_number' END AS reason FROM a),
v AS (SELECT line_id, t, regexp_extract(t, '(?i)(lattice|cell)\s*[=:]\s*("[^"]*"|\[\[.*\]\])', 2) AS raw, regexp_matches(t, '(?i)(lattice|cell)\s*[=:]') AS has FROM w),
c AS (SELECT *, CASE WHEN starts_with(raw, '[') THEN regexp_split_to_array(regexp_replace(raw, '[\[\]\s]', '', 'g'), ',') ELSE list_filter(regexp_split_to_array(trim(raw, '"'), '\s+'), lambda x: x <> '') END AS nums FROM v),
hr AS (SELECT line_id, CASE WHEN (length(t) - length(replace(t, '"', ''))) % 2 = 1 THEN 'quoting' WHEN has AND (len(nums) NOT IN (3, 9) OR (starts_with(raw, '[') AND NOT regexp_full_match(raw, '\[\s*(\[[^\],]+,[^\],]+,[^\],]+\]\s*,?\s*){3}\]'))
  OR len(list_filter(nums, lambda x: NOT (regexp_full_match(x, '[+-]?(\d+\.?\d*|\.\d+)([eEdD][+-]?\d+)?') AND coalesce(isfinite(TRY_CAST(translate(x, 'dD', 'ee') AS DOUBLE)), FALSE)))) > 0) THEN 'bad_lattice' END AS reason FROM c)
SELECT line_id, reason FROM ar WHERE reason IS NOT NULL UNION SELECT line_id, reason FROM hr WHERE reason IS NOT NULL""",
    "p1_atoms": "{p1}, f1 AS (SELECT line_id FROM ar WHERE reason IS NOT NULL), g AS (SELECT l.line_id, w.file_id, w.at0 AS block, CAST(l.line_no - w.at0 - 2 AS INTEGER) AS at_idx, list_filter(regexp_split_to_array(l.t, '[ \\t\\r\\n]+'), lambda x: x <> '') AS f FROM w JOIN l ON l.file_id = w.file_id AND l.line_no BETWEEN w.at0 + 2 AND w.at0 + 1 + w.n WHERE l.line_id NOT IN (SELECT line_id FROM f1)) SELECT line_id, file_id, block, at_idx, f[1] AS symb, CAST(translate(f[2], 'dD', 'ee') AS DOUBLE) AS x, CAST(translate(f[3], 'dD', 'ee') AS DOUBLE) AS y, CAST(translate(f[4], 'dD', 'ee') AS DOUBLE) AS z FROM g",
    "p1_headers": "{p1}, k AS (SELECT c.*, w.file_id, w.at0 AS block, [CAST(translate(trim(x), 'dD', 'ee') AS DOUBLE) for x in nums] AS u FROM c JOIN w USING (line_id) WHERE line_id NOT IN (SELECT line_id FROM hr WHERE reason IS NOT NULL)), d AS (SELECT line_id, file_id, block, has, CASE WHEN NOT has THEN NULL WHEN len(u) = 3 THEN [u[1], 0, 0, 0, u[2], 0, 0, 0, u[3]] ELSE u END AS m FROM k) SELECT line_id, file_id, block, has AS has_cell, m[1] AS a1x, m[2] AS a1y, m[3] AS a1z, m[4] AS a2x, m[5] AS a2y, m[6] AS a2z, m[7] AS a3x, m[8] AS a3y, m[9] AS a3z FROM d",
    "p3_found": r"""
WITH RECURSIVE q(name, quantity) AS (VALUES {names}),
{every},
val AS (SELECT series_id, file_id, header_id, frame, written_at, path, kind, ord, v, [TRY_CAST(translate(x, 'dD', 'ee') AS DOUBLE) for x in {numbers}] AS u FROM every),
x AS (SELECT *, list_filter(u, lambda z: z IS NOT NULL AND z <> 0) AS y, CASE WHEN len(u) = 1 AND frame <> 0 THEN u[1] / frame END AS rate FROM val),
pk AS (SELECT series_id, file_id, path, kind, count(*) AS c, avg(ord) AS ord, avg(len(u)) AS width, sum(len(y)) AS n, sum(list_sum(y)) AS s1, sum(list_sum([z * z for z in y])) AS s2, min(rate) AS lo, max(rate) AS hi, min(CASE WHEN len(u) = 0 THEN v END) AS tlo, max(CASE WHEN len(u) = 0 THEN v END) AS thi FROM x GROUP BY ALL),
files AS (SELECT series_id, file_id, min(written_at) AS w, count(DISTINCT header_id) AS n FROM every GROUP BY ALL),
pa AS (SELECT series_id, file_id, path, files.n AS heads, sum(c) AS c, arg_max(kind, (c, kind)) AS kind, arg_max(width, (c, kind)) AS width, arg_max(ord, (c, kind)) AS ord, sum(pk.n) AS n, sum(s1) / sum(pk.n) AS m, sum(s2) / sum(pk.n) AS m2, min(lo) AS lo, max(hi) AS hi, min(tlo) AS tlo, max(thi) AS thi FROM pk JOIN files USING (series_id, file_id) GROUP BY series_id, file_id, path, files.n),
lay AS (SELECT series_id, file_id, path, kind, width, coalesce(m, 0) AS mean, sqrt(greatest(coalesce(m2 - m * m, 0), 0)) + {near} * abs(coalesce(m, 0)) AS spread, CASE WHEN abs(hi - lo) <= 1e-3 * abs(hi) THEN hi END AS rate, CASE WHEN starts_with(path, 'properties.') THEN rank() OVER (PARTITION BY series_id, file_id, starts_with(path, 'properties.') ORDER BY ord) END AS place, tlo, thi FROM pa WHERE c * 2 >= heads),
o AS (SELECT series_id, file_id, lag(file_id) OVER (PARTITION BY series_id ORDER BY w, file_id) AS prev FROM files),
cur AS (SELECT o.series_id, o.file_id, l.* EXCLUDE (series_id, file_id), q.quantity FROM o JOIN lay l ON l.series_id = o.series_id AND l.file_id = o.file_id LEFT JOIN q ON q.name = l.path WHERE o.prev IS NOT NULL),
old AS (SELECT o.series_id, o.file_id, l.* EXCLUDE (series_id, file_id), q.quantity FROM o JOIN lay l ON l.series_id = o.series_id AND l.file_id = o.prev LEFT JOIN q ON q.name = l.path WHERE o.prev IS NOT NULL),
gone AS (SELECT * FROM old ANTI JOIN cur USING (series_id, file_id, path)),
fresh AS (SELECT * FROM cur ANTI JOIN old USING (series_id, file_id, path)),
sc AS (SELECT g.series_id, g.file_id, g.path AS was, f.path AS now, g.kind AS k0, f.kind AS k1,
    CASE WHEN g.width = 0 AND f.width = 0 THEN ((coalesce(g.tlo = f.tlo, FALSE))::INT + (coalesce(g.thi = f.thi, FALSE))::INT) / 2.0 WHEN g.width = 0 OR f.width = 0 THEN 0.0
         WHEN least(g.width, f.width) < 3 AND round(g.width) <> round(f.width) THEN 0.0 WHEN coalesce(abs(g.rate - f.rate) <= 1e-3 * abs(g.rate), FALSE) THEN 1.0
         ELSE exp(-abs(g.mean - f.mean) / (g.spread + f.spread + 1e-12)) * exp(-abs(ln((g.spread + 1e-12) / (f.spread + 1e-12))) / 2) END
    + {part} * ((g.kind = f.kind)::INT + (coalesce(g.place = f.place, FALSE))::INT) + coalesce(CASE WHEN g.quantity = f.quantity THEN {name} WHEN g.quantity <> f.quantity THEN -{name} END, 0) AS score
    FROM gone g JOIN fresh f ON f.series_id = g.series_id AND f.file_id = g.file_id AND starts_with(f.path, 'properties.') = starts_with(g.path, 'properties.')),
rk AS (SELECT *, row_number() OVER (PARTITION BY series_id, file_id ORDER BY round(score, 9) DESC, was, now) AS k FROM sc WHERE score >= {least}),
st(series_id, file_id, k, used, taken) AS (SELECT DISTINCT series_id, file_id, 0::BIGINT, CAST([] AS VARCHAR[]), FALSE FROM rk
    UNION ALL SELECT st.series_id, st.file_id, rk.k, CASE WHEN list_contains(used, '<' || was) OR list_contains(used, '>' || now) THEN used ELSE used || ['<' || was, '>' || now] END, NOT (list_contains(used, '<' || was) OR list_contains(used, '>' || now)) FROM st JOIN rk ON rk.series_id = st.series_id AND rk.file_id = st.file_id AND rk.k = st.k + 1),
ren AS (SELECT rk.* FROM rk JOIN st USING (series_id, file_id, k) WHERE taken)
SELECT series_id, file_id, path AS field, 'removed' AS change FROM gone ANTI JOIN (SELECT series_id, file_id, was AS path FROM ren) USING (series_id, file_id, path)
UNION ALL SELECT series_id, file_id, path, 'added' FROM fresh ANTI JOIN (SELECT series_id, file_id, now AS path FROM ren) USING (series_id, file_id, path)
UNION ALL SELECT series_id, file_id, was, 'renamed' FROM ren
UNION ALL SELECT series_id, file_id, was, 'retyped' FROM ren WHERE k0 <> k1
UNION ALL SELECT series_id, file_id, path, 'retyped' FROM old JOIN cur USING (series_id, file_id, path) WHERE old.kind <> cur.kind""",
    "p3_statistics": """
WITH {every},
pk AS (SELECT series_id, file_id, path, kind, count(*) AS n_headers FROM every GROUP BY ALL),
files AS (SELECT series_id, file_id, count(DISTINCT header_id) AS n_readable FROM every GROUP BY ALL)
SELECT series_id, file_id, path, kind, n_headers, n_readable FROM pk JOIN files USING (series_id, file_id)""",
}
for _k in ("p1_atoms", "p1_headers"):
    SQL[_k] = SQL[_k].replace("{p1}", SQL["p1_found"].rsplit("SELECT line_id, reason FROM ar", 1)[0].rstrip())
_fixed = {"{names}": ", ".join(map(str, _names)), "{every}": _every, "{numbers}": _numbers, "{near}": str(drift.NEAR), "{part}": str(drift.PART), "{name}": str(drift.NAME), "{least}": str(drift.LEAST)}
for _k in ("p3_found", "p3_statistics"):
    for _a, _b in _fixed.items():
        SQL[_k] = SQL[_k].replace(_a, _b)
