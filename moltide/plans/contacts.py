"""Queries of contacts, hydrogen bonds, lifetimes and molecules over the trajectory tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from moltide.functions import fits
from moltide.functions.elements import R_COV, R_VDW
from moltide.operators import contacts as K
from moltide.operators import lifetime as L
from moltide.operators import molecules as M
from moltide.operators import pairs as P
from moltide.plans.structure import _ang, _dot, _masses, _near, _rel, _v, placed
from moltide.plans.tables import SQL_ATOMS, SQL_BASE, atoms, cells, frames, rounded, sql_bin, sql_diff, sql_mic, symbols, table
from moltide.session import written
from moltide.sources import records

KEY = ["run_id", "frame"]
#: Named sites of the queries: two waters, an amine, a fluorine group and a carboxylate.
SITES = [{"O": 0, "H1": 1, "H2": 2}, {"O": 3, "H1": 4, "H2": 5}, {"N": 6, "H": 7}, {"F1": 8, "F2": 9}, {"O1": 10, "O2": 11}]
DONORS, ACCEPTORS = P.find_d_a(SITES)
CANDIDATES = P.pair_d_a(DONORS, ACCEPTORS)
TRIPLES = [(d, h, a) for _, d, h, _, a in CANDIDATES]
PAIRS = P.dimer_pairs([0, 2, 4, 6], [1, 3, 5, 7])
MOLECULES = [(0, 0), (0, 1), (0, 2), (1, 3), (1, 4), (1, 5), (2, 6), (2, 7), (2, 8)]
MOL_PAIRS = [(0, 1), (0, 2), (1, 2)]
LIMIT, COM_LIMIT, WINDOW = 9.0, 9.0, 12
TAU, DR = (0.0, 0.12, 12), (0.0, 2.0, 20)
#: The bond graph of the sparse test systems needs a wide factor for bonds to exist.
BOND_FACTOR = 1.6


def hbond_sites(spark, d):
    """Each frame's number of present donors and acceptors of the named sites."""
    rows = [("donor", i, a) for i, s in enumerate(DONORS) for a in s.values()] + [("acceptor", i, a) for i, s in enumerate(ACCEPTORS) for a in s.values()]
    sites = spark.createDataFrame(rows, "role string, site int, at_idx int")
    return atoms(spark, d).join(F.broadcast(sites), "at_idx").groupBy("run_id", "role", "site").agg(F.count("*").alias("n"))


def hbond_candidates(spark, d):
    g = K.hbond_geometry(atoms(spark, d), cells(spark, d), P.tuples(spark, TRIPLES))
    return rounded(g.select(*KEY, "tuple_id", "a0", "a1", "a2", "r_da", "r_dh", "angle").withColumn("angle", F.round("angle", 3)).withColumn("angle", F.when(F.isnan("angle"), -1.0).otherwise(F.col("angle"))), 5)


def _hbonds(spark, d):
    return K.hbonds(atoms(spark, d), cells(spark, d), P.tuples(spark, TRIPLES), 2.5)


def hbonds(spark, d):
    return rounded(_hbonds(spark, d).select(*KEY, "tuple_id", "a0", "a1", "a2", "r_da", "r_dh", "angle"), 4)


def hbond_counts(spark, d):
    return K.hbond_counts(_hbonds(spark, d), frames(spark, d))


def hbond_filter(spark, d):
    return K.hbond_counts(K.involving(_hbonds(spark, d), [0, 1, 2]), frames(spark, d))


def hbond_records(spark, d):
    """One record per frame as the JSON sink writes them; lists shown by their atoms, with the sum of their distances."""
    r = records.hbond_records(_hbonds(spark, d), frames(spark, d))
    shown = F.array_join(F.transform("hbonds", lambda b: F.concat_ws(">", b.donor, b.hydrogen, b.acceptor)), " ").alias("bonds")
    return rounded(r.select(*KEY, "n_hbonds", shown, F.aggregate("hbonds", F.lit(0.0), lambda s, b: s + b["R(D-A)"]).alias("sum_da")), 4)


def dimer_json(spark, d):
    """Contact records of both modes as the JSON sink writes them: frames without contacts have empty lists."""
    f = frames(spark, d)
    a = records.dimer_records(K.dimers_distance(atoms(spark, d), cells(spark, d), P.tuples(spark, PAIRS), LIMIT), f).select(*KEY, F.lit("distance").alias("criterion"), F.array_join(F.transform("pairs", lambda p: F.concat_ws("-", p)), " ").alias("listed"))
    b = records.hbond_dimer_records(_hbonds(spark, d), f).select(*KEY, F.lit("hbond").alias("criterion"), F.array_join(F.transform("d_h_a_pairs", lambda p: F.concat_ws(">", p)), " ").alias("listed"))
    return a.unionByName(b)


def hbond_heatmap(spark, d):
    from moltide.operators.hist import histogram2d

    g = K.hbond_geometry(atoms(spark, d), cells(spark, d), P.tuples(spark, TRIPLES))
    # NaN is out of every range.
    return histogram2d(g, F.col("r_da"), F.col("angle"), (0.0, 15.0, 30), (0.0, 180.0, 30))


def hbond_heatmap_range(spark, d):
    """The heat map over the range of the data."""
    from moltide.operators.hist import heatmap

    g = written(K.hbond_geometry(atoms(spark, d), cells(spark, d), P.tuples(spark, TRIPLES)).select(F.round("r_da", 4).alias("r_da"), F.round("angle", 4).alias("angle")), "heatmap")
    return rounded(heatmap(g.where(~F.isnan("angle")), F.col("r_da"), F.col("angle"), 20, 20), 4)


def dimers_distance(spark, d):
    return rounded(K.dimers_distance(atoms(spark, d), cells(spark, d), P.tuples(spark, PAIRS), LIMIT))


def dimers_criterion(spark, d):
    return rounded(K.dimers_distance(atoms(spark, d), cells(spark, d), P.tuples(spark, PAIRS), "2.2vdw_sum"))


def dimers_com(spark, d):
    members = spark.createDataFrame(MOLECULES, "mol int, at_idx int")
    return rounded(K.dimers_com(atoms(spark, d), cells(spark, d), members, P.tuples(spark, MOL_PAIRS), COM_LIMIT), 5)


def dimers_angle(spark, d):
    return rounded(K.dimers_angle(atoms(spark, d), cells(spark, d), P.tuples(spark, TRIPLES), LIMIT, 90.0), 4)


def dimers_flexible(spark, d):
    return rounded(K.dimers_angle(atoms(spark, d), cells(spark, d), P.tuples(spark, TRIPLES), "3.0vdw_sum", "300f"), 4)


def survival(spark, d):
    c = K.dimers_distance(atoms(spark, d), cells(spark, d), P.tuples(spark, PAIRS), LIMIT)
    return rounded(L.survival(c, atoms(spark, d), "run_id", ["tuple_id"], WINDOW), 9)


def survival_sampled(spark, d):
    c = K.dimers_distance(atoms(spark, d), cells(spark, d), P.tuples(spark, PAIRS), LIMIT)
    return rounded(L.survival(c, atoms(spark, d), "run_id", ["tuple_id"], WINDOW, 3, 2), 9)


def survival_records(spark, d):
    """Survival of the hydrogen-bond lists of the dimers table, each stream's own frames."""
    t = table(spark, d, "dimers").where(F.col("stream_id").isNotNull() & F.col("frame").isNotNull() & F.col("d_h_a_pairs").isNotNull())
    c = records.contact_lists(t, ["stream_id", "frame"], "d_h_a_pairs", 3).select("stream_id", "frame", "a0", "a2").distinct()
    return rounded(L.survival(c, t, "stream_id", ["a0", "a2"], 5), 9)


def _centers(spark, d):
    """Mean position of each pair of atoms, the second by its image nearest to the first."""
    v = P.vectors(P.positions(atoms(spark, d), P.tuples(spark, PAIRS)), cells(spark, d))
    return v.select(*KEY, "tuple_id", *[(F.col(f"p0{k}") + F.col(f"d{k}") / 2).alias(k) for k in "xyz"])


def dlddf(spark, d):
    c = K.dimers_distance(atoms(spark, d), cells(spark, d), P.tuples(spark, PAIRS), LIMIT)
    moved = L.lifetime_displacement(c, _centers(spark, d), cells(spark, d), "run_id", ["tuple_id"], WINDOW)
    return rounded(L.dlddf(moved, 10.0, TAU, DR))


def _bonds(spark, d, a):
    return M.bonds(a, cells(spark, d), BOND_FACTOR, symbols(spark, d))


def bonds(spark, d):
    return rounded(_bonds(spark, d, atoms(spark, d)))


def molecules(spark, d):
    a = atoms(spark, d)
    return M.molecules(a, M.components(a, _bonds(spark, d, a))).select(*KEY, "mol", "formula", F.array_join(F.col("at_idx").cast("array<string>"), " ").alias("members"))


def molecule_formulas(spark, d):
    a = atoms(spark, d)
    return M.formula_counts(M.molecules(a, M.components(a, _bonds(spark, d, a))))


def biexp_fit(spark, d):
    """Double exponentials of each run's contact survival: no SQL, tested on known curves."""
    c = K.dimers_distance(atoms(spark, d), cells(spark, d), P.tuples(spark, PAIRS), LIMIT)
    s = L.survival(c, atoms(spark, d), "run_id", ["tuple_id"], WINDOW).select("run_id", (F.col("k") * 10.0).alias("t"), "c")
    return fits.fit_bi_exp(s, ["run_id"])


def effective_lifetime(spark, d):
    return biexp_fit(spark, d).select("run_id", (F.col("a") * F.col("tau1") + (1 - F.col("a")) * F.col("tau2")).alias("tau_fs"))


QUERIES = {
    f.__name__: f
    for f in (hbond_sites, hbond_candidates, hbonds, hbond_counts, hbond_filter, hbond_records, dimer_json, hbond_heatmap, hbond_heatmap_range, dimers_distance, dimers_criterion, dimers_com, dimers_angle, dimers_flexible, survival, survival_sampled, survival_records, dlddf, bonds, molecules, molecule_formulas, biexp_fit, effective_lifetime)
}

# ---- SQL ----
_sites = [("donor", i, a) for i, s in enumerate(DONORS) for a in s.values()] + [("acceptor", i, a) for i, s in enumerate(ACCEPTORS) for a in s.values()]
_vdw = "rv(symb, r) AS (VALUES " + ", ".join(f"('{s}', CAST({r} AS DOUBLE))" for s, r in R_VDW.items()) + ")"
_cov = "rc(symb, r) AS (VALUES " + ", ".join(f"('{s}', CAST({r} AS DOUBLE))" for s, r in R_COV.items()) + ")"
_hb = f"""l AS (SELECT p0.run_id, p0.frame, tuple_id, a0, a1, a2, p0.symb AS s0, p1.symb AS s1, p2.symb AS s2, {_v('da', sql_mic(sql_diff('p0', 'p2')))}, {_v('dh', sql_mic(sql_diff('p0', 'p1')))}, {_v('hd', sql_mic(sql_diff('p1', 'p0')))}, {_v('ha', sql_mic(sql_diff('p1', 'p2')))} FROM {placed(TRIPLES)}),
    hb AS (SELECT run_id, frame, tuple_id, a0, a1, a2, s0, s1, s2, sqrt({_dot('da', 'da')}) AS r_da, sqrt({_dot('dh', 'dh')}) AS r_dh, {_ang('hd', 'ha', 'NULL')} AS angle FROM l)"""
_bond = f"{_hb}, {_vdw}, bd AS (SELECT hb.* FROM hb JOIN rv v0 ON v0.symb = s0 JOIN rv v2 ON v2.symb = s2 WHERE r_da <= 2.5 * (v0.r + v2.r) AND angle >= (degrees(atan2(r_da, r_dh)) + 180) * 3 / 8)"
_count = "f AS (SELECT DISTINCT run_id, frame FROM frames WHERE run_id IS NOT NULL AND frame IS NOT NULL), n AS (SELECT run_id, frame, count(*) AS n FROM {src} GROUP BY ALL) SELECT run_id, frame, coalesce(n, 0) AS n_hbonds FROM f LEFT JOIN n USING (run_id, frame)"
_dm = f"l AS (SELECT p0.run_id, p0.frame, tuple_id, a0, a1, p0.symb AS s0, p1.symb AS s1, {_v('d', sql_mic(sql_diff('p0', 'p1')))}, p0.x AS ox, p0.y AS oy, p0.z AS oz FROM {placed(PAIRS)}), dm AS (SELECT *, sqrt({_dot('d', 'd')}) AS dist FROM l)"


def _survival(contacts: str, frames_: str, key: str, ids: str, n: int, sampling: int, stride: int) -> str:
    """Brute force: every origin with every later sampled place of its window."""
    last = (n - 1) // sampling + 1
    on = " AND ".join(f"x.{i.strip()} = y.{i.strip()}" for i in [key, *ids.split(",")])
    return f"""pl AS (SELECT {key}, frame, row_number() OVER (PARTITION BY {key} ORDER BY frame) - 1 AS place, count(*) OVER (PARTITION BY {key}) AS places FROM (SELECT DISTINCT {key}, frame FROM {frames_})),
        ct AS (SELECT DISTINCT {key}, {ids}, place, places FROM {contacts} JOIN pl USING ({key}, frame)),
        og AS (SELECT {key}, place, places FROM pl WHERE place <= places - {n} AND place % {stride} = 0),
        st AS (SELECT ct.{key}, {ids}, ct.place FROM ct JOIN og ON og.{key} = ct.{key} AND og.place = ct.place),
        seen AS (SELECT x.{key}, {', '.join('x.' + i.strip() for i in ids.split(','))}, x.place, (y.place - x.place) // {sampling} AS k FROM st x JOIN ct y ON {on} AND y.place >= x.place AND y.place < x.place + {last * sampling} AND (y.place - x.place) % {sampling} = 0),
        num AS (SELECT *, row_number() OVER (PARTITION BY {key}, {ids}, place ORDER BY k) - 1 AS rn FROM seen),
        alive AS (SELECT {key}, place, k, count(*) AS m FROM num WHERE rn = k GROUP BY ALL),
        init AS (SELECT {key}, place, m AS m0 FROM alive WHERE k = 0),
        tot AS (SELECT {key}, count(*) AS origins, any_value(places) AS places FROM og GROUP BY ALL),
        sh AS (SELECT {key}, k, sum(m / m0) AS s1, sum((m / m0) * (m / m0)) AS s2 FROM alive JOIN init USING ({key}, place) GROUP BY ALL)
        SELECT tot.{key}, CAST(t.k * {sampling} AS INTEGER) AS k, round(coalesce(s1, 0.0) / origins, 9) + 0.0 AS c, round(sqrt(greatest(coalesce(s2, 0.0) / origins - (coalesce(s1, 0.0) / origins) * (coalesce(s1, 0.0) / origins), 0.0)) / sqrt(places // {n}), 9) + 0.0 AS error
        FROM tot CROSS JOIN range({last}) t(k) LEFT JOIN sh ON sh.{key} = tot.{key} AND sh.k = t.k"""


_ct = f"{_dm}, co AS (SELECT run_id, frame, tuple_id FROM dm WHERE dist <= {LIMIT})"
_json = """tx AS (SELECT DISTINCT stream_id, frame, d_h_a_pairs AS t FROM dimers WHERE stream_id IS NOT NULL AND frame IS NOT NULL AND d_h_a_pairs IS NOT NULL),
    nm AS (SELECT stream_id, frame, [CAST(v AS INTEGER) for v in regexp_extract_all(t, '[0-9]+')] AS n FROM tx),
    co AS (SELECT DISTINCT stream_id, frame, n[3 * i + 1] AS a0, n[3 * i + 3] AS a2 FROM nm, unnest(range(len(n) // 3)) u(i))"""
_cd = sql_mic((*[f"q.c{k} - p.c{k}" for k in "xyz"],))
_moved = sql_mic(tuple(f"z.{k} - o.{k}" for k in "xyz"))
_bd = f"{_cov}, rad AS (SELECT a.*, r FROM a JOIN rc USING (symb)), {_near('rad', 'rad', 'p.at_idx < q.at_idx', BOND_FACTOR * 2 * 1.6)}, bd AS (SELECT near.* FROM near JOIN rad p ON p.run_id = near.run_id AND p.frame = near.frame AND p.at_idx = i JOIN rad q ON q.run_id = near.run_id AND q.frame = near.frame AND q.at_idx = j WHERE dist < {BOND_FACTOR} * (p.r + q.r))"
_mol = f"""e AS (SELECT run_id, frame, i AS u, j AS v FROM bd UNION ALL SELECT run_id, frame, j, i FROM bd),
    cc(run_id, frame, at_idx, g) AS (SELECT run_id, frame, at_idx, at_idx FROM a UNION SELECT e.run_id, e.frame, e.v, cc.g FROM cc JOIN e ON e.run_id = cc.run_id AND e.frame = cc.frame AND e.u = cc.at_idx WHERE cc.g < e.v),
    mb AS (SELECT run_id, frame, at_idx, min(g) AS mol FROM cc GROUP BY ALL),
    ns AS (SELECT run_id, frame, mol, symb, count(*) AS n FROM mb JOIN a USING (run_id, frame, at_idx) GROUP BY ALL),
    ml AS (SELECT run_id, frame, mol, string_agg(coalesce(symb, '?') || CASE WHEN n > 1 THEN CAST(n AS VARCHAR) ELSE '' END, '' ORDER BY symb NULLS FIRST) AS formula, CAST(sum(n) AS INTEGER) AS n FROM ns GROUP BY ALL),
    mm AS (SELECT run_id, frame, mol, string_agg(CAST(at_idx AS VARCHAR), ' ' ORDER BY at_idx) AS members FROM mb GROUP BY ALL)"""

SQL = {
    "hbond_sites": f"WITH {SQL_ATOMS}, s(role, site, at_idx) AS (VALUES {', '.join(map(str, _sites))}) SELECT run_id, role, site, count(*) AS n FROM a JOIN s USING (at_idx) GROUP BY ALL",
    "hbond_candidates": f"WITH {SQL_BASE}, {_hb} SELECT run_id, frame, tuple_id, a0, a1, a2, round(r_da, 5) + 0.0 AS r_da, round(r_dh, 5) + 0.0 AS r_dh, coalesce(round(angle, 3), -1.0) + 0.0 AS angle FROM hb",
    "hbonds": f"WITH {SQL_BASE}, {_bond} SELECT run_id, frame, tuple_id, a0, a1, a2, round(r_da, 4) + 0.0 AS r_da, round(r_dh, 4) + 0.0 AS r_dh, round(angle, 4) + 0.0 AS angle FROM bd",
    "hbond_counts": f"WITH {SQL_BASE}, {_bond}, {_count.format(src='bd')}",
    "hbond_filter": f"WITH {SQL_BASE}, {_bond}, {_count.format(src='(SELECT * FROM bd WHERE a0 IN (0, 1, 2) OR a1 IN (0, 1, 2) OR a2 IN (0, 1, 2))')}",
    "hbond_records": f"WITH {SQL_BASE}, {_bond}, f AS (SELECT DISTINCT run_id, frame FROM frames WHERE run_id IS NOT NULL AND frame IS NOT NULL), n AS (SELECT run_id, frame, count(*) AS n, string_agg(a0 || '>' || a1 || '>' || a2, ' ' ORDER BY a0, a1, a2) AS b, sum(r_da) AS s FROM bd GROUP BY ALL) SELECT run_id, frame, CAST(coalesce(n, 0) AS INTEGER) AS n_hbonds, coalesce(b, '') AS bonds, round(coalesce(s, 0.0), 4) + 0.0 AS sum_da FROM f LEFT JOIN n USING (run_id, frame)",
    "dimer_json": f"""WITH {SQL_BASE}, {_bond}, pq AS (SELECT p0.run_id, p0.frame, a0, a1, {_v('d', sql_mic(sql_diff('p0', 'p1')))} FROM {placed(PAIRS)}), f AS (SELECT DISTINCT run_id, frame FROM frames WHERE run_id IS NOT NULL AND frame IS NOT NULL),
        x AS (SELECT run_id, frame, string_agg(a0 || '-' || a1, ' ' ORDER BY a0, a1) AS s FROM pq WHERE sqrt({_dot('d', 'd')}) <= {LIMIT} GROUP BY ALL), y AS (SELECT run_id, frame, string_agg(a0 || '>' || a1 || '>' || a2, ' ' ORDER BY a0, a1, a2) AS s FROM bd GROUP BY ALL)
        SELECT run_id, frame, 'distance' AS criterion, coalesce(s, '') AS listed FROM f LEFT JOIN x USING (run_id, frame) UNION ALL SELECT run_id, frame, 'hbond', coalesce(s, '') FROM f LEFT JOIN y USING (run_id, frame)""",
    "hbond_heatmap": f"WITH {SQL_BASE}, {_hb} SELECT {sql_bin('r_da', 0.0, 15.0, 30)} AS bin_x, {sql_bin('angle', 0.0, 180.0, 30)} AS bin_y, (bin_x + 0.5) * 0.5 AS x, (bin_y + 0.5) * 6.0 AS y, count(*) AS count FROM hb WHERE r_da <= 15.0 AND angle BETWEEN 0 AND 180 GROUP BY ALL",
    "hbond_heatmap_range": f"""WITH {SQL_BASE}, {_hb}, v AS (SELECT round(r_da, 4) AS p, round(angle, 4) AS q FROM hb WHERE angle IS NOT NULL), s AS (SELECT min(p) AS p0, max(p) AS p1, min(q) AS q0, max(q) AS q1 FROM v)
        SELECT CAST(least(floor((p - p0) / (p1 - p0) * 20), 19) AS INTEGER) AS bin_x, CAST(least(floor((q - q0) / (q1 - q0) * 20), 19) AS INTEGER) AS bin_y, round(any_value(p0) + (bin_x + 0.5) * (any_value(p1 - p0) / 20), 4) + 0.0 AS x, round(any_value(q0) + (bin_y + 0.5) * (any_value(q1 - q0) / 20), 4) + 0.0 AS y, count(*) AS count FROM v, s GROUP BY bin_x, bin_y""",
    "dimers_distance": f"WITH {SQL_BASE}, {_dm} SELECT run_id, frame, tuple_id, a0, a1, round(dist, 6) + 0.0 AS dist FROM dm WHERE dist <= {LIMIT}",
    "dimers_criterion": f"WITH {SQL_BASE}, {_dm}, {_vdw} SELECT run_id, frame, tuple_id, a0, a1, round(dist, 6) + 0.0 AS dist FROM dm JOIN rv v0 ON v0.symb = s0 JOIN rv v1 ON v1.symb = s1 WHERE dist <= 2.2 * (v0.r + v1.r)",
    "dimers_com": f"""WITH {SQL_BASE}, {_masses}, mm(mol, at_idx) AS (VALUES {', '.join(map(str, MOLECULES))}), cm AS (SELECT run_id, frame, mol, {', '.join(f'sum(mass * {k}) / sum(mass) AS c{k}' for k in 'xyz')} FROM a JOIN mm USING (at_idx) JOIN e USING (symb) GROUP BY run_id, frame, mol),
        l AS (SELECT p.run_id, p.frame, tuple_id, a0, a1, {_v('d', _cd)} FROM {_rel(MOL_PAIRS)} JOIN cm p ON p.mol = a0 JOIN cm q ON q.mol = a1 AND q.run_id = p.run_id AND q.frame = p.frame JOIN c ON c.run_id = p.run_id AND c.frame = p.frame)
        SELECT run_id, frame, tuple_id, a0, a1, round(sqrt({_dot('d', 'd')}), 5) + 0.0 AS dist FROM l WHERE sqrt({_dot('d', 'd')}) <= {COM_LIMIT}""",
    "dimers_angle": f"WITH {SQL_BASE}, {_hb} SELECT run_id, frame, tuple_id, a0, a1, a2, round(r_da, 4) + 0.0 AS dist, round(angle, 4) + 0.0 AS angle FROM hb WHERE r_da <= {LIMIT} AND angle >= 90.0",
    "dimers_flexible": f"WITH {SQL_BASE}, {_hb}, {_vdw}, {_cov} SELECT run_id, frame, tuple_id, a0, a1, a2, round(r_da, 4) + 0.0 AS dist, round(angle, 4) + 0.0 AS angle FROM hb JOIN rv v0 ON v0.symb = s0 JOIN rv v2 ON v2.symb = s2 JOIN rc c0 ON c0.symb = s0 JOIN rc c1 ON c1.symb = s1 WHERE r_da <= 3.0 * (v0.r + v2.r) AND angle * r_dh / (1.05 * (c0.r + c1.r)) >= 300.0",
    "survival": f"WITH {SQL_BASE}, {_ct}, {_survival('co', 'a', 'run_id', 'tuple_id', WINDOW, 1, 1)}",
    "survival_sampled": f"WITH {SQL_BASE}, {_ct}, {_survival('co', 'a', 'run_id', 'tuple_id', WINDOW, 3, 2)}",
    "survival_records": f"WITH {_json}, {_survival('co', 'tx', 'stream_id', 'a0, a2', 5, 1, 1)}",
    "dlddf": f"""WITH {SQL_BASE}, {_ct}, cen AS (SELECT run_id, frame, tuple_id, ox + dx / 2 AS x, oy + dy / 2 AS y, oz + dz / 2 AS z FROM l),
        pl AS (SELECT run_id, frame, row_number() OVER (PARTITION BY run_id ORDER BY frame) - 1 AS place, count(*) OVER (PARTITION BY run_id) AS places FROM (SELECT DISTINCT run_id, frame FROM cen)),
        ct AS (SELECT run_id, tuple_id, place, places FROM co JOIN pl USING (run_id, frame)),
        og AS (SELECT x.run_id, x.tuple_id, x.place, t.k FROM ct x CROSS JOIN range(1, {WINDOW}) t(k) LEFT JOIN ct y ON y.run_id = x.run_id AND y.tuple_id = x.tuple_id AND y.place = x.place + t.k WHERE x.place <= x.places - {WINDOW} AND y.place IS NULL),
        de AS (SELECT run_id, tuple_id, place, min(k) AS life FROM og GROUP BY ALL),
        cp AS (SELECT cen.*, place FROM cen JOIN pl USING (run_id, frame)),
        mv AS (SELECT de.run_id, de.life, {_v('d', _moved)} FROM de JOIN cp o ON o.run_id = de.run_id AND o.tuple_id = de.tuple_id AND o.place = de.place JOIN cp z ON z.run_id = de.run_id AND z.tuple_id = de.tuple_id AND z.place = de.place + de.life JOIN cr c ON c.run_id = de.run_id),
        v AS (SELECT life * 10.0 / 1000.0 AS tau, sqrt({_dot('d', 'd')}) AS dr FROM mv)
        SELECT {sql_bin('tau', *TAU)} AS bin_x, {sql_bin('dr', *DR)} AS bin_y, round({TAU[0]} + (bin_x + 0.5) * {(TAU[1] - TAU[0]) / TAU[2]}, 6) AS x, round({DR[0]} + (bin_y + 0.5) * {(DR[1] - DR[0]) / DR[2]}, 6) AS y, count(*) AS count FROM v WHERE tau <= {TAU[1]} AND dr <= {DR[1]} GROUP BY ALL""",
    "bonds": f"WITH {SQL_BASE}, {_bd} SELECT run_id, frame, i, j, round(dist, 6) + 0.0 AS dist FROM bd",
    "molecules": f"WITH RECURSIVE {SQL_BASE}, {_bd}, {_mol} SELECT run_id, frame, mol, formula, members FROM ml JOIN mm USING (run_id, frame, mol)",
    "molecule_formulas": f"WITH RECURSIVE {SQL_BASE}, {_bd}, {_mol} SELECT run_id, formula, count(*) AS n FROM ml GROUP BY ALL",
}

__all__ = ["QUERIES", "SQL"]
