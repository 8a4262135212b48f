"""Queries of selection, geometry and structure over the trajectory tables."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from moltide.functions import geom, lattice
from moltide.functions.elements import MASS
from moltide.operators import distributions as D
from moltide.operators import pairs as P
from moltide.operators import select as S
from moltide.plans.tables import SQL_ATOMS, SQL_BASE, atoms, cells, frames, rounded, sql_bin, sql_cart, sql_diff, sql_frac, sql_mic, table
from moltide.session import shared_dir
from moltide.sources.xyz import extxyz_lines, read_extxyz

KEY = ["run_id", "frame"]
#: Index groups of the queries.
GROUP_A, GROUP_B = [0, 2, 4, 6, 8], [1, 3, 5]
TRIPLES = [(0, 1, 2), (1, 2, 3), (2, 3, 4), (5, 0, 6)]
QUADS = [(0, 1, 2, 3), (2, 3, 4, 5)]
SIXES = [(0, 1, 2, 3, 4, 5)]
DIHEDRAL_GROUPS = ([0, 1], [2, 3], [4], [5, 6])
SITE_NAMES = ["O1", "H12", "N", "Cl3", "C60"]
R_MAX, R_BINS = 6.0, 60


def atoms_by_symbol(spark, d):
    return S.by_symbol(atoms(spark, d), "O", "H").select("row_id", "run_id", "frame", "at_idx", "symb")


def atoms_by_index(spark, d):
    return S.by_index(atoms(spark, d), -2).select("row_id", "run_id", "frame", "at_idx")


def atoms_take_order(spark, d):
    return S.take(atoms(spark, d), [4, 0, 4, 2]).select("row_id", "run_id", "frame", "at_idx", "source_at_idx")


def atoms_slice(spark, d):
    return S.at_slice(atoms(spark, d), 1, 9, 3).select("row_id", "run_id", "frame", "at_idx")


def atoms_inverse(spark, d):
    return S.at_sel(atoms(spark, d), F.col("symb").isin("O", "H"), inverse=True).select("row_id", "run_id", "frame", "at_idx", "symb")


def frames_slice_stride(spark, d):
    return S.frame_slice(atoms(spark, d), 10, None, 5).select("row_id", "run_id", "frame", "source_frame", "at_idx")


def runs(spark, d):
    return S.run_lengths(frames(spark, d))


def frac_coords(spark, d):
    return rounded(S.fractions(atoms(spark, d), cells(spark, d)).select("row_id", "sx", "sy", "sz"))


def cart_roundtrip(spark, d):
    c = cells(spark, d)
    f = S.with_cell(S.fractions(atoms(spark, d), c), c)
    r = geom.to_cart((F.col("sx"), F.col("sy"), F.col("sz")))
    return rounded(f.select("row_id", *[c.alias(n) for c, n in zip(r, "xyz", strict=True)]))


def frac_coords_columns(spark, d):
    return rounded(S.fractions(atoms(spark, d), cells(spark, d), "columns").select("row_id", "sx", "sy", "sz"))


def wrap_box(spark, d):
    return rounded(S.wrap(atoms(spark, d), cells(spark, d)).select("row_id", "x", "y", "z"), 7)


def wrap_pretty(spark, d):
    return rounded(S.translate_pretty(S.fractions(atoms(spark, d), cells(spark, d))).select("row_id", "sx", "sy", "sz"))


def cell_volume(spark, d):
    """The volume of each frame that has atoms, by its own cell."""
    return rounded(cells(spark, d).on(atoms(spark, d).select(*KEY).distinct(), "vol"))


def pairs_combinations(spark, d):
    t = P.tuples(spark, P.make_comb(GROUP_A, GROUP_A))
    return P.positions(atoms(spark, d), t).groupBy("run_id", "a0", "a1").agg(F.count("*").alias("n"))


def pairs_zip(spark, d):
    t = P.tuples(spark, P.make_comb(GROUP_A, GROUP_B))
    return P.positions(atoms(spark, d), t).groupBy("run_id", "a0", "a1").agg(F.count("*").alias("n"))


def pairs_product(spark, d):
    t = P.tuples(spark, P.dimer_pairs(GROUP_A, [*GROUP_B, 0]))
    return P.positions(atoms(spark, d), t).groupBy("run_id", "a0", "a1").agg(F.count("*").alias("n"))


def _distances(spark, d):
    t = P.tuples(spark, P.make_comb(GROUP_A, GROUP_A))
    v = P.vectors(P.positions(atoms(spark, d), t), cells(spark, d))
    return v.select(*KEY, "tuple_id", "dx", "dy", "dz", geom.norm(geom.v("d")).alias("dist"))


def pair_distances_mic(spark, d):
    return rounded(_distances(spark, d).select(*KEY, "tuple_id", "dist"))


def pair_vectors_unit(spark, d):
    v = _distances(spark, d)
    return rounded(v.select(*KEY, "tuple_id", *[c.alias(n) for c, n in zip(geom.unit(geom.v("d")), ("ux", "uy", "uz"), strict=True)]))


def distance_cutoff(spark, d):
    a = atoms(spark, d)
    return rounded(P.neighbours(a, a, cells(spark, d), 4.0, True))


def bond_angles(spark, d):
    return rounded(D.tuple_angles(atoms(spark, d), cells(spark, d), P.tuples(spark, TRIPLES)), 4)


def dihedrals4(spark, d):
    return rounded(D.tuple_dihedrals(atoms(spark, d), cells(spark, d), P.tuples(spark, QUADS)), 4)


def dihedrals6(spark, d):
    return rounded(D.tuple_dihedrals(atoms(spark, d), cells(spark, d), P.tuples(spark, SIXES)), 4)


def dihedrals_signed(spark, d):
    return rounded(D.tuple_dihedrals(atoms(spark, d), cells(spark, d), P.tuples(spark, QUADS), signed=True), 4)


def com_by_frame(spark, d):
    return rounded(S.center_of_mass(atoms(spark, d)), 5)


def calib_drift(spark, d):
    return rounded(S.calib(atoms(spark, d)).select("row_id", "x", "y", "z"), 5)


def rdf(spark, d):
    a = atoms(spark, d)
    return rounded(D.rdf(S.by_symbol(a, "O"), S.by_symbol(a, "H"), cells(spark, d), False, R_BINS, R_MAX))


def rdf_same(spark, d):
    a = S.by_symbol(atoms(spark, d), "O")
    return rounded(D.rdf(a, a, cells(spark, d), True, R_BINS, R_MAX))


def coordination_number(spark, d):
    a = atoms(spark, d)
    o, h = S.by_symbol(a, "O"), S.by_symbol(a, "H")
    return rounded(D.coordination(D.rdf(o, h, cells(spark, d), False, R_BINS, R_MAX), o, h, False))


def adf(spark, d):
    return rounded(D.adf(atoms(spark, d), cells(spark, d), P.tuples(spark, P.product([0, 1], [2, 3], [4, 5])), 36))


def ddf(spark, d):
    return rounded(D.ddf(atoms(spark, d), cells(spark, d), P.tuples(spark, QUADS), 36))


def sdf(spark, d):
    return rounded(D.sdf(frames(spark, d), F.col("temperature_k"), 20))


def sdf_summary(spark, d):
    return rounded(D.sdf_summary(D.sdf(frames(spark, d), F.col("temperature_k"), 20)))


def cdf(spark, d):
    a, c = atoms(spark, d), cells(spark, d)
    ang = D.tuple_angles(a, c, P.tuples(spark, TRIPLES))
    dist = P.vectors(P.positions(a, P.tuples(spark, [t[:2] for t in TRIPLES])), c).select(*KEY, "tuple_id", geom.norm(geom.v("d")).alias("dist"))
    return rounded(D.cdf(dist, ang, "dist", "angle", (0.0, 20.0, 20), (0.0, 180.0, 18)))


def atom_table(spark, d):
    """Atom records with their element's number and mass."""
    e = table(spark, d, "elements").select("symb", "atomic_no", "mass")
    return atoms(spark, d).join(F.broadcast(e), "symb").groupBy("run_id", "symb", "atomic_no").agg(F.count("*").alias("n"), F.round(F.sum("mass"), 3).alias("mass"))


def xyz_export(spark, d):
    """The lines of the extended XYZ form of every record."""
    a = S.cleaned(table(spark, d, "atoms"), signed=True).where(F.col("symb").isNotNull())
    e = F.when(F.abs("energy") < S.HIGHEST, F.col("energy")).alias("energy")
    f = table(spark, d, "frames").where(F.col("run_id").isNotNull() & F.col("frame").isNotNull()).select("frame_id", "run_id", "frame", "t_fs", e, "lattice")
    return extxyz_lines(a, S.distinct_signed(f, "t_fs", "energy", "lattice")).select("run_id", "frame", F.col("line").cast("int").alias("line"), "value")


def pairs_scalar_list(spark, d):
    """One atom with each of a list."""
    t = P.tuples(spark, P.make_comb(0, GROUP_B))
    return P.positions(atoms(spark, d), t).groupBy("run_id", "a0", "a1").agg(F.count("*").alias("n"))


def pairs_scalars(spark, d):
    t = P.tuples(spark, P.make_comb(2, 5))
    return P.positions(atoms(spark, d), t).groupBy("run_id", "a0", "a1").agg(F.count("*").alias("n"))


def pairs_sublists(spark, d):
    """Lists of lists, sublist by sublist."""
    t = P.tuples(spark, P.make_comb([[0, 1], [4]], [[2, 3], [5, 6]]))
    return P.positions(atoms(spark, d), t).groupBy("run_id", "a0", "a1").agg(F.count("*").alias("n"))


def hbond_triples(spark, d):
    """Triples of donors with their hydrogens and acceptors."""
    t = P.tuples(spark, P.hbond_triples([(0, [1, 2]), (3, [4])], [0, 3, 5]))
    return P.positions(atoms(spark, d), t).groupBy("run_id", "a0", "a1", "a2").agg(F.count("*").alias("n"))


def dihedral_groups(spark, d):
    """Dihedral distribution over the product of four groups."""
    return rounded(D.ddf(atoms(spark, d), cells(spark, d), P.tuples(spark, P.product(*DIHEDRAL_GROUPS)), 36))


def site_elements(spark, d):
    """The elements of site names with their masses."""
    return spark.createDataFrame([(s, lattice.element_of(s), MASS[lattice.element_of(s)]) for s in SITE_NAMES], "site string, symb string, mass double")


def miller_vectors(spark, d):
    """The direction (1, 2, -1) of each run's first cell as a unit vector, and back as fractions over the greatest one."""
    c = cells(spark, d).run
    r = geom.to_cart((F.lit(1.0), F.lit(2.0), F.lit(-1.0)))
    u = geom.with_images(c, {"u": geom.unit(r)}, periodic=False)
    s = geom.with_images(u, {"s": geom.to_frac(geom.v("u"))}, periodic=False)
    top = F.greatest(*[F.abs(f"s{k}") for k in "xyz"])
    return rounded(s.select("run_id", "ux", "uy", "uz", *[(2 * F.col(f"s{k}") / top).alias(f"m{k}") for k in "xyz"]))


def xyz_files(spark, d):
    """All records written as one extended XYZ file per run and read again: dense frames and atoms."""
    a = atoms(spark, d).where(F.col("symb").isNotNull())
    a = a.withColumn("at_idx", F.row_number().over(Window.partitionBy(*KEY).orderBy("at_idx", "row_id")) - 1)
    path = f"{shared_dir(spark)}/xyz-{uuid.uuid4().hex}"
    lines = extxyz_lines(a, frames(spark, d).withColumn("energy", F.lit(None).cast("double")))
    lines.repartition("run_id").sortWithinPartitions("run_id", "frame", "line").select("run_id", "value").write.partitionBy("run_id").text(path)
    back, _ = read_extxyz(spark, path)
    return rounded(back.select(F.regexp_extract("run_id", r"run_id=([^/]+)/", 1).alias("run_id"), "frame", "at_idx", "symb", "x", "y", "z"))


QUERIES = {
    f.__name__: f
    for f in (
        atoms_by_symbol, atoms_by_index, atoms_take_order, atoms_slice, atoms_inverse, frames_slice_stride, runs, frac_coords, cart_roundtrip, frac_coords_columns, wrap_box, wrap_pretty, cell_volume,
        pairs_combinations, pairs_zip, pairs_product, pair_distances_mic, pair_vectors_unit, distance_cutoff, bond_angles, dihedrals4, dihedrals6, dihedrals_signed,
        com_by_frame, calib_drift, rdf, rdf_same, coordination_number, adf, ddf, sdf, sdf_summary, cdf, atom_table, xyz_export, xyz_files, pairs_scalar_list, pairs_scalars, pairs_sublists, hbond_triples, dihedral_groups, site_elements, miller_vectors,
    )
}


# ---- SQL ----
def _rel(rows) -> str:
    n = len(rows[0])
    return "(VALUES " + ", ".join("(" + ", ".join(map(str, (i, *r))) + ")" for i, r in enumerate(rows)) + ") t(tuple_id, " + ", ".join(f"a{k}" for k in range(n)) + ")"


def placed(rows) -> str:
    """FROM clause with the members p0, p1, .. of each tuple in each frame and the cell c."""
    n = len(rows[0])
    text = f"{_rel(rows)} JOIN a p0 ON p0.at_idx = t.a0"
    for k in range(1, n):
        text += f" JOIN a p{k} ON p{k}.at_idx = t.a{k} AND p{k}.run_id = p0.run_id AND p{k}.frame = p0.frame"
    return text + " JOIN c ON c.run_id = p0.run_id AND c.frame = p0.frame"


def _v(name: str, expr) -> str:
    return ", ".join(f"{e} AS {name}{k}" for e, k in zip(expr, "xyz", strict=True))


def _dot(a: str, b: str) -> str:
    return f"({a}x * {b}x + {a}y * {b}y + {a}z * {b}z)"


def _cross(a: str, b: str) -> list[str]:
    return [f"({a}y * {b}z - {a}z * {b}y)", f"({a}z * {b}x - {a}x * {b}z)", f"({a}x * {b}y - {a}y * {b}x)"]


def _ang(a: str, b: str, otherwise: str = "90.0") -> str:
    n = f"(sqrt({_dot(a, a)}) * sqrt({_dot(b, b)}))"
    return f"CASE WHEN {n} > 1e-12 THEN degrees(acos(greatest(least({_dot(a, b)} / nullif({n}, 0), 1.0), -1.0))) ELSE {otherwise} END"


def _pairs_sql(rows) -> str:
    return f"WITH {SQL_ATOMS} SELECT p0.run_id, a0, a1, count(*) AS n FROM {_rel(rows)} JOIN a p0 ON p0.at_idx = a0 JOIN a p1 ON p1.at_idx = a1 AND p1.run_id = p0.run_id AND p1.frame = p0.frame GROUP BY ALL"


def angles_cte(rows, name: str = "ang") -> str:
    return f"""l AS (SELECT p0.run_id, p0.frame, tuple_id, {_v('u', sql_mic(sql_diff('p1', 'p0')))}, {_v('w', sql_mic(sql_diff('p1', 'p2')))} FROM {placed(rows)}),
        {name} AS (SELECT run_id, frame, tuple_id, {_ang('u', 'w')} AS angle FROM l)"""


def dihedral_cte(rows, signed: bool = False) -> str:
    n = len(rows[0])
    steps = [(0, 1), (1, 2), (2, 3)] if n == 4 else [(0, 1), (1, 2), (3, 4), (4, 5)]
    base = f"l AS (SELECT p0.run_id, p0.frame, tuple_id, {', '.join(_v(f's{k}', sql_mic(sql_diff(f'p{i}', f'p{j}'))) for k, (i, j) in enumerate(steps))} FROM {placed(rows)})"
    second = _cross("s1", "s2") if n == 4 else _cross("s2", "s3")
    planes = f"n AS (SELECT *, {_v('m', _cross('s0', 's1'))}, {_v('o', second)} FROM l)"
    if not signed:
        return f"{base}, {planes}, dih AS (SELECT run_id, frame, tuple_id, {_ang('m', 'o')} AS dihedral FROM n)"
    ax = f"x AS (SELECT *, {', '.join(f's1{k} / sqrt({_dot('s1', 's1')}) AS e{k}' for k in 'xyz')} FROM n), q AS (SELECT *, {_v('r', _cross('m', 'e'))} FROM x)"
    return f"{base}, {planes}, {ax}, dih AS (SELECT run_id, frame, tuple_id, CASE WHEN sqrt({_dot('m', 'm')}) * sqrt({_dot('o', 'o')}) > 1e-12 THEN degrees(atan2(-{_dot('r', 'o')}, {_dot('m', 'o')})) ELSE 90.0 END AS dihedral FROM q)"


_pair_rows = P.make_comb(GROUP_A, GROUP_A)
_dist = f"l AS (SELECT p0.run_id, p0.frame, tuple_id, {_v('d', sql_mic(sql_diff('p0', 'p1')))} FROM {placed(_pair_rows)})"
_masses = "e(symb, mass) AS (VALUES " + ", ".join(f"('{s}', CAST({m} AS DOUBLE))" for s, m in MASS.items()) + ")"
_com = f"{_masses}, com AS (SELECT run_id, frame, {', '.join(f'sum(mass * {k}) / sum(mass) AS c{k}' for k in 'xyz')} FROM a JOIN e USING (symb) GROUP BY run_id, frame)"
_wrapped = [f"(({s}) + 1e-7 - floor(({s}) + 1e-7) - 1e-7)" for s in sql_frac(("a.x", "a.y", "a.z"))]


def _near(i: str, j: str, join: str, limit: float) -> str:
    d = sql_mic(sql_diff("p", "q"))
    return f"near AS (SELECT p.run_id, p.frame, p.at_idx AS i, q.at_idx AS j, sqrt({' + '.join(f'{e} * {e}' for e in d)}) AS dist FROM {i} p JOIN {j} q ON p.run_id = q.run_id AND p.frame = q.frame AND {join} JOIN c ON c.run_id = p.run_id AND c.frame = p.frame WHERE sqrt({' + '.join(f'{e} * {e}' for e in d)}) <= {limit})"


def _grid(source: str, value: str, lo: float, hi: float, n: int) -> str:
    """Counts of every bin of every run that has rows."""
    return f"""k AS (SELECT run_id, {sql_bin(value, lo, hi, n)} AS bin, count(*) AS count FROM {source} WHERE {value} >= {lo} AND {value} <= {hi} GROUP BY ALL),
        hist AS (SELECT r.run_id, CAST(b.bin AS INTEGER) AS bin, coalesce(k.count, 0) AS count FROM (SELECT DISTINCT run_id FROM {source}) r CROSS JOIN range({n}) b(bin) LEFT JOIN k ON k.run_id = r.run_id AND k.bin = b.bin)"""


_w = R_MAX / R_BINS
_shell = f"({4.0 / 3.0 * math.pi} * (pow((bin + 1) * {_w}, 3) - pow(bin * {_w}, 3)))"
_oh = f"o AS (SELECT * FROM a WHERE symb = 'O'), hy AS (SELECT * FROM a WHERE symb = 'H'), {_near('o', 'hy', 'p.at_idx <> q.at_idx', R_MAX)}, {_grid('near', 'dist', 0.0, R_MAX, R_BINS)}"
_oo = f"o AS (SELECT * FROM a WHERE symb = 'O'), {_near('o', 'o', 'p.at_idx < q.at_idx', R_MAX)}, {_grid('near', 'dist', 0.0, R_MAX, R_BINS)}"

SQL = {
    "atoms_by_symbol": f"WITH {SQL_ATOMS} SELECT row_id, run_id, frame, at_idx, symb FROM a WHERE symb IN ('O', 'H')",
    "atoms_by_index": f"WITH {SQL_ATOMS}, b AS (SELECT *, max(at_idx) OVER (PARTITION BY run_id, frame) AS last FROM a) SELECT row_id, run_id, frame, at_idx FROM b WHERE at_idx = last - 1",
    "atoms_take_order": f"WITH {SQL_ATOMS}, g(at_idx, pos) AS (VALUES (4, 0), (0, 1), (4, 2), (2, 3)) SELECT row_id, run_id, frame, pos AS at_idx, a.at_idx AS source_at_idx FROM a JOIN g USING (at_idx)",
    "atoms_slice": f"WITH {SQL_ATOMS} SELECT row_id, run_id, frame, at_idx FROM a WHERE at_idx IN (1, 4, 7)",
    "atoms_inverse": f"WITH {SQL_ATOMS} SELECT row_id, run_id, frame, at_idx, symb FROM a WHERE symb IS NULL OR symb NOT IN ('O', 'H')",
    "frames_slice_stride": f"WITH {SQL_ATOMS} SELECT row_id, run_id, CAST((frame - 10) / 5 AS INTEGER) AS frame, frame AS source_frame, at_idx FROM a WHERE frame >= 10 AND (frame - 10) % 5 = 0",
    "runs": """WITH f AS (SELECT DISTINCT frame_id, run_id, frame, lattice FROM frames WHERE run_id IS NOT NULL AND frame IS NOT NULL),
        g AS (SELECT run_id, count(*) AS nframes, min(frame) AS first_frame, max(frame) AS last_frame, arg_min(lattice, frame) AS p, arg_max(lattice, frame) AS q FROM f GROUP BY run_id)
        SELECT run_id, nframes, first_frame, last_frame, coalesce(len(list_filter(range(1, 10), lambda i: abs(p[i] - q[i]) > 1e-5 + 1e-5 * abs(q[i]))) > 0, FALSE) AS is_npt FROM g""",
    "frac_coords": f"WITH {SQL_BASE} SELECT row_id, {', '.join(f'round({s}, 6) + 0.0 AS s{k}' for s, k in zip(sql_frac(('a.x', 'a.y', 'a.z')), 'xyz', strict=True))} FROM a JOIN c USING (run_id, frame)",
    "cart_roundtrip": f"WITH {SQL_ATOMS} SELECT row_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM a WHERE run_id IN (SELECT run_id FROM frames WHERE len(lattice) = 9)",
    "frac_coords_columns": f"WITH {SQL_BASE} SELECT row_id, {', '.join(f'round(a.x * c.g{j}1 + a.y * c.g{j}2 + a.z * c.g{j}3, 6) + 0.0 AS s{k}' for j, k in zip((1, 2, 3), 'xyz', strict=True))} FROM a JOIN c USING (run_id, frame)",
    "wrap_box": f"WITH {SQL_BASE} SELECT row_id, {', '.join(f'round({e}, 7) + 0.0 AS {k}' for e, k in zip(sql_cart(_wrapped), 'xyz', strict=True))} FROM a JOIN c USING (run_id, frame)",
    "wrap_pretty": f"""WITH {SQL_BASE}, s AS (SELECT row_id, run_id, frame, {', '.join(f'{s} AS s{k}' for s, k in zip(sql_frac(('a.x', 'a.y', 'a.z')), 'xyz', strict=True))} FROM a JOIN c USING (run_id, frame)),
        """ + ", ".join(f"""g{k} AS (SELECT run_id, frame, s{k}, coalesce(lag(s{k}) OVER w, max(s{k}) OVER (PARTITION BY run_id, frame)) - s{k} AS raw FROM s WINDOW w AS (PARTITION BY run_id, frame ORDER BY s{k})),
        m{k} AS (SELECT run_id, frame, arg_min(s{k}, (raw - floor(raw), s{k})) AS f{k} FROM g{k} GROUP BY run_id, frame)""" for k in "xyz") + f"""
        SELECT row_id, {', '.join(f'round(s{k} - f{k} - floor(s{k} - f{k}), 6) + 0.0 AS s{k}' for k in 'xyz')} FROM s JOIN mx USING (run_id, frame) JOIN my USING (run_id, frame) JOIN mz USING (run_id, frame)""",
    "cell_volume": f"WITH {SQL_BASE} SELECT run_id, frame, round(vol, 6) + 0.0 AS vol FROM c",
    "pairs_combinations": _pairs_sql(_pair_rows),
    "pairs_zip": _pairs_sql([(0, 1), (2, 3), (4, 5)]),
    "pairs_product": _pairs_sql([(0, 1), (0, 3), (0, 5), (2, 1), (2, 3), (2, 5), (2, 0), (4, 1), (4, 3), (4, 5), (4, 0), (6, 1), (6, 3), (6, 5), (6, 0), (8, 1), (8, 3), (8, 5), (8, 0)]),
    "pair_distances_mic": f"WITH {SQL_BASE}, {_dist} SELECT run_id, frame, tuple_id, round(sqrt({_dot('d', 'd')}), 6) + 0.0 AS dist FROM l",
    "pair_vectors_unit": f"WITH {SQL_BASE}, {_dist} SELECT run_id, frame, tuple_id, {', '.join(f'CASE WHEN sqrt({_dot('d', 'd')}) > 1e-12 THEN round(d{k} / sqrt({_dot('d', 'd')}), 6) + 0.0 ELSE 0.0 END AS u{k}' for k in 'xyz')} FROM l",
    "distance_cutoff": f"WITH {SQL_BASE}, {_near('a', 'a', 'p.at_idx < q.at_idx', 4.0)} SELECT run_id, frame, i, j, round(dist, 6) + 0.0 AS dist FROM near",
    "bond_angles": f"WITH {SQL_BASE}, {angles_cte(TRIPLES)} SELECT run_id, frame, tuple_id, round(angle, 4) + 0.0 AS angle FROM ang",
    "dihedrals4": f"WITH {SQL_BASE}, {dihedral_cte(QUADS)} SELECT run_id, frame, tuple_id, round(dihedral, 4) + 0.0 AS dihedral FROM dih",
    "dihedrals6": f"WITH {SQL_BASE}, {dihedral_cte(SIXES)} SELECT run_id, frame, tuple_id, round(dihedral, 4) + 0.0 AS dihedral FROM dih",
    "dihedrals_signed": f"WITH {SQL_BASE}, {dihedral_cte(QUADS, True)} SELECT run_id, frame, tuple_id, round(dihedral, 4) + 0.0 AS dihedral FROM dih",
    "com_by_frame": f"WITH {SQL_ATOMS}, {_com} SELECT run_id, frame, {', '.join(f'round(c{k}, 5) + 0.0 AS c{k}' for k in 'xyz')} FROM com",
    "calib_drift": f"WITH {SQL_ATOMS}, {_com}, f AS (SELECT run_id, {', '.join(f'arg_min(c{k}, frame) AS f{k}' for k in 'xyz')} FROM com GROUP BY run_id) SELECT row_id, {', '.join(f'round({k} + (f{k} - c{k}), 5) + 0.0 AS {k}' for k in 'xyz')} FROM a JOIN com USING (run_id, frame) JOIN f USING (run_id)",
    "rdf": f"""WITH {SQL_BASE}, {_oh}, n AS (SELECT run_id, sum(na * nb / vol) AS dens FROM (SELECT run_id, frame, count(*) AS na FROM o GROUP BY ALL) JOIN (SELECT run_id, frame, count(*) AS nb FROM hy GROUP BY ALL) USING (run_id, frame) JOIN c USING (run_id, frame) GROUP BY run_id)
        SELECT run_id, bin, round((bin + 0.5) * {_w}, 6) + 0.0 AS r, count, round(count / (dens * {_shell}), 6) + 0.0 AS g FROM hist JOIN n USING (run_id)""",
    "rdf_same": f"""WITH {SQL_BASE}, {_oo}, n AS (SELECT run_id, sum(na * (na - 1) / 2 / vol) AS dens FROM (SELECT run_id, frame, count(*) AS na FROM o GROUP BY ALL) JOIN c USING (run_id, frame) GROUP BY run_id)
        SELECT run_id, bin, round((bin + 0.5) * {_w}, 6) + 0.0 AS r, count, round(count / (dens * {_shell}), 6) + 0.0 AS g FROM hist JOIN n USING (run_id)""",
    "coordination_number": f"WITH {SQL_BASE}, {_oh}, n AS (SELECT run_id, count(*) AS na FROM o GROUP BY run_id) SELECT run_id, bin, round((bin + 0.5) * {_w}, 6) + 0.0 AS r, round(sum(count) OVER (PARTITION BY run_id ORDER BY bin) / na, 6) + 0.0 AS n FROM hist JOIN n USING (run_id)",
    "adf": f"""WITH {SQL_BASE}, {angles_cte(P.product([0, 1], [2, 3], [4, 5]))}, {_grid('ang', 'angle', 0.0, 180.0, 36)}, n AS (SELECT run_id, count(*) AS n FROM ang GROUP BY run_id)
        SELECT run_id, bin, (bin + 0.5) * 5.0 AS x, count, round(count / (n * greatest(sin(radians((bin + 0.5) * 5.0)), 1e-10)), 6) + 0.0 AS value FROM hist JOIN n USING (run_id)""",
    "ddf": f"""WITH {SQL_BASE}, {dihedral_cte(QUADS).replace("n AS (", "pl AS (").replace("FROM n)", "FROM pl)")}, {_grid('dih', 'dihedral', 0.0, 180.0, 36)}, n AS (SELECT run_id, count(*) AS n FROM dih GROUP BY run_id)
        SELECT run_id, bin, (bin + 0.5) * 5.0 AS x, count, round(count / n, 6) + 0.0 AS value FROM hist JOIN n USING (run_id)""",
    "cdf": f"""WITH {SQL_BASE}, {angles_cte(TRIPLES)}, ds AS (SELECT p0.run_id, p0.frame, tuple_id, {_v('d', sql_mic(sql_diff('p0', 'p1')))} FROM {placed([t[:2] for t in TRIPLES])}),
        j AS (SELECT sqrt({_dot('d', 'd')}) AS dist, angle FROM ds JOIN ang USING (run_id, frame, tuple_id))
        SELECT {sql_bin('dist', 0.0, 20.0, 20)} AS bin_x, {sql_bin('angle', 0.0, 180.0, 18)} AS bin_y, bin_x + 0.5 AS x, (bin_y + 0.5) * 10.0 AS y, count(*) AS count FROM j WHERE dist <= 20.0 AND angle BETWEEN 0 AND 180 GROUP BY ALL""",
    "atom_table": f"WITH {SQL_ATOMS} SELECT run_id, symb, atomic_no, count(*) AS n, round(sum(mass), 3) AS mass FROM a JOIN elements USING (symb) GROUP BY ALL",
}
SQL["xyz_export"] = f"""WITH {SQL_ATOMS}, s AS (SELECT * FROM a WHERE symb IS NOT NULL), n AS (SELECT run_id, frame, count(*) AS n FROM s GROUP BY ALL),
    f AS (SELECT DISTINCT frame_id, run_id, frame, t_fs, CASE WHEN abs(energy) < {S.HIGHEST} THEN energy END AS e, lattice FROM frames WHERE run_id IS NOT NULL AND frame IS NOT NULL)
    SELECT run_id, frame, CAST(at_idx + 2 AS INTEGER) AS line, rpad(symb, 3, ' ') || printf('%18.8f', x) || printf('%18.8f', y) || printf('%18.8f', z) AS value FROM s
    UNION ALL SELECT run_id, frame, 0, CAST(n AS VARCHAR) FROM f JOIN n USING (run_id, frame)
    UNION ALL SELECT run_id, frame, 1, coalesce('Lattice="' || array_to_string([printf('%.8f', v) for v in lattice], ' ') || '" ', '') || 'Properties=species:S:1:pos:R:3 frame=' || frame || coalesce(' time=' || printf('%.3f', t_fs), '') || coalesce(' energy=' || printf('%.8f', e), '') FROM f JOIN n USING (run_id, frame)"""
SQL |= {
    "xyz_files": f"""WITH {SQL_ATOMS}, f AS (SELECT DISTINCT run_id, frame FROM frames WHERE run_id IS NOT NULL AND frame IS NOT NULL), s AS (SELECT a.* FROM a JOIN f USING (run_id, frame) WHERE symb IS NOT NULL)
        SELECT run_id, CAST(dense_rank() OVER (PARTITION BY run_id ORDER BY frame) - 1 AS INTEGER) AS frame, CAST(row_number() OVER (PARTITION BY run_id, frame ORDER BY at_idx, row_id) - 1 AS INTEGER) AS at_idx, symb, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM s""",
    "pairs_scalar_list": _pairs_sql([(0, 1), (0, 3), (0, 5)]),
    "pairs_scalars": _pairs_sql([(2, 5)]),
    "pairs_sublists": _pairs_sql([(0, 2), (1, 3), (4, 5)]),
    "hbond_triples": f"WITH {SQL_ATOMS} SELECT p0.run_id, a0, a1, a2, count(*) AS n FROM {_rel([(0, 1, 3), (0, 1, 5), (0, 2, 3), (0, 2, 5), (3, 4, 0), (3, 4, 5)])} JOIN a p0 ON p0.at_idx = a0 JOIN a p1 ON p1.at_idx = a1 AND p1.run_id = p0.run_id AND p1.frame = p0.frame JOIN a p2 ON p2.at_idx = a2 AND p2.run_id = p0.run_id AND p2.frame = p0.frame GROUP BY ALL",
    "dihedral_groups": SQL["ddf"].replace(_rel(QUADS), _rel([(i, j, 4, k) for i in (0, 1) for j in (2, 3) for k in (5, 6)])),
    "site_elements": "SELECT site, regexp_replace(site, '[0-9]', '', 'g') AS symb, mass FROM (VALUES ('O1', 15.9994), ('H12', 1.00794), ('N', 14.0067), ('Cl3', 35.453), ('C60', 12.0107)) t(site, mass)",
    "miller_vectors": f"""WITH {SQL_BASE}, v AS (SELECT run_id, {', '.join(f'h1{j} + 2 * h2{j} - h3{j} AS v{j}' for j in (1, 2, 3))} FROM cr), n AS (SELECT *, sqrt(v1 * v1 + v2 * v2 + v3 * v3) AS l FROM v)
        SELECT run_id, round(v1 / l, 6) + 0.0 AS ux, round(v2 / l, 6) + 0.0 AS uy, round(v3 / l, 6) + 0.0 AS uz, 1.0 AS mx, 2.0 AS my, -1.0 AS mz FROM n""",
}
_f = "f AS (SELECT DISTINCT frame_id, temperature_k AS v FROM frames WHERE run_id IS NOT NULL AND frame IS NOT NULL AND temperature_k IS NOT NULL AND NOT isnan(temperature_k)), s AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n FROM f)"
_sdf = f"""{_f}, k AS (SELECT CAST(least(floor((v - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) AS count FROM f, s GROUP BY ALL),
        g AS (SELECT CAST(b.bin AS INTEGER) AS bin, lo + (b.bin + 0.5) * ((hi - lo) / 20) AS x, coalesce(count, 0) AS count, coalesce(count, 0) / (n * ((hi - lo) / 20)) AS value FROM range(20) b(bin) CROSS JOIN s LEFT JOIN k ON k.bin = b.bin)"""
SQL["sdf"] = f"WITH {_sdf} SELECT bin, round(x, 6) + 0.0 AS x, count, round(value, 6) + 0.0 AS value FROM g"
SQL["sdf_summary"] = f"WITH {_sdf} SELECT round(arg_max(x, (value, -bin)), 6) + 0.0 AS peak_x, round(sum(x * value) / sum(value), 6) + 0.0 AS mean_x FROM g"

__all__ = ["QUERIES", "SQL", "angles_cte", "placed"]
