"""Periodic geometry, selection, histograms and distributions on tiny frames."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moltide.functions import elements as EL
from moltide.functions import fits, geom, lattice
from moltide.operators import contacts as K
from moltide.operators import correlation as C
from moltide.operators import distributions as D
from moltide.operators import hist, lifetime, molecules
from moltide.operators import pairs as P
from moltide.operators import select as S

ATOMS = "row_id long, run_id string, frame int, at_idx int, symb string, x double, y double, z double"
BOX = [10.0, 0, 0, 0, 10.0, 0, 0, 0, 10.0]
SKEW = [10.0, 0, 0, 4.0, 9.0, 0, -3.0, 2.0, 8.0]


def atoms(spark, frames, symbols="HHHHHHHH"):
    rows = [(i * 100 + k, "r", i, k, symbols[k], *map(float, p)) for i, f in enumerate(frames) for k, p in enumerate(f)]
    return spark.createDataFrame(rows, ATOMS)


def cells(spark, m):
    return geom.cells(spark.createDataFrame([("r", 0, [float(v) for v in m])], "run_id string, frame int, lattice array<double>"))


def nearest(d, m, columns=False):
    h = np.array(m, float).reshape(3, 3)
    h = h.T if columns else h
    s = np.asarray(d, float) @ np.linalg.inv(h)
    return np.asarray(d) - np.rint(s) @ h


@pytest.mark.parametrize("m", [BOX, SKEW])
def test_nearest_image_and_half_way_rounding(spark, m):
    p = [[0, 0, 0], [4.9, 0, 0], [5.0, 0, 0], [5.1, 0, 0], [9, 8, -7]]
    a = atoms(spark, [p])
    t = P.tuples(spark, P.make_comb([0, 1, 2, 3, 4], [0, 1, 2, 3, 4]))
    v = P.vectors(P.positions(a, t), cells(spark, m)).collect()
    assert len(v) == 10
    for r in v:
        want = nearest(np.subtract(p[r["a1"]], p[r["a0"]]), m)
        assert np.allclose([r["dx"], r["dy"], r["dz"]], want)
    one = a.where("at_idx = 4").join(cells(spark, m), "run_id")
    for columns in (False, True):
        f = one.select(*[c.alias(n) for c, n in zip(geom.mic(geom.v(""), "columns" if columns else "rows"), "xyz")]).first()
        assert np.allclose(list(f), nearest([9, 8, -7], m, columns))
    exact = one.select(*[c.alias(n) for c, n in zip(geom.mic(geom.v(""), exact=True), "xyz")]).first()
    h = np.array(m).reshape(3, 3)
    best = min(np.linalg.norm(np.array([9, 8, -7]) + np.array(s) @ h) for s in itertools.product(range(-3, 4), repeat=3))
    assert math.isclose(np.linalg.norm(list(exact)), best)


def test_angles_and_degenerate_values(spark):
    p = [[1, 0, 0], [0, 0, 0], [0, 1, 0], [0, 1, 1], [0, 0, 0], [0, 1, -1]]
    a = atoms(spark, [p])
    ang = {r["tuple_id"]: r["angle"] for r in D.tuple_angles(a, None, P.tuples(spark, [(0, 1, 2), (0, 1, 4), (2, 1, 3)])).collect()}
    assert ang[0] == pytest.approx(90) and ang[1] == 90.0 and ang[2] == pytest.approx(45)
    assert math.isnan(D.tuple_angles(a, None, P.tuples(spark, [(0, 1, 4)]), degenerate=float("nan")).first()["angle"])
    t = P.tuples(spark, [(0, 1, 2, 3), (0, 1, 2, 5), (0, 1, 4, 3)])
    plain = {r["tuple_id"]: r["dihedral"] for r in D.tuple_dihedrals(a, None, t).collect()}
    signed = {r["tuple_id"]: r["dihedral"] for r in D.tuple_dihedrals(a, None, t, signed=True, degenerate=0.0).collect()}
    assert plain[0] == pytest.approx(90) and plain[1] == pytest.approx(90) and plain[2] == 90.0
    assert signed[0] == pytest.approx(-signed[1]) and abs(signed[0]) == pytest.approx(90) and signed[2] == 0.0
    six = D.tuple_dihedrals(a, None, P.tuples(spark, [(0, 1, 2, 3, 4, 2)])).first()["dihedral"]
    assert six == pytest.approx(90)


def test_histogram_rule(spark):
    values = [0.0, 0.99, 1.0, 9.999, 10.0, -0.1, 10.1, float("nan"), None]
    d = spark.createDataFrame([(v, "k") for v in values], "v double, k string")
    want = np.histogram([v for v in values if v is not None and v == v], bins=10, range=(0, 10))[0].tolist()
    assert [r["count"] for r in hist.histogram(d, F.col("v"), 0, 10, 10).orderBy("bin").collect()] == want
    assert [r["count"] for r in hist.histogram(d, F.col("v"), 0, 10, 10, "k").orderBy("bin").collect()] == want
    with pytest.raises(ValueError):
        hist.bin_of(F.col("v"), 1, 1, 3)


@pytest.mark.parametrize("m,cut", [(BOX, 2.2), (SKEW, 2.0), (BOX, 4.5)])
def test_cell_list_equals_all_pairs(spark, m, cut):
    rng = np.random.default_rng(3)
    p = rng.uniform(-15, 25, (60, 3))
    a = atoms(spark, [p], "H" * 60)
    got = {(r["i"], r["j"]): r["dist"] for r in P.neighbours(a, a, cells(spark, m), cut, True).collect()}
    want = {(i, j): d for i in range(60) for j in range(i + 1, 60) if (d := np.linalg.norm(nearest(p[j] - p[i], m))) <= cut}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_combinations_and_sites():
    assert P.make_comb(1, 2) == [(1, 2)] and P.make_comb(np.int64(1), [2, 3]) == [(1, 2), (1, 3)]
    assert P.make_comb([1, 2, 3], [1, 2, 3]) == [(1, 2), (1, 3), (2, 3)] and P.make_comb([1, 2], [3, 4, 5]) == [(1, 3), (2, 4)]
    assert P.make_comb([[1, 2], [3]], [[4, 5], [6]]) == [(1, 4), (2, 5), (3, 6)]
    assert P.dimer_pairs([1, 2], [2, 1, 3]) == [(1, 2), (1, 3), (2, 3)]
    assert P.hbond_triples([(0, [1, 2])], [0, 5]) == [(0, 1, 5), (0, 2, 5)]
    donors, acceptors = P.find_d_a([{"O": 14, "H1": 15, "H2": 16}, {"N": 1, "H": 2}, {"F1": 3, "F2": 4}, {"O1": 5, "O2": 6}, {"O": 9}])
    assert donors == [{"O": 14, "H1": 15}, {"O": 14, "H2": 16}, {"N": 1, "H": 2}] and acceptors == [{"O": 14}, {"F1": 3, "F2": 4}, {"O1": 5, "O2": 6}, {"O": 9}]
    rows = P.pair_d_a(donors, acceptors)
    assert ("O", 14, 15, "O", 14) not in rows and ("N", 1, 2, "F", 4) in rows and len(rows) == 3 * 6 - 2


def test_selection_and_frames(spark):
    a = atoms(spark, [[[i, k, 0] for k in range(4)] for i in range(6)], "OHCO")
    assert [r["at_idx"] for r in S.by_index(a, -1).collect()] == [3] * 6
    assert S.at_sel(a, F.col("symb") == "O", inverse=True).count() == 12
    t = S.frame_slice(a, 1, 6, 2).where("at_idx = 0").orderBy("frame").collect()
    assert [(r["frame"], r["source_frame"]) for r in t] == [(0, 1), (1, 3), (2, 5)]
    assert [r["source_frame"] for r in S.frame_list(a, [4, 0]).where("at_idx = 0").orderBy("frame").collect()] == [4, 0]
    dirty = a.union(a).union(spark.createDataFrame([(999, "r", 0, 9, None, 1.0, float("nan"), 1.0), (998, None, 0, 0, "H", 1.0, 1.0, 1.0), (997, "r", 0, 8, "H", None, 1.0, 1.0)], ATOMS))
    assert S.cleaned(dirty).count() == 24 and S.cleaned(dirty.limit(0)).count() == 0


def test_wrap_is_idempotent_and_drift_goes(spark):
    rng = np.random.default_rng(1)
    a = atoms(spark, [rng.uniform(-30, 30, (5, 3)) for _ in range(4)], "OHCNF")
    c = cells(spark, SKEW)
    w = S.wrap(a, c)
    f = [list(r) for r in S.fractions(w, c).select("sx", "sy", "sz").collect()]
    assert np.min(f) >= -2e-7 and np.max(f) < 1.0
    again = sorted(map(tuple, S.wrap(w, c).select("row_id", "x", "y", "z").collect()))
    assert np.allclose(again, sorted(map(tuple, w.select("row_id", "x", "y", "z").collect())))
    com = S.center_of_mass(S.calib(a)).orderBy("frame").select("cx", "cy", "cz").collect()
    assert np.allclose([list(r) for r in com], list(com[0]))
    s = S.translate_pretty(S.fractions(w, c)).where("frame = 0").select("sx").collect()
    x = sorted(r["sx"] for r in s)
    assert x[0] == 0.0 and 1 - x[-1] >= max(np.diff(x))


def test_fft_equals_direct_sum(spark):
    rng = np.random.default_rng(2)
    r = np.cumsum(rng.normal(0, 1, (64, 3)), axis=0)
    want = [np.mean(((r[k:] - r[: len(r) - k]) ** 2).sum(1)) for k in range(64)]
    assert np.allclose(C.fft_msd(r), want)
    a = atoms(spark, [[p] for p in r])
    got = [x["msd"] for x in C.msd_fft(a).orderBy("lag").collect()]
    lag = {x["lag"]: x["msd"] for x in C.msd(a, [0, 3, 9]).collect()}
    assert np.allclose(got, want) and all(math.isclose(lag[k], want[k], abs_tol=1e-9) for k in lag)
    m = C.moments(atoms(spark, [[[0.1 * i, 0, 0]] for i in range(20)]), [1, 5], "run_id").orderBy("lag").collect()
    assert m[0]["r2"] == pytest.approx(0.01) and m[1]["r2"] == pytest.approx(0.25)
    assert C.tau_axis(101, 10.0, 0.024, 0.0, 0.1) == [(i, i * 0.02, 2 * i) for i in range(6)]


def test_fft_counts_lags_in_frames(spark):
    rng = np.random.default_rng(5)
    r = np.cumsum(rng.normal(0, 1, (40, 3)), axis=0) + 50.0
    kept = [k for k in range(3, 40) if k not in (5, 6, 7, 20, 31, *range(24, 30))]
    a = atoms(spark, [[p] for p in r]).where(F.col("frame").isin(kept)).orderBy(F.desc("frame"))
    want = {(x["at_idx"], x["lag"]): x["msd"] for x in C.msd(a, list(range(45))).collect()}
    got = {(x["at_idx"], x["lag"]): x["msd"] for x in C.msd_fft(a).collect()}
    assert set(got) == set(want) and (0, 36) in got and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    ends = atoms(spark, [[p] for p in r]).where("frame IN (0, 1, 30)")
    assert sorted(x["lag"] for x in C.msd_fft(ends).collect()) == [0, 1, 29, 30]


@pytest.mark.parametrize("m,r_max", [(BOX, 2.2), (SKEW, 2.0), (BOX, 6.0)])
def test_vanhove_of_whole_groups(spark, m, r_max):
    rng = np.random.default_rng(6)
    p = rng.uniform(-10, 20, (7, 20, 3))
    symbols = "OOHHHHHCOH" * 2
    a = atoms(spark, p, symbols).where("frame <> 3 AND NOT (frame = 2 AND at_idx = 4)")
    seen = [(f, k) for f in range(7) for k in range(20) if f != 3 and (f, k) != (2, 4)]
    first, second = a.where("symb IN ('O', 'H')"), a.where("symb IN ('H', 'C')")
    got = C.vanhove_groups(first, second, cells(spark, m), [1, 2, 9], r_max, 4, "symb").collect()
    want = {}
    for (f, i), (h, j) in itertools.product(seen, seen):
        if i != j and h - f in (1, 2) and symbols[i] in "OH" and symbols[j] in "HC":
            want.setdefault((symbols[i], symbols[j], h - f), []).append(np.linalg.norm(nearest(p[h][j] - p[f][i], m)))
    assert {(x["symb_i"], x["symb_j"], x["lag"]) for x in got} == set(want) and len(got) == 4 * len(want)
    vol = abs(np.linalg.det(np.array(m).reshape(3, 3)))
    for x in got:
        d = want[x["symb_i"], x["symb_j"], x["lag"]]
        count, edges = np.histogram(d, 4, (0, r_max))
        k = x["bin"]
        assert x["count"] == count[k] and x["rpd"] == pytest.approx(count[k] / len(d) * 4 / r_max)
        assert x["g"] == pytest.approx(count[k] / (len(d) / vol * 4 / 3 * math.pi * (edges[k + 1] ** 3 - edges[k] ** 3)))


def test_rotating_vector(spark):
    w = 0.05
    v = spark.createDataFrame([("r", 1, i, math.cos(w * i), math.sin(w * i), 0.0) for i in range(60)], "run_id string, series_id int, frame int, vx double, vy double, vz double")
    for order, f in ((1, lambda c: c), (2, lambda c: (3 * c * c - 1) / 2), (3, lambda c: (5 * c**3 - 3 * c) / 2)):
        for r in C.vrd(v, order, 20, 5, 10, True, "run_id").collect():
            assert r["c"] == pytest.approx(f(math.cos(w * r["lag"]))) and r["error"] == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        C.legendre(F.lit(1.0), 4)


def test_survival_by_brute_force(spark):
    rng = np.random.default_rng(4)
    seen = rng.random((30, 4)) < 0.8
    c = spark.createDataFrame([("r", f, k) for f in range(30) for k in range(4) if seen[f, k]], "run_id string, frame int, k int")
    fr = spark.createDataFrame([("r", f) for f in range(30)], "run_id string, frame int")
    for n, sampling, stride in ((8, 1, 1), (9, 2, 3)):
        want = []
        for o in range(0, 30 - n + 1, stride):
            first = [k for k in range(4) if seen[o, k]]
            want.append([sum(all(seen[o + s, k] for s in range(0, t + 1, sampling)) for k in first) / len(first) if first else 0.0 for t in range(0, n, sampling)])
        rows = lifetime.survival(c, fr, "run_id", ["k"], n, sampling, stride).orderBy("k").collect()
        assert np.allclose([r["c"] for r in rows], np.mean(want, axis=0))
        assert np.allclose([r["error"] for r in rows], np.std(want, axis=0) / math.sqrt(30 // n))


def test_water_dimer_bonds_and_molecules(spark):
    water = np.array([[0, 0, 0], [0.96, 0, 0], [-0.24, 0.93, 0]])
    p = np.vstack((water, water + [2.8, 0, 0], [[9.6, 5, 5], [0.2, 5, 5]]))
    a = atoms(spark, [p], "OHHOHHHH")
    c = cells(spark, BOX)
    m = {r["mol"]: (r["formula"], list(r["at_idx"])) for r in molecules.molecules(a, molecules.components(a, molecules.bonds(a, c))).collect()}
    assert m == {0: ("H2O", [0, 1, 2]), 3: ("H2O", [3, 4, 5]), 6: ("H2", [6, 7])}
    hb = K.hbonds(a, c, P.tuples(spark, P.hbond_triples([(0, [1, 2]), (3, [4, 5])], [0, 3]))).collect()
    assert [(r["a0"], r["a1"], r["a2"]) for r in hb] == [(0, 1, 3)] and hb[0]["angle"] == pytest.approx(180) and hb[0]["r_da"] == pytest.approx(2.8)
    assert K.cutoff("1.02vdw_sum", "O", "O") == pytest.approx(1.02 * 3.04) and K.cutoff(3, "O", "O") == 3.0
    with pytest.raises(ValueError):
        K.cutoff("1.1coval_sum", "Ce", "O")
    with pytest.raises(ValueError):
        K.parse_criterion("long")
    assert EL.elements(spark).count() == 118


def test_fits_and_lattice():
    t = np.linspace(0, 50, 60)
    assert np.allclose(fits.least_squares(fits.kww, t, fits.kww(t, 7.0, 0.6), [1.0, 0.4]), [7.0, 0.6], rtol=1e-4)
    p = fits.least_squares(fits.bi_exp, t, fits.bi_exp(t, 0.3, 2.0, 20.0), [0.5, 1.0, 10.0])
    assert fits.lifetime(*p) == pytest.approx(0.3 * 2 + 0.7 * 20, rel=1e-3)
    assert fits.kww_mean_time(2.0, 1.0) == pytest.approx(2.0)
    with pytest.raises(ValueError):
        fits.lifetime(0.5, -1, 1)
    cell = np.array(SKEW).reshape(3, 3)
    assert lattice.cart_to_miller(lattice.miller_to_cart([2, -4, 6], cell), cell) == [1, -2, 3]
    b = lattice.basis_along([1, 1, 0], cell)
    assert np.allclose(b @ b.T, np.eye(3)) and np.allclose(lattice.change_basis([[1, 1, 0]], cell, b)[0][1:], 0)
    assert lattice.formula_atoms("C2H5OH") == ["C", "C", "H", "H", "H", "H", "H", "O", "H"] and lattice.element_of("O12") == "O"
    assert lattice.windows([1, 2, 3]) == [[1, 2], [2, 3]] and lattice.windows([1], 2) == [] and lattice.gcd_of([4, 6]) == 2


def test_cells_that_change_from_frame_to_frame(spark):
    """A run whose cell grows: nearest images, wrapping and densities go by each frame's own cell; frames without one take the run's first."""
    from moltide.functions import geom
    from moltide.operators import distributions as D
    from moltide.operators import pairs as P
    from moltide.operators import select as S

    cube = lambda a: [a, 0.0, 0.0, 0.0, a, 0.0, 0.0, 0.0, a]
    frames = spark.createDataFrame([("r", 0, cube(10.0)), ("r", 1, cube(12.0)), ("r", 2, None), ("s", 0, cube(10.0))], "run_id string, frame int, lattice array<double>")
    rows = [(r, f, i, "H", x, 0.0, 0.0) for r, f in (("r", 0), ("r", 1), ("r", 2), ("s", 0)) for i, x in ((0, 0.5), (1, 9.5))]
    a = spark.createDataFrame(rows, "run_id string, frame int, at_idx int, symb string, x double, y double, z double")
    c = geom.frame_cells(frames)
    near = {(r["run_id"], r["frame"]): round(r["dist"], 9) for r in P.neighbours(a, a, c, 4.0, True).collect()}
    assert near == {("r", 0): 1.0, ("r", 1): 3.0, ("r", 2): 1.0, ("s", 0): 1.0}
    v = P.vectors(P.positions(a, P.tuples(spark, [(0, 1)])), c)
    assert {(r["run_id"], r["frame"]): round(r["dx"], 9) for r in v.collect()} == {("r", 0): -1.0, ("r", 1): -3.0, ("r", 2): -1.0, ("s", 0): -1.0}
    w = S.wrap(a.withColumn("x", a.x + 10.0), c).where("at_idx = 0")
    assert {(r["run_id"], r["frame"]): round(r["x"], 6) for r in w.collect()} == {("r", 0): 0.5, ("r", 1): 10.5, ("r", 2): 0.5, ("s", 0): 0.5}
    g = D.rdf(a, a, c, True, 4, 4.0).where("run_id = 'r' AND bin = 1").first()
    assert g["count"] == 2 and abs(g["g"] - 2 / ((2 / 1000 + 1 / 1728) * 4 / 3 * math.pi * 7)) < 1e-9
    assert c.first().own is None and c.own is not None and geom.frame_cells(frames.where("run_id = 's'")).own is None
