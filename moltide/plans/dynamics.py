"""Queries of displacements and correlations in time over the trajectory tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from moltide.functions import fits, geom
from moltide.operators import channels as CH
from moltide.operators import correlation as C
from moltide.operators import pairs as P
from moltide.operators.select import HIGHEST
from moltide.plans.structure import _v, placed
from moltide.plans.tables import SQL_ATOMS, SQL_BASE, atoms, cells, frames, rounded, sql_bin, sql_diff, sql_mic
from moltide.session import written

LAGS = [0, 1, 2, 4, 8, 16]
LINE_LAGS = [1, 2, 3, 4, 5, 6, 8, 10]
DT = 10.0
R_MAX, R_BINS = 2.0, 40
PAIRS = [(0, 1), (1, 0), (2, 3), (0, 4)]
VECTORS = [(0, 1), (2, 3)]
SEEDS = [(5.0, 5.0), (15.0, 5.0), (5.0, 15.0), (15.0, 15.0), (25.0, 10.0)]
N_THETA, N_PHI = 5, 7
TIE = 0.0000173


def msd_by_lag(spark, d):
    return rounded(C.msd_mean(C.msd(atoms(spark, d), LAGS), "run_id"), 4)


def msd_per_atom(spark, d):
    return rounded(C.msd(atoms(spark, d), LAGS), 4)


def msd_1d_projection(spark, d):
    return rounded(C.msd_projected(atoms(spark, d), (1.0, 2.0, 2.0), LAGS), 4)


def msd_fft(spark, d):
    """All lags of every series by FFT."""
    # Positions have few digits, so means are often ties of rounding: both sides are moved off them.
    return C.msd_fft(atoms(spark, d)).select("run_id", "at_idx", "lag", (F.round(F.col("msd") + TIE, 3) + 0.0).alias("msd"))


def diffusion_coefficient(spark, d):
    m = C.msd_mean(C.msd(atoms(spark, d), LINE_LAGS), "run_id")
    return C.diffusion(m, DT, "run_id").select("run_id", F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("d_cm2_s", 9).alias("d_cm2_s"))


def diffusion_curve(spark, d):
    """D(t) at each lag of the mean square displacement."""
    return rounded(C.diffusion_curve(C.msd_mean(C.msd(atoms(spark, d), LINE_LAGS), "run_id"), DT), 6)


def tau_axis(spark, d):
    """The lags of a time axis in steps of 25 fs, which are 2 time steps, up to 0.2 ps."""
    return spark.createDataFrame(C.tau_axis(101, DT, 0.025, 0.0, 0.2), "number int, tau double, lag int").select("number", F.round("tau", 9).alias("tau"), "lag")


def isf_distinct(spark, d):
    """Distinct intermediate scattering at 2.5 of the listed pairs, at the density of one atom in 100 cubic angstrom."""
    pairs = spark.createDataFrame(PAIRS, "i int, j int")
    vh = C.vanhove_distinct(atoms(spark, d), cells(spark, d), pairs, [1, 4], 12.0, 24)
    return rounded(C.isf_distinct(vh, 2.5, 12.0, 24, 0.01, "run_id"), 4)


def autocorr(spark, d):
    a = atoms(spark, d).select("run_id", "at_idx", "frame", (F.col("x") - 10.0).alias("v"))
    return rounded(C.autocorr(a, LAGS, "v", "run_id", "at_idx"), 3)


def energy_autocorr(spark, d):
    e = frames(spark, d).where(F.abs("energy") < HIGHEST)
    mean = e.groupBy("run_id").agg(F.avg("energy").alias("m"))
    v = e.join(mean, "run_id").select("run_id", "frame", (F.col("energy") - F.col("m")).alias("v"))
    return rounded(C.autocorr(v, LAGS, "v", "run_id"), 2)


def vanhove_self(spark, d):
    return rounded(C.vanhove_self(atoms(spark, d), [1, 4, 16], R_MAX, R_BINS, "run_id"))


def vanhove_slice(spark, d):
    """The self part at the distance nearest to 0.33."""
    vh = C.vanhove_self(atoms(spark, d), [1, 4, 16], R_MAX, R_BINS, "run_id")
    return rounded(C.at_nearest(vh, "r", 0.33).select("run_id", "lag", "bin", "count", "rpd"))


def vanhove_distinct(spark, d):
    pairs = spark.createDataFrame(PAIRS, "i int, j int")
    return rounded(C.vanhove_distinct(atoms(spark, d), cells(spark, d), pairs, [1, 4], 12.0, 24))


def vanhove_distinct_groups(spark, d):
    """The distinct part of every ordered pair of symbols, over all their atoms."""
    a = written(atoms(spark, d).where(F.col("symb").isNotNull()).drop("row_id"), "vanhove")
    return rounded(C.vanhove_groups(a, a, cells(spark, d), [1, 4], 12.0, 24, "symb"))


def non_gaussian(spark, d):
    m = C.moments(atoms(spark, d), LAGS, "run_id")
    return rounded(m.select("run_id", "lag", "r2", "r4", "alpha2"), 2)


def vanhove_summary(spark, d):
    s = C.vanhove_summary(C.moments(atoms(spark, d), LAGS, "run_id"), "run_id")
    return rounded(s.withColumn("peak_lag", F.col("peak_lag").cast("int")), 3)


def isf(spark, d):
    vh = C.vanhove_self(atoms(spark, d), [1, 4, 16], R_MAX, R_BINS, "run_id")
    return rounded(C.isf_self(vh, 2.5, R_MAX, R_BINS, "run_id"), 5)


def _vectors(spark, d):
    v = P.vectors(P.positions(atoms(spark, d), P.tuples(spark, VECTORS)), cells(spark, d))
    return v.select("run_id", F.col("tuple_id").alias("series_id"), "frame", F.col("dx").alias("vx"), F.col("dy").alias("vy"), F.col("dz").alias("vz"))


def _vrd(order: int, mean: bool = True):
    def q(spark, d):
        return rounded(C.vrd(_vectors(spark, d), order, 20, 2, 5, mean, "run_id"), 5)

    return q


def vrd_series(spark, d):
    """The reorientation of positions taken as vectors."""
    v = atoms(spark, d).select("run_id", F.col("at_idx").alias("series_id"), "frame", F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("z").alias("vz"))
    return rounded(C.vrd(v, 2, 10, 3, 5, True, "run_id"), 5)


def channel_assign(spark, d):
    return CH.assign(atoms(spark, d), SEEDS, ["x", "y"]).groupBy("run_id", "at_idx", "region").agg(F.count("*").alias("n"))


def channel_switch_rate(spark, d):
    return rounded(CH.switch_rate(CH.assign(atoms(spark, d), SEEDS, ["x", "y"]), DT, "run_id", "at_idx"))


def direction_sweep(spark, d):
    s = CH.direction_sweep(atoms(spark, d), LINE_LAGS, DT, N_THETA, N_PHI)
    return s.select("run_id", F.col("dir_id").cast("int").alias("dir_id"), *[(F.round(F.col(c), 9) + 0.0).alias(c) for c in ("nx", "ny", "nz")], F.round(F.col("d_cm2_s") * 20000.0, 2).alias("slope"))


def projection(spark, d):
    """Scalar projection of every position on a direction."""
    u = geom.dot(geom.v(""), (F.lit(1.0), F.lit(1.0), F.lit(0.0))) / math.sqrt(2.0)
    return rounded(atoms(spark, d).select("row_id", u.alias("p")))


def kww_fit(spark, d):
    """Stretched exponentials of each run's second-order reorientation: no SQL, tested on known curves."""
    c = C.vrd(_vectors(spark, d), 2, 20, 2, 5, True, "run_id").select("run_id", (F.col("lag") * DT / 1000.0).alias("t"), "c")
    return fits.fit_kww(c, ["run_id"])


QUERIES = {
    f.__name__: f
    for f in (msd_by_lag, msd_per_atom, msd_1d_projection, msd_fft, diffusion_coefficient, diffusion_curve, tau_axis, isf_distinct, autocorr, energy_autocorr, vanhove_self, vanhove_slice, vanhove_distinct, vanhove_distinct_groups, non_gaussian, vanhove_summary, isf, vrd_series, channel_assign, channel_switch_rate, direction_sweep, projection, kww_fit)
} | {"vrd_l1": _vrd(1), "vrd_l2": _vrd(2), "vrd_l3": _vrd(3), "vrd_per_pair": _vrd(2, False)}


# ---- SQL ----
def _lags(lags) -> str:
    return "(VALUES " + ", ".join(f"({k})" for k in lags) + ") t(lag)"


def _disp(lags) -> str:
    return f"""r AS (SELECT p.run_id, p.at_idx, t.lag, (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z) AS r2
        FROM a p CROSS JOIN {_lags(lags)} JOIN a q ON q.run_id = p.run_id AND q.at_idx = p.at_idx AND q.frame = p.frame + t.lag)"""


_per = "per AS (SELECT run_id, at_idx, lag, avg(r2) AS msd, count(*) AS n FROM r GROUP BY ALL)"
_w = R_MAX / R_BINS
_vh = f"""{_disp([1, 4, 16])}, s AS (SELECT run_id, lag, sqrt(r2) AS d FROM r), n AS (SELECT run_id, lag, count(*) AS n FROM s GROUP BY ALL),
    k AS (SELECT run_id, lag, {sql_bin('d', 0.0, R_MAX, R_BINS)} AS bin, count(*) AS count FROM s WHERE d <= {R_MAX} GROUP BY ALL),
    vh AS (SELECT n.run_id, n.lag, CAST(b.bin AS INTEGER) AS bin, (b.bin + 0.5) * {_w} AS r, coalesce(k.count, 0) AS count, coalesce(k.count, 0) / (n.n * {_w}) AS rpd
           FROM n CROSS JOIN range({R_BINS}) b(bin) LEFT JOIN k ON k.run_id = n.run_id AND k.lag = n.lag AND k.bin = b.bin)"""
_mom = f"{_disp(LAGS)}, mo AS (SELECT run_id, lag, avg(r2) AS r2, avg(r2 * r2) AS r4 FROM r GROUP BY ALL), al AS (SELECT *, CASE WHEN r2 > 1e-12 THEN 3 * r4 / (5 * r2 * r2) - 1 ELSE 0.0 END AS alpha2 FROM mo)"
_vec = f"l AS (SELECT p0.run_id, p0.frame, tuple_id AS series_id, {_v('v', sql_mic(sql_diff('p0', 'p1')))} FROM {placed(VECTORS)})"


def _vrd_sql(source: str, order: int, num: int, sampling: int, skip: int, by: str) -> str:
    leg = {1: "d", 2: "(3 * d * d - 1) / 2", 3: "(5 * d * d * d - 3 * d) / 2"}[order]
    return f"""u AS (SELECT run_id, series_id, frame, {', '.join(f'CASE WHEN n > 1e-12 THEN v{k} / n ELSE 0.0 END AS x{k}' for k in 'xyz')}, max(frame) OVER (PARTITION BY run_id, series_id) AS last FROM (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS n FROM {source})),
        w AS (SELECT p.run_id, p.series_id, p.frame AS origin, t.lag, p.xx * q.xx + p.xy * q.xy + p.xz * q.xz AS d FROM u p CROSS JOIN {_lags(range(0, num, sampling))} JOIN u q ON q.run_id = p.run_id AND q.series_id = p.series_id AND q.frame = p.frame + t.lag
              WHERE p.frame % {skip} = 0 AND p.frame + {num} - 1 <= p.last)
        SELECT {by}, lag, round(avg({leg}), 5) + 0.0 AS c, round(stddev_pop({leg}) / sqrt(count(DISTINCT origin)), 5) + 0.0 AS error FROM w GROUP BY ALL"""


_region = "CASE " + " ".join(
    f"WHEN {' AND '.join(f'd{i} <= d{j}' if i < j else f'd{i} < d{j}' for j in range(len(SEEDS)) if j != i)} THEN {i}" for i in range(len(SEEDS))
) + " END"
_chan = f"ds AS (SELECT *, {', '.join(f'(x - {s[0]}) * (x - {s[0]}) + (y - {s[1]}) * (y - {s[1]}) AS d{i}' for i, s in enumerate(SEEDS))} FROM a), ch AS (SELECT run_id, at_idx, frame, row_id, {_region} AS region FROM ds)"
_n = math.sqrt(1.0 + 4.0 + 4.0)
_proj = " + ".join(f"(q.{k} * {c / _n} - p.{k} * {c / _n})" for k, c in zip("xyz", (1.0, 2.0, 2.0), strict=True))
_d2 = sql_mic(("q.x - p.x", "q.y - p.y", "q.z - p.z"))
_s2 = f"({4.0 / 3.0 * math.pi} * (pow((bin + 1) * 0.5, 3) - pow(bin * 0.5, 3)))"

SQL = {
    "msd_by_lag": f"WITH {SQL_ATOMS}, {_disp(LAGS)}, {_per} SELECT run_id, lag, round(avg(msd), 4) + 0.0 AS msd, round(stddev_samp(msd) / sqrt(count(*)), 4) + 0.0 AS error FROM per GROUP BY ALL",
    "msd_per_atom": f"WITH {SQL_ATOMS}, {_disp(LAGS)}, {_per} SELECT run_id, at_idx, lag, round(msd, 4) + 0.0 AS msd, n FROM per",
    "msd_1d_projection": f"WITH {SQL_ATOMS}, r AS (SELECT p.run_id, p.at_idx, t.lag, {_proj} AS d FROM a p CROSS JOIN {_lags(LAGS)} JOIN a q ON q.run_id = p.run_id AND q.at_idx = p.at_idx AND q.frame = p.frame + t.lag) SELECT run_id, at_idx, lag, round(avg(d * d), 4) + 0.0 AS msd FROM r GROUP BY ALL",
    "diffusion_coefficient": f"WITH {SQL_ATOMS}, {_disp(LINE_LAGS)}, {_per}, m AS (SELECT run_id, lag, avg(msd) AS msd FROM per GROUP BY ALL) SELECT run_id, round(regr_slope(msd, lag * {DT} / 1000.0), 3) AS slope, round(regr_intercept(msd, lag * {DT} / 1000.0), 3) AS intercept, round(regr_slope(msd, lag * {DT} / 1000.0) / 60000.0, 9) AS d_cm2_s FROM m WHERE lag > 0 GROUP BY run_id",
    "diffusion_curve": f"WITH {SQL_ATOMS}, {_disp(LINE_LAGS)}, {_per}, m AS (SELECT run_id, lag, avg(msd) AS msd FROM per GROUP BY ALL) SELECT run_id, lag, round(lag * {DT} / 1000.0, 6) AS t_ps, round(msd * 1e-16 / (6 * lag * {DT} * 1e-15), 6) + 0.0 AS d_cm2_s FROM m WHERE lag > 0",
    "tau_axis": "SELECT CAST(k AS INTEGER) AS number, round(k * 0.02, 9) AS tau, CAST(2 * k AS INTEGER) AS lag FROM range(11) t(k)",
    "msd_fft": f"""WITH {SQL_ATOMS} SELECT p.run_id, p.at_idx, CAST(q.frame - p.frame AS BIGINT) AS lag, round(avg((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)) + {TIE}, 3) + 0.0 AS msd
        FROM a p JOIN a q ON q.run_id = p.run_id AND q.at_idx = p.at_idx AND q.frame >= p.frame GROUP BY ALL""",
    "autocorr": f"WITH {SQL_ATOMS} SELECT p.run_id, p.at_idx, t.lag, round(avg((p.x - 10.0) * (q.x - 10.0)), 3) + 0.0 AS c FROM a p CROSS JOIN {_lags(LAGS)} JOIN a q ON q.run_id = p.run_id AND q.at_idx = p.at_idx AND q.frame = p.frame + t.lag GROUP BY ALL",
    "energy_autocorr": f"""WITH f AS (SELECT DISTINCT frame_id, run_id, frame, energy FROM frames WHERE run_id IS NOT NULL AND frame IS NOT NULL AND abs(energy) < {HIGHEST}), m AS (SELECT run_id, avg(energy) AS m FROM f GROUP BY run_id), e AS (SELECT run_id, frame, energy - m AS v FROM f JOIN m USING (run_id)),
        k AS (SELECT p.run_id, t.lag, avg(p.v * q.v) AS c FROM e p CROSS JOIN {_lags(LAGS)} JOIN e q ON q.run_id = p.run_id AND q.frame = p.frame + t.lag GROUP BY ALL) SELECT run_id, lag, round(c, 2) + 0.0 AS c FROM k""",
    "vanhove_self": f"WITH {SQL_ATOMS}, {_vh} SELECT run_id, lag, bin, round(r, 6) + 0.0 AS r, count, round(rpd, 6) + 0.0 AS rpd, round(rpd / ({4 * math.pi} * r * r), 6) + 0.0 AS g FROM vh",
    "vanhove_slice": f"WITH {SQL_ATOMS}, {_vh} SELECT run_id, lag, bin, count, round(rpd, 6) + 0.0 AS rpd FROM vh WHERE bin = (SELECT arg_min(bin, (abs(r - 0.33), r)) FROM vh)",
    "isf": f"WITH {SQL_ATOMS}, {_vh} SELECT run_id, lag, round(sum(rpd * sin(r * 2.5) / (r * 2.5) * {_w}), 5) + 0.0 AS isf FROM vh GROUP BY ALL",
    "vanhove_distinct": f"""WITH {SQL_BASE}, pr(i, j) AS (VALUES {', '.join(map(str, PAIRS))}), s AS (SELECT p.run_id, t.lag, sqrt({' + '.join(f'{e} * {e}' for e in _d2)}) AS d FROM a p JOIN pr ON pr.i = p.at_idx CROSS JOIN {_lags([1, 4])} JOIN a q ON q.run_id = p.run_id AND q.at_idx = pr.j AND q.frame = p.frame + t.lag JOIN cr c ON c.run_id = p.run_id),
        n AS (SELECT run_id, lag, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT run_id, lag, {sql_bin('d', 0.0, 12.0, 24)} AS bin, count(*) AS count FROM s WHERE d <= 12.0 GROUP BY ALL),
        g AS (SELECT n.run_id, n.lag, CAST(b.bin AS INTEGER) AS bin, n.n, vol, coalesce(k.count, 0) AS count FROM n CROSS JOIN range(24) b(bin) LEFT JOIN k ON k.run_id = n.run_id AND k.lag = n.lag AND k.bin = b.bin JOIN cr c ON c.run_id = n.run_id)
        SELECT run_id, lag, bin, (bin + 0.5) * 0.5 AS r, count, round(count / (n * 0.5), 6) + 0.0 AS rpd, round(count / (n / vol * {_s2}), 6) + 0.0 AS g FROM g""",
    "vanhove_distinct_groups": f"""WITH {SQL_BASE}, s AS (SELECT p.run_id, p.symb AS symb_i, q.symb AS symb_j, t.lag, sqrt({' + '.join(f'{e} * {e}' for e in _d2)}) AS d FROM a p CROSS JOIN {_lags([1, 4])} JOIN a q ON q.run_id = p.run_id AND q.frame = p.frame + t.lag AND q.at_idx <> p.at_idx JOIN cr c ON c.run_id = p.run_id WHERE p.symb IS NOT NULL AND q.symb IS NOT NULL),
        n AS (SELECT run_id, symb_i, symb_j, lag, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT run_id, symb_i, symb_j, lag, {sql_bin('d', 0.0, 12.0, 24)} AS bin, count(*) AS count FROM s WHERE d <= 12.0 GROUP BY ALL),
        g AS (SELECT n.run_id, n.symb_i, n.symb_j, n.lag, CAST(b.bin AS INTEGER) AS bin, n.n, vol, coalesce(k.count, 0) AS count FROM n CROSS JOIN range(24) b(bin) LEFT JOIN k ON k.run_id = n.run_id AND k.symb_i = n.symb_i AND k.symb_j = n.symb_j AND k.lag = n.lag AND k.bin = b.bin JOIN cr c ON c.run_id = n.run_id)
        SELECT run_id, symb_i, symb_j, lag, bin, (bin + 0.5) * 0.5 AS r, count, round(count / (n * 0.5), 6) + 0.0 AS rpd, round(count / (n / vol * {_s2}), 6) + 0.0 AS g FROM g""",
    "non_gaussian": f"WITH {SQL_ATOMS}, {_mom} SELECT run_id, lag, round(r2, 2) + 0.0 AS r2, round(r4, 2) + 0.0 AS r4, round(alpha2, 2) + 0.0 AS alpha2 FROM al",
    "vanhove_summary": f"WITH {SQL_ATOMS}, {_mom}, s AS (SELECT run_id, max(alpha2) AS m, CAST(arg_max(lag, (alpha2, -lag)) AS INTEGER) AS peak_lag FROM al GROUP BY run_id) SELECT run_id, peak_lag, round(m, 3) + 0.0 AS peak_alpha2, CASE WHEN m < 0.1 THEN 'Gaussian' ELSE 'heterogeneous' END AS kind FROM s",
    "vrd_series": f"WITH {SQL_ATOMS}, v AS (SELECT run_id, at_idx AS series_id, frame, x AS vx, y AS vy, z AS vz FROM a), {_vrd_sql('v', 2, 10, 3, 5, 'run_id')}",
    "vrd_per_pair": f"WITH {SQL_BASE}, {_vec}, {_vrd_sql('l', 2, 20, 2, 5, 'run_id, series_id')}",
    "channel_assign": f"WITH {SQL_ATOMS}, {_chan} SELECT run_id, at_idx, region, count(*) AS n FROM ch GROUP BY ALL",
    "channel_switch_rate": f"WITH {SQL_ATOMS}, {_chan}, s AS (SELECT run_id, at_idx, region <> lag(region) OVER (PARTITION BY run_id, at_idx ORDER BY frame) AS moved FROM ch) SELECT run_id, at_idx, count(*) AS n, count(*) FILTER (moved) AS changes, round(count(*) FILTER (moved) * 1000.0 / (count(*) * {DT}), 6) + 0.0 AS rate FROM s GROUP BY ALL",
    "projection": f"WITH {SQL_ATOMS} SELECT row_id, round((x * 1.0 + y * 1.0 + z * 0.0) / {math.sqrt(2.0)}, 6) + 0.0 AS p FROM a",
    "direction_sweep": f"""WITH {SQL_ATOMS}, dir AS (SELECT CAST(i AS INTEGER) AS dir_id, -pi() / 2 + (i // {N_PHI}) * (1.5 * pi() / {N_THETA - 1}) AS th, -pi() + (i % {N_PHI}) * (2 * pi() / {N_PHI - 1}) AS ph FROM range({N_THETA * N_PHI}) t(i)),
        nd AS (SELECT dir_id, sin(ph) * sin(th) AS nx, sin(ph) * cos(th) AS ny, cos(ph) AS nz FROM dir),
        r AS (SELECT p.run_id, t.lag, q.x - p.x AS dx, q.y - p.y AS dy, q.z - p.z AS dz FROM a p CROSS JOIN {_lags(LINE_LAGS)} JOIN a q ON q.run_id = p.run_id AND q.at_idx = p.at_idx AND q.frame = p.frame + t.lag),
        m AS (SELECT run_id, lag, dir_id, avg((dx * nx + dy * ny + dz * nz) * (dx * nx + dy * ny + dz * nz)) AS msd FROM r CROSS JOIN nd GROUP BY ALL)
        SELECT run_id, dir_id, round(any_value(nx), 9) + 0.0 AS nx, round(any_value(ny), 9) + 0.0 AS ny, round(any_value(nz), 9) + 0.0 AS nz, round(regr_slope(msd, lag * {DT} / 1000.0), 2) AS slope FROM m JOIN nd USING (dir_id) GROUP BY run_id, dir_id""",
} | {f"vrd_l{o}": f"WITH {SQL_BASE}, {_vec}, {_vrd_sql('l', o, 20, 2, 5, 'run_id')}" for o in (1, 2, 3)}

_g = SQL["vanhove_distinct"].rsplit("SELECT run_id, lag, bin", 1)[0]
SQL["isf_distinct"] = _g + f"SELECT run_id, lag, round(sum({4 * math.pi!r}::DOUBLE * ((bin + 0.5) * 0.5) * ((bin + 0.5) * 0.5) * 0.01 * (count / (n / vol * {_s2}) - 1) * sin((bin + 0.5) * 0.5 * 2.5) / ((bin + 0.5) * 0.5 * 2.5) * 0.5), 4) + 0.0 AS isf FROM g GROUP BY ALL"

__all__ = ["QUERIES", "SQL"]
