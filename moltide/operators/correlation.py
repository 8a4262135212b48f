"""Displacements and correlations in time: MSD, autocorrelation, Van Hove functions, reorientation.

Lags are a bounded list that the caller gives; a lag is an equality join of a frame with a later one, as the frames
of a record are numbered. Long series go through an FFT, one series to a task of bounded length.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltide.functions import geom
from moltide.operators import pairs as P
from moltide.operators.grouped import group_ids, whole_groups
from moltide.operators.hist import histogram
from moltide.operators.select import KEY


def lagged(series: DataFrame, lags: list[int], keys: list[str], values: list[str], origins: Column | None = None) -> DataFrame:
    """(keys, origin, lag, v0.., vk..): every value with the one `lag` frames later. values v become v_0 and v_k.

    The earlier rows are copied once per lag and joined on (keys, frame): no window over a whole series.
    """
    a = series.select(*keys, "frame", *[F.col(c).alias(f"{c}_0") for c in values])
    if origins is not None:
        a = a.where(origins)
    a = a.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("origin", F.col("frame")).withColumn("frame", (F.col("frame") + F.col("lag")).cast("int"))
    b = series.select(*keys, F.col("frame").cast("int").alias("frame"), *[F.col(c).alias(f"{c}_k") for c in values])
    return a.join(b, [*keys, "frame"]).drop("frame")


def displacement(series: DataFrame, lags: list[int], *keys: str) -> DataFrame:
    keys = list(keys) or ["run_id", "at_idx"]
    p = lagged(series, lags, keys, ["x", "y", "z"])
    r2 = sum((F.col(f"{c}_k") - F.col(f"{c}_0")) * (F.col(f"{c}_k") - F.col(f"{c}_0")) for c in "xyz")
    return p.select(*keys, "origin", "lag", r2.alias("r2"))


def msd(series: DataFrame, lags: list[int], *keys: str) -> DataFrame:
    """(keys, lag, msd, n): mean square displacement of each series of unwrapped positions, over all origins."""
    keys = list(keys) or ["run_id", "at_idx"]
    return displacement(series, lags, *keys).groupBy(*keys, "lag").agg(F.avg("r2").alias("msd"), F.count("*").alias("n"))


def msd_mean(per_series: DataFrame, *keys: str) -> DataFrame:
    """(keys, lag, msd, error): mean over series with stddev_samp / sqrt(n) as error (null for one series)."""
    return per_series.groupBy(*keys, "lag").agg(F.avg("msd").alias("msd"), (F.stddev_samp("msd") / F.sqrt(F.count("*"))).alias("error"))


def diffusion(mean: DataFrame, dt_fs: float, *keys: str, skip: int = 0, dim: int = 3) -> DataFrame:
    """(keys, slope, intercept, d_cm2_s): line through MSD (square angstrom) over t (ps), D = slope / (2 dim) * 1e-4."""
    t = F.col("lag") * dt_fs / 1000.0
    return mean.where(F.col("lag") > skip).groupBy(*keys).agg(F.regr_slope("msd", t).alias("slope"), F.regr_intercept("msd", t).alias("intercept")).withColumn("d_cm2_s", F.col("slope") / (2 * dim) * 1e-4)


def diffusion_curve(mean: DataFrame, dt_fs: float, dim: int = 3) -> DataFrame:
    """mean (run_id, lag, msd) as (run_id, lag, t_ps, d_cm2_s): D(t) = MSD / (2 dim t) at each lag but 0."""
    t = F.col("lag") * dt_fs
    return mean.where(F.col("lag") > 0).select("run_id", "lag", (t / 1000.0).alias("t_ps"), (F.col("msd") * 1e-16 / (2 * dim * t * 1e-15)).alias("d_cm2_s"))


def msd_projected(series: DataFrame, vector: tuple[float, float, float], lags: list[int], *keys: str) -> DataFrame:
    """(keys, lag, msd): mean square of the displacement along a direction."""
    keys = list(keys) or ["run_id", "at_idx"]
    n = math.sqrt(sum(c * c for c in vector))
    u = sum(F.col(c) * (k / n) for c, k in zip("xyz", vector, strict=True))
    p = lagged(series.select(*keys, "frame", u.alias("u")), lags, keys, ["u"])
    d = F.col("u_k") - F.col("u_0")
    return p.groupBy(*keys, "lag").agg(F.avg(d * d).alias("msd"))


def msd_tensor(series: DataFrame, lags: list[int], *keys: str) -> DataFrame:
    """(keys, lag, xx, yy, zz, xy, xz, yz): mean products of displacement components. A projection on n is n T n."""
    keys = list(keys) or ["run_id"]
    p = lagged(series, lags, ["run_id", "at_idx"], ["x", "y", "z"])
    d = {c: F.col(f"{c}_k") - F.col(f"{c}_0") for c in "xyz"}
    return p.groupBy(*keys, "lag").agg(*[F.avg(d[a] * d[b]).alias(a + b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")])


def autocorr(series: DataFrame, lags: list[int], value: str, *keys: str) -> DataFrame:
    """(keys, lag, c): unbiased autocorrelation, the mean of v(k) v(k + lag)."""
    p = lagged(series, lags, list(keys), [value])
    return p.groupBy(*keys, "lag").agg(F.avg(F.col(f"{value}_0") * F.col(f"{value}_k")).alias("c"))


def fft_autocorr(x: np.ndarray) -> np.ndarray:
    """Sum over components of the unbiased autocorrelation of (n,) or (n, d) values at all lags, by a padded FFT."""
    x = np.atleast_2d(np.asarray(x, float).T).T
    n = len(x)
    f = np.fft.fft(x, n=2 ** (2 * n - 1).bit_length(), axis=0)
    return np.fft.ifft((f * f.conj()).sum(1)).real[:n] / (n - np.arange(n))


def fft_msd(r: np.ndarray, frame: np.ndarray | None = None) -> np.ndarray:
    """Mean square displacement at all lags of (n,) or (n, d) values in O(span log span); NaN at lags that no pair of values has.

    frame: whole numbers, one to a value; without them values are one frame apart. Values are summed onto the frame axis
    beside their count, so frames without a value add nothing, and the count's own correlation is the pairs of each lag.
    """
    r = np.atleast_2d(np.asarray(r, float).T).T
    t = np.arange(len(r)) if frame is None else np.asarray(frame, "int64") - np.min(frame)
    r = r - r.mean(0)
    n = int(t.max()) + 1
    size = 1 << (2 * n - 1).bit_length()
    spectrum = lambda w: np.fft.rfft(np.bincount(t, w, n), size)
    count = spectrum(None)
    pairs = np.rint(np.fft.irfft(count.real**2 + count.imag**2, size)[:n])
    f = spectrum((r * r).sum(1))
    power = count.real * f.real + count.imag * f.imag
    for x in r.T:
        f = spectrum(x)
        power -= f.real**2 + f.imag**2
    total = 2 * np.fft.irfft(power, size)[:n]
    return np.where(pairs > 0, np.maximum(total, 0.0) / np.maximum(pairs, 1), np.nan)


def msd_fft(series: DataFrame, *keys: str) -> DataFrame:
    """(keys, lag, msd) at every lag in frames that some pair of a series' records has, as msd() gives it; one FFT per series.

    A series is one atom or molecule of one run and is worked in one task: its memory grows with the frames from its first to its last.
    """
    keys = list(keys) or ["run_id", "at_idx"]
    types = dict(series.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = fft_msd(pdf[["x", "y", "z"]].to_numpy(), pdf["frame"].to_numpy())
        lag = np.flatnonzero(~np.isnan(m))
        return pd.DataFrame({k: pdf[k].iloc[0] for k in keys} | {"lag": lag, "msd": m[lag]})[[*keys, "lag", "msd"]]

    return series.select(*keys, "frame", "x", "y", "z").groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", lag long, msd double")


def tau_axis(nframes: int, dt_fs: float, tau_sep: float | None, lo: float, hi: float) -> list[tuple[int, float, int]]:
    """(number, tau in ps, lag in frames): tau_sep becomes a whole number of time steps (half-even), one at least; hi at most the record."""
    dt = dt_fs / 1000.0
    step = max(1, round((tau_sep or dt) / dt)) * dt
    hi = min(hi, (nframes - 1) * dt)
    out, k = [], 0
    while lo + k * step <= hi + 0.1 * step:
        t = lo + k * step
        out.append((k, t, round(t / dt)))
        k += 1
    return out


def vanhove_self(series: DataFrame, lags: list[int], r_max: float, nbins: int, *keys: str) -> DataFrame:
    """(keys, lag, bin, r, count, rpd, g): self part. rpd integrates to the share of displacements in range."""
    keys = list(keys)
    d = displacement(series, lags).select(*keys, "lag", F.sqrt("r2").alias("d"))
    return _vanhove(d, nbins, r_max, [*keys, "lag"])


def _vanhove(d: DataFrame, nbins: int, r_max: float, keys: list[str]) -> DataFrame:
    w = r_max / nbins
    h = histogram(d, F.col("d"), 0.0, r_max, nbins, *keys)
    n = d.groupBy(*keys).agg(F.count("*").alias("n"))
    rpd = F.col("count") / (F.col("n") * w)
    return h.join(n, keys).select(*keys, "bin", F.col("x").alias("r"), "count", rpd.alias("rpd"), (rpd / (4 * math.pi * F.col("x") * F.col("x"))).alias("g"))


def at_nearest(table: DataFrame, column: str, value: float) -> DataFrame:
    """The slice of a distribution at the axis value nearest to the given one, the smaller of two equally near."""
    best = table.select(column).distinct().agg(F.min_by(column, F.struct(F.abs(F.col(column) - value), F.col(column))).alias(column))
    return table.join(F.broadcast(best), column, "left_semi")


def moments(series: DataFrame, lags: list[int], *keys: str) -> DataFrame:
    """(keys, lag, r2, r4, alpha2): non-Gaussian parameter 3 r4 / (5 r2^2) - 1, 0 where r2 is 1e-12 or less."""
    d = displacement(series, lags)
    m = d.groupBy(*keys, "lag").agg(F.avg("r2").alias("r2"), F.avg(F.col("r2") * F.col("r2")).alias("r4"))
    return m.withColumn("alpha2", F.when(F.col("r2") > 1e-12, 3 * F.col("r4") / (5 * F.col("r2") * F.col("r2")) - 1).otherwise(0.0))


def vanhove_summary(m: DataFrame, *keys: str) -> DataFrame:
    """(keys, peak_alpha2, peak_lag, kind): below 0.1 the motion counts as Gaussian."""
    s = m.groupBy(*keys).agg(F.max("alpha2").alias("peak_alpha2"), F.max_by("lag", F.struct("alpha2", -F.col("lag"))).alias("peak_lag"))
    return s.withColumn("kind", F.when(F.col("peak_alpha2") < 0.1, "Gaussian").otherwise("heterogeneous"))


def isf_self(vh: DataFrame, k: float, r_max: float, nbins: int, *keys: str) -> DataFrame:
    """(keys, lag, isf): self intermediate scattering at k, the sum of rpd sin(kr)/(kr) dr."""
    kr = F.col("r") * k
    return vh.groupBy(*keys, "lag").agg(F.sum(F.col("rpd") * F.when(kr == 0, 1.0).otherwise(F.sin(kr) / kr) * (r_max / nbins)).alias("isf"))


def isf_distinct(vh: DataFrame, k: float, r_max: float, nbins: int, density: float, *keys: str) -> DataFrame:
    """(keys, lag, isf): distinct part, the sum of 4 pi r^2 rho (g - 1) sin(kr)/(kr) dr."""
    kr = F.col("r") * k
    return vh.groupBy(*keys, "lag").agg(F.sum(4 * math.pi * F.col("r") * F.col("r") * density * (F.col("g") - 1) * F.when(kr == 0, 1.0).otherwise(F.sin(kr) / kr) * (r_max / nbins)).alias("isf"))


def vanhove_distinct(series: DataFrame, cells: geom.Cells | DataFrame, pairs: DataFrame, lags: list[int], r_max: float, nbins: int) -> DataFrame:
    """(run_id, lag, bin, r, count, rpd, g): distance of atom i at t and atom j at t + lag by the nearest image.

    pairs: (i, j) with i <> j, a broadcast list of the caller's; n counts the observed pairs, g has them per volume and shell.
    Two frames are compared in one cell, the run's first.
    """
    cells = geom.as_cells(cells).run
    a = series.select(*KEY, F.col("at_idx").alias("i"), *[F.col(c).alias(f"a{c}") for c in "xyz"]).join(F.broadcast(pairs), "i")
    a = a.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("frame", (F.col("frame") + F.col("lag")).cast("int"))
    b = series.select("run_id", F.col("frame").cast("int").alias("frame"), F.col("at_idx").alias("j"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    p = a.join(b, ["run_id", "frame", "j"]).join(cells, "run_id")
    d = geom.with_images(p, {"d": geom.sub(geom.v("b"), geom.v("a"))}).select("run_id", "lag", geom.norm(geom.v("d")).alias("d"))
    w = r_max / nbins
    h = histogram(d, F.col("d"), 0.0, r_max, nbins, "run_id", "lag")
    n = d.groupBy("run_id", "lag").agg(F.count("*").alias("n")).join(cells.select("run_id", "vol"), "run_id")
    shell = 4.0 / 3.0 * math.pi * (F.pow("hi", 3) - F.pow("lo", 3))
    return h.join(n, ["run_id", "lag"]).select("run_id", "lag", "bin", F.col("x").alias("r"), "count", (F.col("count") / (F.col("n") * w)).alias("rpd"), (F.col("count") / (F.col("n") / F.col("vol") * shell)).alias("g"))


BLOCK = 32


def _distances(p: pd.DataFrame, by: list[str], lags: list[int], r_max: float, nbins: int) -> pd.DataFrame:
    """Counts by run, groups, lag and bin of whole (run, block, cell) groups: role 0 at t against role 1 at t + lag.

    pairs: the same counts in runs of one grid cell, where all pairs meet and those beyond r_max (bin -1) are counted too.
    """
    g, run = group_ids(p, ["run_id", "block", "c1", "c2", "c3"]), group_ids(p, ["run_id"])
    frame, at = p["frame"].to_numpy("int64"), p["at_idx"].to_numpy()
    code = p.groupby(by, sort=False, dropna=False).ngroup().to_numpy() if by else np.zeros(len(p), "int64")
    k, slots, alone = int(code.max()) + 1, nbins + 1, p["alone"].to_numpy(bool)
    size = (int(run.max()) + 1) * k * k * slots
    xyz, h, inv = [p[c].to_numpy() for c in "xyz"], {c: p[c].to_numpy() for c in geom.CELL}, {c: p[c].to_numpy() for c in geom.INVERSE}
    low = frame.min() + min(0, *lags)
    span = frame.max() + max(0, *lags) - low + 1
    place = g * span + frame - low
    first, later = (np.flatnonzero(p["role"].to_numpy() == v) for v in (0, 1))
    out = []
    for lag in lags:
        lo, hi = (np.searchsorted(place[later], place[first] + lag, side) for side in ("left", "right"))
        upto = np.cumsum(hi - lo)
        cuts = np.unique(np.searchsorted(upto, np.arange(1 << 20, upto[-1] if len(upto) else 0, 1 << 20)))
        for part in np.split(np.arange(len(first)), cuts):
            n = (hi - lo)[part]
            i = np.repeat(first[part], n)
            j = later[np.repeat(lo[part] - (np.cumsum(n) - n), n) + np.arange(len(i))]
            other = at[i] != at[j]
            i, j = i[other], j[other]
            d = [x[j] - x[i] for x in xyz]
            cells = [np.rint(d[0] * inv[f"g1{c}"][i] + d[1] * inv[f"g2{c}"][i] + d[2] * inv[f"g3{c}"][i]) for c in (1, 2, 3)]
            d = [d[c - 1] - (cells[0] * h[f"h1{c}"][i] + cells[1] * h[f"h2{c}"][i] + cells[2] * h[f"h3{c}"][i]) for c in (1, 2, 3)]
            r = np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
            slot = np.where(r <= r_max, np.minimum(np.floor(r / r_max * nbins), nbins - 1), nbins).astype("int64")
            key = (((run[i] * k + code[i]) * k + code[j]) * slots + slot)[(slot < nbins) | alone[i]]
            if size <= 1 << 20:
                count = np.bincount(key, minlength=size)
                key = np.flatnonzero(count)
                count = count[key]
            else:
                key, count = np.unique(key, return_counts=True)
            out.append(np.stack((key, np.full(len(key), lag), count)))
    key, lag, count = np.concatenate(out, axis=1)
    at_run, at_code = (np.unique(v, return_index=True)[1] for v in (run, code))
    r, i, j, slot = at_run[key // (slots * k * k)], at_code[key // (slots * k) % k], at_code[key // slots % k], key % slots
    of = lambda c, at: p[c].to_numpy()[at]
    ids = {"run_id": of("run_id", r)} | {f"{c}_i": of(c, i) for c in by} | {f"{c}_j": of(c, j) for c in by}
    return pd.DataFrame(ids | {"lag": lag.astype("int32"), "bin": np.where(slot < nbins, slot, -1).astype("int32"), "count": count, "pairs": np.where(alone[r], count, 0)})


def vanhove_groups(a: DataFrame, b: DataFrame, cells: geom.Cells | DataFrame, lags: list[int], r_max: float, nbins: int, *by: str) -> DataFrame:
    """(run_id, by_i, by_j, lag, bin, r, count, rpd, g): distinct part between whole sets, atom i of a at t and atom j <> i of b at t + lag.

    by: columns of both sets, such as the symbol, that part them into groups; every ordered pair of groups has a curve.
    Grid cells are those of neighbours(). Atoms come together once per block of frames and cell, not once per lag, and are
    counted there, so neither pairs nor copies for lags inside a block are shuffled. Pairs of any distance, for the norm,
    are counted there too in runs of one grid cell; in others they come from counts by frame less an atom with itself.
    Two frames are compared in one cell, the run's first.
    """
    by = list(by)
    by_i, by_j = [f"{c}_i" for c in by], [f"{c}_j" for c in by]
    keys, place = ["run_id", *by_i, *by_j, "lag"], ["run_id", "block", "c1", "c2", "c3"]
    cells = geom.as_cells(cells).first()
    held = cells.small
    shape = [] if held else [*geom.CELL, *geom.INVERSE]
    row = [*place, "frame", "at_idx", "x", "y", "z", *by, *shape, F.expr("n1 * n2 * n3 = 1").alias("alone")]
    blocks = F.array_distinct(F.array(*[F.floor((F.col("frame") + k) / BLOCK) for k in lags]))
    first = P.around(P.gridded(a, cells, r_max, carry=tuple(by))).withColumn("block", F.explode(blocks)).select(*row, F.lit(0).alias("role"))
    later = P.gridded(b, cells, r_max, carry=tuple(by)).withColumn("block", F.floor(F.col("frame") / BLOCK)).select(*row, F.lit(1).alias("role"))
    both = first.unionByName(later).repartition(*place)
    # The cell joins a row after the shuffle where it can be broadcast.
    both = both.join(F.broadcast(cells.run.select("run_id", *geom.CELL, *geom.INVERSE)), "run_id") if held else both
    types = dict(a.dtypes)
    schema = ", ".join(["run_id string", *[f"{c}_{s} {types[c]}" for s in "ij" for c in by], "lag int, bin int, count long, pairs long"])
    near = both.sortWithinPartitions(*place, "role", "frame").mapInPandas(lambda batches: whole_groups(batches, place, lambda p: _distances(p, by, lags, r_max, nbins), 20000), schema)
    counted = near.groupBy(*keys, "bin").agg(F.sum("count").alias("count"), F.sum("pairs").alias("pairs"))
    a, b = (P.gridded(s, cells, r_max, carry=tuple(by)).where("n1 * n2 * n3 > 1").select(*KEY, "at_idx", *by) for s in (a, b))
    i = a.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("frame", (F.col("frame") + F.col("lag")).cast("int")).withColumnsRenamed(dict(zip(by, by_i)))
    j = b.withColumn("frame", F.col("frame").cast("int")).withColumnsRenamed(dict(zip(by, by_j)))
    every = i.groupBy(*KEY, "lag", *by_i).agg(F.count("*").alias("ni")).join(j.groupBy(*KEY, *by_j).agg(F.count("*").alias("nj")), KEY)
    own = i.join(j, [*KEY, "at_idx"])
    every, own = every.groupBy(*keys).agg(F.sum(F.col("ni") * F.col("nj")).alias("pairs")), own.groupBy(*keys).agg((-F.count("*")).alias("pairs"))
    # At most nbins counts a key.
    g = counted.unionByName(every, allowMissingColumns=True).unionByName(own, allowMissingColumns=True).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("bin") >= 0, F.struct("bin", "count")))).alias("m"), F.sum("pairs").alias("n")
    )
    w = r_max / nbins
    g = g.where(F.col("n") > 0).join(cells.run.select("run_id", "vol"), "run_id").selectExpr("*", f"explode(sequence(0, {nbins - 1})) AS bin").withColumn("count", F.expr("coalesce(m[bin], 0L)"))
    shell = 4.0 / 3.0 * math.pi * (F.pow((F.col("bin") + 1) * w, 3) - F.pow(F.col("bin") * w, 3))
    return g.select(*keys, "bin", ((F.col("bin") + 0.5) * w).alias("r"), "count", (F.col("count") / (F.col("n") * w)).alias("rpd"), (F.col("count") / (F.col("n") / F.col("vol") * shell)).alias("g"))


def legendre(c: Column, order: int) -> Column:
    if order == 1:
        return c
    if order == 2:
        return (3 * c * c - 1) / 2
    if order == 3:
        return (5 * c * c * c - 3 * c) / 2
    raise ValueError("Legendre polynomials of order 1, 2 and 3 are supported")


def vrd(vectors: DataFrame, order: int, num: int, sampling: int = 5, skip: int = 10, mean: bool = True, *keys: str) -> DataFrame:
    """(keys, lag, c, error): reorientation correlation of (keys, series_id, frame, vx, vy, vz).

    Windows of num frames begin at every skip-th frame that leaves a whole window in its series' record; lags are
    multiples of sampling inside it. error: stddev_pop / sqrt(windows). mean=False gives a curve per series.
    """
    keys = list(keys)
    u = geom.unit(geom.v("v"))
    s = vectors.select(*keys, "series_id", "frame", *[c.alias(n) for c, n in zip(u, ("x", "y", "z"), strict=True)])
    last = s.groupBy(*keys, "series_id").agg(F.max("frame").alias("last"))
    s = s.join(last, [*keys, "series_id"])
    ids = [*keys, "series_id"]
    p = lagged(s.select(*ids, "frame", "x", "y", "z", "last"), list(range(0, num, sampling)), ids, ["x", "y", "z"], (F.col("frame") % skip == 0) & (F.col("frame") + num - 1 <= F.col("last")))
    c = legendre(sum(F.col(f"{a}_0") * F.col(f"{a}_k") for a in "xyz"), order)
    by = [*keys, "lag"] if mean else [*ids, "lag"]
    return p.select(*by, "origin", c.alias("c")).groupBy(*by).agg(F.avg("c").alias("c"), (F.stddev_pop("c") / F.sqrt(F.count_distinct("origin"))).alias("error"))
