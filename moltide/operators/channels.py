"""Nearest-seed regions (channels), rate of changes between them, and the direction sweep of the diffusion coefficient."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moltide.operators.correlation import msd_tensor

STRETCH = 4096


def assign(points: DataFrame, seeds: list[tuple[float, ...]], columns: list[str]) -> DataFrame:
    """Adds region: the number of the nearest seed, the first of equally near ones. Seeds are the caller's short list and become constants."""
    d = lambda s: sum((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, s, strict=True))
    best = F.array_min(F.array(*[F.struct(d(s).alias("d"), F.lit(i).alias("region")) for i, s in enumerate(seeds)]))
    return points.withColumn("region", best["region"])


def switch_rate(labelled: DataFrame, dt_fs: float, *keys: str, compat: bool = False) -> DataFrame:
    """(keys, n, changes, rate): changes of region between successive records, per ps; compat gives changes * dt / (1000 n)."""
    # Records are compared inside stretches; the last of the stretch before comes from one row per stretch.
    c = labelled.select(*keys, "frame", "region", F.floor(F.col("frame") / STRETCH).alias("k"))
    ends = c.groupBy(*keys, "k").agg(F.max_by("region", "frame").alias("last"))
    ends = ends.withColumn("before", F.lag("last").over(Window.partitionBy(*keys).orderBy("k"))).drop("last")
    own = F.lag("region").over(Window.partitionBy(*keys, "k").orderBy("frame"))
    c = c.withColumn("own", own).join(ends, [*keys, "k"]).withColumn("changed", (F.col("region") != F.coalesce("own", "before")).cast("int"))
    s = c.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changes"))
    rate = F.col("changes") * dt_fs / (1000.0 * F.col("n")) if compat else F.col("changes") * 1000.0 / (F.col("n") * dt_fs)
    return s.withColumn("rate", rate)


def directions(spark, n_theta: int = 120, n_phi: int = 120) -> DataFrame:
    """(dir_id, nx, ny, nz): the spherical mesh phi in [-pi, pi], theta in [-pi/2, pi]."""
    step = lambda c, lo, hi, n: lo + F.col(c) * ((hi - lo) / max(n - 1, 1))
    g = spark.range(n_theta * n_phi).select(F.col("id").alias("dir_id"), F.floor(F.col("id") / n_phi).alias("i"), (F.col("id") % n_phi).alias("j"))
    g = g.withColumn("theta", step("i", -math.pi / 2, math.pi, n_theta)).withColumn("phi", step("j", -math.pi, math.pi, n_phi))
    return g.select("dir_id", (F.sin("phi") * F.sin("theta")).alias("nx"), (F.sin("phi") * F.cos("theta")).alias("ny"), F.cos("phi").alias("nz"))


def direction_sweep(series: DataFrame, lags: list[int], dt_fs: float, n_theta: int, n_phi: int) -> DataFrame:
    """(run_id, dir_id, nx, ny, nz, d_cm2_s): D along each direction.

    A projected MSD is n T n with the tensor T of displacement products, and the line fit is linear: six slopes per run
    give every direction. slope is square angstrom per ps, D = slope / 20000.
    """
    t = msd_tensor(series, lags)
    x = F.col("lag") * dt_fs / 1000.0
    s = t.groupBy("run_id").agg(*[F.regr_slope(c, x).alias(c) for c in ("xx", "yy", "zz", "xy", "xz", "yz")])
    # The mesh is the caller's parameter and of fixed size; each run meets every direction.
    d = s.crossJoin(F.broadcast(directions(series.sparkSession, n_theta, n_phi)))
    n = {c: F.col(f"n{c}") for c in "xyz"}
    slope = sum(n[c] * n[c] * F.col(c + c) for c in "xyz") + 2 * (n["x"] * n["y"] * F.col("xy") + n["x"] * n["z"] * F.col("xz") + n["y"] * n["z"] * F.col("yz"))
    return d.select("run_id", "dir_id", "nx", "ny", "nz", (slope / 20000.0).alias("d_cm2_s"))


def fastest(sweep: DataFrame) -> DataFrame:
    """(run_id, dir_id, d_cm2_s): the direction of the greatest D, the first of equals."""
    g = sweep.groupBy("run_id").agg(F.max_by(F.struct("dir_id", "d_cm2_s"), F.struct("d_cm2_s", -F.col("dir_id"))).alias("m"))
    return g.select("run_id", "m.dir_id", "m.d_cm2_s")
