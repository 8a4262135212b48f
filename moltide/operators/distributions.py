"""Radial, angular, dihedral, scalar and joint distributions, and coordination numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltide.functions import geom
from moltide.operators import pairs as P
from moltide.operators.hist import bin_of, histogram, histogram2d
from moltide.operators.select import KEY


def rdf(a: DataFrame, b: DataFrame, cells: geom.Cells | DataFrame, same: bool, nbins: int = 200, r_max: float = 15.0, norm: str = "pairs") -> DataFrame:
    """(run_id, bin, r, count, g): radial distribution of each run between the atoms of a and of b.

    count has unordered pairs for one set (same), all pairs of different atoms for two. g is the count over the pairs
    that an even distribution would have in the frames' own volumes; norm "square" counts n * n pairs of one set instead of n (n - 1).
    """
    near = P.neighbours(a, b, cells, r_max, same)
    h = histogram(near, F.col("dist"), 0.0, r_max, nbins, "run_id")
    per = lambda d, c: d.groupBy(*KEY).agg(F.count("*").alias(c))
    if same:
        n = per(a, "na")
        pairs = (F.col("na") * (F.col("na") - 1) if norm == "pairs" else F.col("na") * F.col("na")) / 2
    else:
        # Counts by frame keep the partitioning by frames of cleaned(), so they meet without a shuffle.
        both = per(a.join(b.select(*KEY, "at_idx"), [*KEY, "at_idx"], "left_semi"), "nab")
        n = per(a, "na").join(per(b, "nb"), KEY).join(both, KEY, "left")
        pairs = F.col("na") * F.col("nb") - F.coalesce("nab", F.lit(0))
    total = geom.as_cells(cells).on(n.withColumn("np", pairs), "vol").groupBy("run_id").agg(F.sum(F.col("np") / F.col("vol")).alias("density"))
    w = r_max / nbins
    shell = 4.0 / 3.0 * math.pi * (F.pow(F.col("hi"), 3) - F.pow(F.col("lo"), 3))
    return h.join(total, "run_id").select("run_id", "bin", ((F.col("bin") + 0.5) * w).alias("r"), "count", (F.col("count") / (F.col("density") * shell)).alias("g"))


def coordination(g: DataFrame, a: DataFrame, b: DataFrame, same: bool) -> DataFrame:
    """(run_id, bin, r, n): mean number of b atoms within the bin's outer edge of an a atom, summed from the counts of rdf().

    The running sum has as many rows per run as there are bins.
    """
    na = a.groupBy("run_id").agg(F.count("*").alias("na"))
    w = Window.partitionBy("run_id").orderBy("bin")
    return g.join(na, "run_id").select("run_id", "bin", "r", (F.sum("count").over(w) * (2 if same else 1) / F.col("na")).alias("n"))


def tuple_angles(atoms: DataFrame, cells: geom.Cells | DataFrame | None, tups: DataFrame, lattice: str = "rows", degenerate: float = 90.0) -> DataFrame:
    """(run_id, frame, tuple_id, angle): angle at the second atom of triples; degenerate (a leg without length) as given."""
    p = P.positions(atoms, tups)
    p = geom.as_cells(cells).on(p, *geom.CELL, *geom.INVERSE) if cells is not None else p
    legs = {f"leg{k}": geom.sub(geom.v(f"p{k}"), geom.v("p1")) for k in (0, 2)}
    p = geom.with_images(p, legs, lattice, cells is not None)
    return p.select(*KEY, "tuple_id", geom.angle(geom.v("leg0"), geom.v("leg2"), degenerate).alias("angle"))


def tuple_dihedrals(atoms: DataFrame, cells: geom.Cells | DataFrame | None, tups: DataFrame, signed: bool = False, lattice: str = "rows", degenerate: float = 90.0) -> DataFrame:
    """(run_id, frame, tuple_id, dihedral): planes (0,1,2) and (1,2,3) of four atoms, (0,1,2) and (3,4,5) of six."""
    n = P.size_of(tups)
    if n not in (4, 6):
        raise ValueError("dihedrals need tuples of four or six atoms")
    p = P.positions(atoms, tups)
    p = geom.as_cells(cells).on(p, *geom.CELL, *geom.INVERSE) if cells is not None else p
    steps = [(0, 1), (1, 2), (2, 3)] if n == 4 else [(0, 1), (1, 2), (3, 4), (4, 5)]
    p = geom.with_images(p, {f"step{i}": geom.sub(geom.v(f"p{j}"), geom.v(f"p{i}")) for i, j in steps}, lattice, cells is not None)
    second = ("step1", "step2") if n == 4 else ("step3", "step4")
    planes = {"na": geom.cross(geom.v("step0"), geom.v("step1")), "nb": geom.cross(geom.v(second[0]), geom.v(second[1]))}
    p = geom.with_images(p, planes, periodic=False)
    return p.select(*KEY, "tuple_id", geom.dihedral(geom.v("na"), geom.v("nb"), geom.v("step1") if signed else None, degenerate).alias("dihedral"))


def adf(atoms: DataFrame, cells: geom.Cells | DataFrame | None, tups: DataFrame, nbins: int = 200, lo: float = 0.0, hi: float = 180.0, cone: bool = True) -> DataFrame:
    """(run_id, bin, x, count, value): count over observed tuples, over sin x with the cone correction."""
    a = tuple_angles(atoms, cells, tups)
    h = histogram(a, F.col("angle"), lo, hi, nbins, "run_id")
    n = a.groupBy("run_id").agg(F.count("*").alias("n"))
    weight = F.greatest(F.sin(F.radians("x")), F.lit(1e-10)) if cone else F.lit(1.0)
    return h.join(n, "run_id").select("run_id", "bin", "x", "count", (F.col("count") / (F.col("n") * weight)).alias("value"))


def ddf(atoms: DataFrame, cells: geom.Cells | DataFrame | None, tups: DataFrame, nbins: int = 200, lo: float = 0.0, hi: float = 180.0, signed: bool = False) -> DataFrame:
    """(run_id, bin, x, count, value): dihedral distribution, count over observed tuples."""
    a = tuple_dihedrals(atoms, cells, tups, signed)
    h = histogram(a, F.col("dihedral"), lo, hi, nbins, "run_id")
    n = a.groupBy("run_id").agg(F.count("*").alias("n"))
    return h.join(n, "run_id").select("run_id", "bin", "x", "count", (F.col("count") / F.col("n")).alias("value"))


def sdf(values: DataFrame, value: Column, nbins: int = 200, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(bin, x, count, value): density of any scalar; without a range that of the data, found in a first pass. N counts all values, those out of range too."""
    v = values.select(value.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    stats = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).first()
    lo, hi, n = (stats["lo"] if lo is None else lo), (stats["hi"] if hi is None else hi), stats["n"]
    if not n:
        lo, hi, n = 0.0, 1.0, 1
    if hi == lo:
        lo, hi = lo - 0.5, hi + 0.5
    w = (hi - lo) / nbins
    return histogram(v, F.col("v"), lo, hi, nbins).select("bin", "x", "count", (F.col("count") / (n * w)).alias("value"))


def sdf_summary(density: DataFrame) -> DataFrame:
    """(peak_x, mean_x): where the density is greatest (the first such bin) and its weighted mean."""
    return density.agg(F.max_by("x", F.struct("value", -F.col("bin"))).alias("peak_x"), (F.sum(F.col("x") * F.col("value")) / F.sum("value")).alias("mean_x"))


def cdf(first: DataFrame, second: DataFrame, x: str, y: str, rx: tuple[float, float, int], ry: tuple[float, float, int]) -> DataFrame:
    """(bin_x, bin_y, x, y, count): joint distribution of two observables of the same frame and tuple."""
    j = first.select(*KEY, "tuple_id", F.col(x).alias("vx")).join(second.select(*KEY, "tuple_id", F.col(y).alias("vy")), [*KEY, "tuple_id"])
    return histogram2d(j, F.col("vx"), F.col("vy"), rx, ry)


__all__ = ["adf", "bin_of", "cdf", "coordination", "ddf", "rdf", "sdf", "sdf_summary", "tuple_angles", "tuple_dihedrals"]
