"""Selection: atoms by symbol, place or list, frames by slices, groups and their complement; drift and wrapping.

Trajectories are immutable: a DataFrame of atoms (run_id, frame, at_idx, symb, x, y, z) and one of frames. Every
function returns a new DataFrame. Rows with null keys take part nowhere; empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltide.functions import geom
from moltide.functions.elements import elements

KEY = ["run_id", "frame"]


#: Coordinates (angstrom) and energies (eV) of this size or more are no readings of a simulation cell, whatever their source.
FARTHEST, HIGHEST = 1e4, 1e7


def distinct_signed(df: DataFrame, *numbers: str) -> DataFrame:
    """distinct(), which turns -0.0 into 0.0, but for the numbers (or lists of them) named, which stay as they are."""
    g = df.groupBy(*df.columns).agg(*[F.first(c).alias(f"_{c}") for c in numbers])
    return g.select(*[F.col(f"_{c}").alias(c) if c in numbers else F.col(c) for c in df.columns])


def cleaned(atoms: DataFrame, limit: float = FARTHEST, signed: bool = False) -> DataFrame:
    """Each record once (rows equal but for ingested_at), with finite coordinates below the limit; signed keeps -0.0.

    One shuffle, by (run_id, frame): what is later grouped by frames needs no other.
    """
    ok = F.col("run_id").isNotNull() & F.col("frame").isNotNull() & F.col("at_idx").isNotNull()
    for c in "xyz":
        ok = ok & F.col(c).isNotNull() & (F.abs(c) < limit)
    a = atoms.where(ok).select("row_id", "run_id", "frame", "at_idx", "symb", "x", "y", "z").repartition("run_id", "frame")
    return distinct_signed(a, "x", "y", "z") if signed else a.distinct()


def by_symbol(atoms: DataFrame, *symbols: str) -> DataFrame:
    return atoms.where(F.col("symb").isin(*symbols))


def by_index(atoms: DataFrame, index: int, natoms: DataFrame | None = None) -> DataFrame:
    """Atom number index of each frame; a negative one counts from the frame's last atom."""
    if index >= 0:
        return atoms.where(F.col("at_idx") == index)
    last = atoms.groupBy(*KEY).agg(F.max("at_idx").alias("last"))
    return atoms.join(last, KEY).where(F.col("at_idx") == F.col("last") + 1 + index).drop("last")


def group(spark, ids: list[int]) -> DataFrame:
    """(pos, at_idx): an ordered index group; repeats stay."""
    return spark.createDataFrame(list(enumerate(ids)), "pos int, at_idx int")


def take(atoms: DataFrame, ids: list[int]) -> DataFrame:
    """The listed atoms in the given order, renumbered from 0, repeats kept. The list is the caller's and broadcast."""
    g = group(atoms.sparkSession, ids)
    return atoms.join(F.broadcast(g), "at_idx").withColumnRenamed("at_idx", "source_at_idx").withColumnRenamed("pos", "at_idx")


def at_slice(atoms: DataFrame, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Atoms start, start + step, ... before stop; negative bounds count from behind a frame's last atom."""
    i, out = F.col("at_idx"), atoms
    if start < 0 or stop is not None and stop < 0:
        out = out.join(atoms.groupBy(*KEY).agg((F.max("at_idx") + 1).alias("_n")), KEY)
    at = lambda v: F.greatest(F.col("_n") + v, F.lit(0)) if v < 0 else F.lit(v)
    low = at(start)
    out = out.where((i >= low) & ((i - low) % step == 0))
    return (out.where(i < at(stop)) if stop is not None else out).select(*atoms.columns)


def at_sel(atoms: DataFrame, condition: Column, inverse: bool = False) -> DataFrame:
    """Atoms that meet the condition, or all others (those for which it is null included)."""
    hit = F.coalesce(condition, F.lit(False))
    return atoms.where(~hit if inverse else hit)


def frame_slice(atoms: DataFrame, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Frames start, start + step, ... of each run, densely renumbered; the old number stays as source_frame.

    Dense numbers need no window over a run: frames of a slice are numbered by arithmetic.
    """
    f = F.col("frame")
    out = atoms.where((f >= start) & ((f - start) % step == 0))
    if stop is not None:
        out = out.where(f < stop)
    return out.withColumn("source_frame", f).withColumn("frame", ((f - start) / step).cast("int"))


def frame_list(atoms: DataFrame, ids: list[int]) -> DataFrame:
    g = atoms.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, frame int")
    return atoms.join(F.broadcast(g), "frame").withColumnRenamed("frame", "source_frame").withColumnRenamed("pos", "frame")


def run_lengths(frames: DataFrame) -> DataFrame:
    """(run_id, nframes, first_frame, last_frame, is_npt): is_npt if first and last cell differ by more than 1e-5."""
    f = frames.where(F.col("run_id").isNotNull() & F.col("frame").isNotNull()).select("frame_id", "run_id", "frame", "lattice").distinct()
    ends = f.groupBy("run_id").agg(F.count("*").alias("nframes"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.min_by("lattice", "frame").alias("a"), F.max_by("lattice", "frame").alias("b"))
    differ = F.exists(F.zip_with("a", "b", lambda p, q: F.abs(p - q) > 1e-5 + 1e-5 * F.abs(q)), lambda d: d)
    return ends.select("run_id", "nframes", "first_frame", "last_frame", F.coalesce(differ, F.lit(False)).alias("is_npt"))


def with_mass(atoms: DataFrame) -> DataFrame:
    return atoms.join(F.broadcast(elements(atoms.sparkSession).select(F.col("symbol").alias("symb"), "mass")), "symb")


def center_of_mass(atoms: DataFrame, *keys: str) -> DataFrame:
    """(keys, cx, cy, cz) over atoms of known element; default per frame. Positions as stored."""
    keys = keys or tuple(KEY)
    m = with_mass(atoms)
    return m.groupBy(*keys).agg(*[(F.sum(F.col("mass") * F.col(c)) / F.sum("mass")).alias(f"c{c}") for c in "xyz"])


def calib(atoms: DataFrame) -> DataFrame:
    """Positions without drift: every frame moved so that its center of mass is where the run's first one is."""
    com = center_of_mass(atoms)
    first = com.groupBy("run_id").agg(*[F.min_by(f"c{c}", "frame").alias(f"f{c}") for c in "xyz"])
    shift = com.join(first, "run_id").select(*KEY, *[(F.col(f"f{c}") - F.col(f"c{c}")).alias(f"d{c}") for c in "xyz"])
    return atoms.join(shift, KEY).select(*[(F.col(c) + F.col(f"d{c}")).alias(c) if c in "xyz" else F.col(c) for c in atoms.columns])


def with_cell(atoms: DataFrame, cells: geom.Cells | DataFrame) -> DataFrame:
    """Atoms with the cell of their frame."""
    return geom.as_cells(cells).on(atoms)


def wrap(atoms: DataFrame, cells: geom.Cells | DataFrame, center=(0.5, 0.5, 0.5), eps: float = 1e-7, pbc=(True, True, True), lattice: str = "rows") -> DataFrame:
    """Atoms moved into the box around the center."""
    a = with_cell(atoms, cells)
    r = geom.to_cart(geom.wrapped(geom.to_frac(geom.v(""), lattice), center, eps, pbc), lattice)
    return a.select(*[r["xyz".index(c)].alias(c) if c in "xyz" else F.col(c) for c in atoms.columns])


def fractions(atoms: DataFrame, cells: geom.Cells | DataFrame, lattice: str = "rows") -> DataFrame:
    a = with_cell(atoms, cells)
    return a.select(*atoms.columns, *[s.alias(n) for s, n in zip(geom.to_frac(geom.v(""), lattice), ("sx", "sy", "sz"), strict=True)])


def pretty_shift(fracs: DataFrame, axis: str) -> DataFrame:
    """(run_id, frame, start): the fraction after the largest empty gap of a frame along an axis.

    Cyclic gaps are (previous - own) mod 1; the smallest is the largest empty one, ties go to the smaller fraction.
    """
    w = Window.partitionBy(*KEY).orderBy(axis)
    whole = Window.partitionBy(*KEY)
    before = F.coalesce(F.lag(axis).over(w), F.max(axis).over(whole))
    gap = F.pmod(before - F.col(axis), F.lit(1.0))
    return fracs.select(*KEY, F.col(axis).alias("f"), gap.alias("gap")).groupBy(*KEY).agg(F.min_by("f", F.struct("gap", "f")).alias("start"))


def translate_pretty(fracs: DataFrame) -> DataFrame:
    """Fractions sx, sy, sz shifted per frame so that the largest empty gap lies at the cell's border."""
    out = fracs
    for a in ("sx", "sy", "sz"):
        s = pretty_shift(fracs, a).withColumnRenamed("start", f"start_{a}")
        out = out.join(s, KEY)
    return out.select(*[F.pmod(F.col(c) - F.col(f"start_{c}"), F.lit(1.0)).alias(c) if c in ("sx", "sy", "sz") else F.col(c) for c in fracs.columns])
