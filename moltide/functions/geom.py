"""Periodic geometry as column expressions: everything stays inside generated code.

A vector is a tuple of three columns. Cells are nine columns h11 .. h33 (rows are lattice vectors), their inverse
g11 .. g33 and the volume vol, as cells() makes them. lattice="columns" reads the same nine numbers with lattice
vectors as columns. Rounding to the nearest image is half-even, once (in skewed cells that need not be the
shortest image; exact=True looks at the 27 around it).
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltide.session import broadcast_if_small

Vec = tuple[Column, Column, Column]
AXES = (1, 2, 3)
CELL = [f"h{i}{j}" for i in AXES for j in AXES]
INVERSE = [f"g{i}{j}" for i in AXES for j in AXES]


def v(prefix: str) -> Vec:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    """a over its length; a vector of length up to 1e-12 stays zero."""
    n = norm(a)
    return tuple(F.when(n > 1e-12, c / n).otherwise(F.lit(0.0)) for c in a)


def _times(r: Vec, m: str, lattice: str) -> Vec:
    if lattice not in ("rows", "columns"):
        raise ValueError(f"lattice is rows or columns, not {lattice!r}")
    e = (lambda i, j: F.col(f"{m}{i}{j}")) if lattice == "rows" else (lambda i, j: F.col(f"{m}{j}{i}"))
    return tuple(r[0] * e(1, j) + r[1] * e(2, j) + r[2] * e(3, j) for j in AXES)


def to_frac(r: Vec, lattice: str = "rows") -> Vec:
    return _times(r, "g", lattice)


def to_cart(s: Vec, lattice: str = "rows") -> Vec:
    return _times(s, "h", lattice)


def mic(d: Vec, lattice: str = "rows", exact: bool = False) -> Vec:
    """The image of the difference d by the single-rounding rule, or the shortest of the 27 images around it."""
    near = to_cart(tuple(F.rint(c) for c in to_frac(d, lattice)), lattice)
    image = sub(d, near)
    if not exact:
        return image
    shift = lambda i, j, k: sub(image, to_cart((F.lit(float(i)), F.lit(float(j)), F.lit(float(k))), lattice))
    every = [shift(*t) for t in itertools.product((0, -1, 1), repeat=3)]
    best = F.array_min(F.array(*[F.struct(dot(d, d).alias("d"), *[c.alias(n) for c, n in zip(d, "xyz", strict=True)]) for d in every]))
    return best["x"], best["y"], best["z"]


def with_images(df: DataFrame, vectors: dict[str, Vec], lattice: str = "rows", periodic: bool = True) -> DataFrame:
    """df with columns <name>x, <name>y, <name>z for each vector, by its nearest image if periodic.

    Differences, whole cells and images are columns of their own, step by step: later expressions refer to them
    instead of repeating them, which keeps plans small.
    """
    raw = "_" if periodic else ""
    d = df.select("*", *[c.alias(f"{raw}{n}{k}") for n, vec in vectors.items() for c, k in zip(vec, "xyz", strict=True)])
    if not periodic:
        return d
    e = (lambda m, i, j: f"{m}{i}{j}") if lattice == "rows" else (lambda m, i, j: f"{m}{j}{i}")
    times = lambda x, m, j: " + ".join(f"{x}{k} * {e(m, i, j)}" for i, k in zip(AXES, "xyz", strict=True))
    d = d.selectExpr("*", *[f"rint({times(f'_{n}', 'g', j)}) AS _{n}n{k}" for n in vectors for j, k in zip(AXES, "xyz", strict=True)])
    d = d.selectExpr("*", *[f"_{n}{k} - ({times(f'_{n}n', 'h', j)}) AS {n}{k}" for n in vectors for j, k in zip(AXES, "xyz", strict=True)])
    return d.drop(*[f"_{n}{m}{k}" for n in vectors for m in ("", "n") for k in "xyz"])


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on computed geometry.

    A plain filter is pushed below the steps of with_images() and repeats their whole expressions for every use
    (minutes of planning for angles); as a generator of one row or none it stays above them and reads their columns.
    """
    columns = df.columns
    return df.select("*", F.explode(F.when(condition, F.array(F.lit(True)))).alias("_kept")).select(*columns)


def angle(p: Vec, q: Vec, degenerate: float | None = None) -> Column:
    """Angle in degrees between two vectors; with a vector of no length NaN, or the given value."""
    n = norm(p) * norm(q)
    c = F.degrees(F.acos(F.greatest(F.least(dot(p, q) / n, F.lit(1.0)), F.lit(-1.0))))
    return F.when(n > 1e-12, c).otherwise(F.lit(float("nan") if degenerate is None else degenerate))


def dihedral(n1: Vec, n2: Vec, axis: Vec | None = None, degenerate: float = 0.0) -> Column:
    """Angle between plane normals in [0, 180]; with an axis, signed in (-180, 180]."""
    if axis is None:
        return angle(n1, n2, degenerate)
    m = cross(n1, unit(axis))
    return F.when(norm(n1) * norm(n2) > 1e-12, F.degrees(F.atan2(-dot(m, n2), dot(n1, n2)))).otherwise(F.lit(degenerate))


#: t1 .. t3: thickness of the cell across its lattice vectors; u1 .. u3 across the columns.
THICK = [f"{m}{i}" for m in "tu" for i in AXES]
EVERY = [*CELL, *INVERSE, "vol", *THICK]
#: Bytes of a row of a cell table, for the check of its size.
ROW_BYTES = 250


@dataclass(frozen=True)
class Cells:
    """Cells of runs, and of the frames whose cell is another one (a changing cell).

    run: (run_id, cell, inverse, vol) of each run's first frame that has a cell. own: the same by (run_id, frame) for
    frames that differ from it, None if there are none. small: both have a checked size and are broadcast.
    """

    run: DataFrame
    own: DataFrame | None = None
    small: bool = False

    def on(self, df: DataFrame, *columns: str) -> DataFrame:
        """df with the cell of each row's frame; runs without a cell drop out. df has run_id and frame."""
        columns = columns or tuple(EVERY)
        hint = F.broadcast if self.small else lambda d: d
        if self.own is None:
            return df.join(self.run.select("run_id", *columns), "run_id")
        # Cells come from one table by (run, frame), frame -1 for the run's own: they stay plain columns, which keeps later expressions small.
        every = self.run.select("run_id", F.lit(-1).alias("_at"), *columns).unionByName(self.own.select("run_id", F.col("frame").alias("_at"), *columns))
        other = self.own.select("run_id", "frame", F.col("frame").alias("_at"))
        j = df.join(hint(other), ["run_id", "frame"], "left").withColumn("_at", F.coalesce("_at", F.lit(-1)))
        return j.join(hint(every), ["run_id", "_at"]).select(*df.columns, *columns)

    def first(self) -> Cells:
        """Each run's first cell for all of its frames."""
        return Cells(self.run, None, self.small)


def as_cells(cells: Cells | DataFrame) -> Cells:
    """A table of one cell per run, as cells() gives it, counts for all frames of the run."""
    return cells if isinstance(cells, Cells) else Cells(cells)


def cells(frames: DataFrame) -> DataFrame:
    """(run_id, cell, inverse, vol, thickness) from `lattice` (9 numbers) of each run's first frame that has one. A cell without volume gives null inverses."""
    m = frames.where(F.size("lattice") == 9).groupBy("run_id").agg(F.min_by("lattice", "frame").alias("m"))
    return with_inverse(m.selectExpr("run_id", *[f"get(m, {i}) AS {n}" for i, n in enumerate(CELL)]))


def frame_cells(frames: DataFrame) -> Cells:
    """Cells of runs and of frames with another one, from `lattice` (9 numbers). A cell without volume gives null inverses; of repeated frames with several lattices the least counts."""
    f = frames.where(F.col("run_id").isNotNull() & F.col("frame").isNotNull() & (F.size("lattice") == 9)).groupBy("run_id", "frame").agg(F.min("lattice").alias("m"))
    flat = lambda m, *keys: with_inverse(m.selectExpr(*keys, *[f"get(m, {i}) AS {n}" for i, n in enumerate(CELL)]))
    run = f.groupBy("run_id").agg(F.min_by("m", "frame").alias("m"))
    own = f.join(run.withColumnRenamed("m", "first"), "run_id").where(F.col("m") != F.col("first"))
    run, few = broadcast_if_small(flat(run, "run_id"), ROW_BYTES)
    own, small = broadcast_if_small(flat(own, "run_id", "frame"), ROW_BYTES)
    return Cells(run, None if small and own.isEmpty() else own, few and small)


def with_inverse(m: DataFrame) -> DataFrame:
    nxt = {1: 2, 2: 3, 3: 1}

    def cof(i, j):
        i1, j1 = nxt[i], nxt[j]
        return f"(h{i1}{j1} * h{nxt[i1]}{nxt[j1]} - h{i1}{nxt[j1]} * h{nxt[i1]}{j1})"

    m = m.selectExpr("*", f"nullif(h11 * {cof(1, 1)} + h12 * {cof(1, 2)} + h13 * {cof(1, 3)}, 0D) AS det")
    m = m.selectExpr("*", *[f"{cof(j, i)} / det AS g{i}{j}" for i in AXES for j in AXES], "abs(det) AS vol").drop("det")
    # The area between two lattice vectors is the length of a row of the inverse (a column of it, for vectors as columns) times the volume.
    root = lambda parts: f"1 / sqrt({' + '.join(f'{p} * {p}' for p in parts)})"
    return m.selectExpr("*", *[f"{root([f'g{k}{i}' for k in AXES])} AS t{i}" for i in AXES], *[f"{root([f'g{i}{k}' for k in AXES])} AS u{i}" for i in AXES])


def wrapped(s: Vec, center: tuple[float, float, float] = (0.5, 0.5, 0.5), eps: float = 1e-7, pbc=(True, True, True)) -> Vec:
    """Fractions moved into the cell around the center, along the periodic axes."""
    out = []
    for c, m, p in zip(s, center, pbc, strict=True):
        shift = m - 0.5 - eps
        out.append(F.pmod(c - shift, F.lit(1.0)) + shift if p else c)
    return tuple(out)
