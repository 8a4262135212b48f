"""The front door: a trajectory handle over a DataFrame of atoms and one of frames."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltide.functions import geom
from moltide.functions.lattice import formula_atoms
from moltide.operators import select as S
from moltide.session import exists, listed
from moltide.sources import lammps, text_lines, xyz


def resolve(spark: SparkSession, path: str) -> dict[str, str | None]:
    """The files of a path: a dump with its data file, or an XYZ file with its cell, force and velocity side files. Names decide in sorted order."""
    found: dict[str, str | None] = dict.fromkeys(("dump", "data", "xyz", "cell", "frc", "vel"))
    names = listed(spark, path)
    if names is not None and not any(os.path.basename(n).startswith("part-") for n in names):
        first = lambda *ends: next((n for n in names if n.endswith(ends)), None)
        found |= {"dump": first(".lammpstrj", ".dump", ".lammps"), "data": first(".data"), "cell": first(".cell"), "frc": first("frc-1.xyz"), "vel": first("vel-1.xyz"), "xyz": next((n for n in names if n.endswith(".xyz") and not n.endswith(("frc-1.xyz", "vel-1.xyz"))), None)}
        if not (found["dump"] and found["data"]) and found["xyz"]:
            found["dump"] = None
        if not (found["dump"] or found["xyz"]):
            raise FileNotFoundError(f"no trajectory in {path}")
    elif path.endswith((".lammpstrj", ".dump", ".lammps")):
        sibling = os.path.splitext(path)[0] + ".data"
        found |= {"dump": path, "data": sibling if exists(spark, sibling) else None}
    else:
        found["xyz"] = path
    return found


@dataclass(frozen=True)
class Trajectory:
    """Immutable: every method gives a new handle. timestep in fs."""

    atoms: DataFrame
    frames: DataFrame
    timestep: float = 5.0
    wrapped: bool = False

    @classmethod
    def from_path(cls, spark: SparkSession, path: str, index=":", timestep: float = 5.0, cell=None, cell_path: str | None = None, frc_path: str | None = None, vel_path: str | None = None) -> Trajectory:
        f = resolve(spark, path)
        if f["dump"]:
            atoms, frames = lammps.read_lammps(spark, f["dump"], f["data"], index, timestep)
        else:
            atoms, frames = xyz.read_extxyz(spark, f["xyz"], index, timestep, cell)
            atoms, frames = xyz.with_side_files(atoms, frames, cell_path or f["cell"], frc_path or f["frc"], vel_path or f["vel"])
        return cls(atoms, frames, timestep)

    @classmethod
    def from_dataframe(cls, atoms: DataFrame, frames: DataFrame, timestep: float = 1.0, columns: dict[str, str] | None = None, cell=None, basis: str = "Cartesian") -> Trajectory:
        """Atoms under other column names; a cell (3 rows) overrides those of the frames, and then forces, velocities and energy are left out.

        basis "Fractional": positions are fractions of the cell.
        """
        a = atoms.withColumnsRenamed(columns or {})
        if cell is not None:
            frames = frames.withColumn("lattice", F.array(*[F.lit(float(v)) for row in cell for v in row])).withColumn("energy", F.lit(None).cast("double"))
            a = a.drop(*[v + c for v in "fv" for c in "xyz"])
        if basis not in ("Cartesian", "Fractional"):
            raise ValueError(f"basis is Cartesian or Fractional, not {basis!r}")
        if basis == "Fractional":
            r = geom.to_cart(geom.v(""))
            on = geom.frame_cells(frames).on(a, *geom.CELL)
            a = on.select(*[r["xyz".index(c)].alias(c) if c in ("x", "y", "z") else F.col(c) for c in a.columns])
        return cls(a, frames, timestep)

    @classmethod
    def from_memory(cls, spark: SparkSession, symbols: str | list[str], positions, cell=None, timestep: float = 1.0, forces=None, velocities=None, energy: float | None = None) -> Trajectory:
        """One frame, or several of the same atoms, of Cartesian positions; symbols may be a formula. forces, velocities (columns
        fx.., vx..) are shaped as the positions; energy is that of every frame."""
        names = formula_atoms(symbols) if isinstance(symbols, str) else list(symbols)
        if positions and not hasattr(positions[0][0], "__len__"):
            positions = [positions]
        for p in positions:
            if len(p) != len(names):
                raise ValueError("as many positions as symbols are needed")
        extra = {k: v if not v or hasattr(v[0][0], "__len__") else [v] for k, v in (("f", forces), ("v", velocities)) if v is not None}
        more = lambda f, i: [float(x) for v in extra.values() for x in v[f][i]]
        rows = [("memory", f, i, s, *map(float, r), *more(f, i)) for f, p in enumerate(positions) for i, (s, r) in enumerate(zip(names, p, strict=True))]
        flat = None if cell is None else [float(v) for row in cell for v in row]
        return cls(
            spark.createDataFrame(rows, "run_id string, frame int, at_idx int, symb string, x double, y double, z double" + "".join(f", {k}{c} double" for k in extra for c in "xyz")),
            spark.createDataFrame([("memory", f, f * timestep, energy, len(names), flat) for f in range(len(positions))], "run_id string, frame int, t_fs double, energy double, natoms int, lattice array<double>"),
            timestep,
        )

    def __getitem__(self, index) -> Trajectory:
        """Frames by number, list or slice, densely renumbered; a slice multiplies the time step by its step."""
        pick = text_lines.selected(self.frames, index)
        def renumber(d):
            new = pick.select("run_id", "frame", F.col("new").cast("int").alias("new"))
            return d.join(new, ["run_id", "frame"]).drop("frame").withColumnRenamed("new", "frame").select(*d.columns)

        step = index.step or 1 if isinstance(index, slice) else 1
        return replace(self, atoms=renumber(self.atoms), frames=renumber(self.frames), timestep=self.timestep * step)

    def cells(self) -> geom.Cells:
        return geom.frame_cells(self.frames)

    def calib(self) -> Trajectory:
        return replace(self, atoms=S.calib(self.atoms))

    def wrap2box(self, center=(0.5, 0.5, 0.5), eps: float = 1e-7) -> Trajectory:
        return replace(self, atoms=S.wrap(self.atoms, self.cells(), center, eps), wrapped=True)

    def unwrapped(self) -> DataFrame:
        """The atoms for displacements; wrapped positions are refused."""
        if self.wrapped:
            raise ValueError("displacements need unwrapped positions")
        return self.atoms

    def write(self, path: str = "trajectory.xyz") -> str:
        return xyz.write_extxyz(self.atoms, self.frames, path)
