"""Extended XYZ: reader (every header form) and writer; CP2K side files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moltide.operators.parse_faults import STRETCH, block_starts, cell_numbers, cell_text, fields, judged, number, placed
from moltide.session import exists
from moltide.sources.text_lines import numbered, selected


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line_id, file_id, line_no, raw_line): numbered lines as the fault finder takes them; line_no from 1."""
    n = numbered(spark, path)
    return n.select(F.xxhash64("file", "no").alias("line_id"), F.col("file").alias("file_id"), (F.col("no") + 1).alias("line_no"), F.col("value").alias("raw_line"))


def header_number(header: Column, *keys: str) -> Column:
    """The number behind the first of the keys that stands in a header; a comma or unit after it is no part of it."""
    one = lambda k: number(F.nullif(F.regexp_extract(header, rf'(?i)(?<![A-Za-z0-9_]){k}\s*[=:]\s*"?([^\s",;]+)', 1), F.lit("")))
    return F.coalesce(*[one(k) for k in keys])


def frame_numbers(starts: DataFrame) -> DataFrame:
    """(file_id, block, frame): dense frame numbers; counted inside stretches, then over one row per stretch."""
    per = starts.groupBy("file_id", "k").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("file_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("file_id", "k").orderBy("line_no")) - 1
    return starts.withColumn("own", own).join(per.select("file_id", "k", before.alias("before")), ["file_id", "k"]).select("file_id", F.col("line_no").alias("block"), (F.col("own") + F.col("before")).cast("int").alias("frame"))


def read_extxyz(spark: SparkSession, path: str | list[str], index=":", timestep: float | None = None, cell=None, elements: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(atoms, frames) of one or more files.

    atoms: run_id (file), frame, at_idx, symb, x, y, z. frames: run_id, frame, t_fs, energy, natoms, lattice (9 numbers or null).
    A frame's own cell wins over the fallback `cell` (9 or 3 numbers); the time is the header's, else frame * timestep
    (1 fs if not given). Lines that fail to parse are left out (judged() in parse_faults tells why; pass elements to check symbols too).
    """
    text = lines(spark, path)
    if text.isEmpty():
        raise ValueError(f"no lines in {path}")
    at = placed(text)
    nums = frame_numbers(block_starts(text))
    pick = selected(nums.withColumnRenamed("file_id", "run_id"), index).withColumnRenamed("run_id", "file_id")
    keep = nums.join(pick, ["file_id", "frame"]).select("file_id", "block", F.col("frame").alias("source_frame"), F.col("new").cast("int").alias("frame"))
    f = fields(F.col("raw_line"))
    get = lambda i: F.get(f, i)
    body = at.where((F.col("role") >= 2) & (F.size(f) == F.col("want")))
    if elements is not None:
        body = body.join(judged(text, elements), "line_id", "left_anti")
    atoms = body.select("file_id", "block", (F.col("role") - 2).cast("int").alias("at_idx"), get(F.col("s") - 1).alias("symb"), *[number(get(F.col("p") - 1 + i)).alias(c) for i, c in enumerate("xyz")])
    atoms = atoms.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()).join(keep, ["file_id", "block"]).select(F.col("file_id").alias("run_id"), "frame", "at_idx", "symb", "x", "y", "z")
    own = cell_numbers(cell_text(F.col("raw_line")))
    if cell is not None:
        flat = [float(v) for row in cell for v in (row if hasattr(row, "__len__") else [row])]
        flat = flat if len(flat) == 9 else [flat[0], 0, 0, 0, flat[1], 0, 0, 0, flat[2]]
        own = F.coalesce(own, F.array(*[F.lit(float(v)) for v in flat]))
    head = at.where(F.col("role") == 1)
    count = at.where(F.col("role") >= 2).groupBy("file_id", "block").agg(F.count("*").cast("int").alias("natoms"))
    frames = head.join(keep, ["file_id", "block"]).join(count, ["file_id", "block"], "left").select(
        F.col("file_id").alias("run_id"), "frame", "source_frame",
        F.coalesce(header_number(F.col("raw_line"), "time", "t"), F.col("source_frame") * float(timestep or 1.0)).alias("t_fs"),
        header_number(F.col("raw_line"), "energy", "e").alias("energy"), F.coalesce("natoms", F.lit(0)).alias("natoms"), own.alias("lattice"),
    )
    return atoms, frames


def free_path(spark: SparkSession, path: str) -> str:
    """The path itself, or with -1, -2, ... before its ending: nothing is overwritten. Any storage that Spark reaches."""
    if not exists(spark, path):
        return path
    base, end = os.path.splitext(path)
    i = 1
    while exists(spark, f"{base}-{i}{end}"):
        i += 1
    return f"{base}-{i}{end}"


def printable(value: Column, digits: int) -> Column:
    """The double to print with so many decimals: format_string rounds the shortest decimal half up, C (and SQL) the exact binary value half to even.

    A value near the middle of two decimals is moved to the side where its exact value belongs. The comparison is exact: a factor of 26 bits
    and one of at most 19 give products without rounding. Of 1e15 units of the last decimal or more, values stay as they are.
    """
    a = F.abs(value)
    y = a * 10.0**digits
    k = F.floor(y).cast("double")
    c = a * 134217729.0
    high = c - (c - a)
    beyond = (high * 5.0**digits - (k * 2.0 + 1.0) / 2.0 ** (digits + 1)) + (a - high) * 5.0**digits
    up = (beyond > 0) | ((beyond == 0) & (k % 2.0 == 1.0))
    step = F.signum(value) * (0.3 * 10.0**-digits)
    return F.when((y < 1e15) & (F.abs(y - k - 0.5) < 0.2), value + F.when(up, step).otherwise(-step)).otherwise(value)


def printed(value: Column, digits: int) -> Column:
    """The text of a double with so many decimals, null for null; nan, inf and -inf as C prints them."""
    odd = F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
    return F.when(value.isNotNull(), F.coalesce(odd, F.format_string(f"%.{digits}f", printable(value, digits))))


def extxyz_lines(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """(run_id, frame, line, value): the lines of the extended XYZ form, with forces and velocities if the atoms have fx.. and vx.. columns."""
    extra = [v for v in ("f", "v") if all(v + c in atoms.columns for c in "xyz")]
    kinds = "species:S:1:pos:R:3" + "".join({"f": ":forces:R:3", "v": ":velocities:R:3"}[v] for v in extra)
    cols = ["x", "y", "z", *[v + c for v in extra for c in "xyz"]]
    body = atoms.select("run_id", "frame", (F.col("at_idx") + 2).alias("line"), F.concat(F.rpad("symb", 3, " "), F.format_string("%18.8f" * len(cols), *[printable(F.col(c).cast("double"), 8) for c in cols])).alias("value"))
    count = atoms.groupBy("run_id", "frame").agg(F.count("*").alias("n"))
    cell = F.concat(F.lit('Lattice="'), F.array_join(F.transform("lattice", lambda v: printed(v, 8)), " "), F.lit('" '))
    head = F.concat(
        F.coalesce(cell, F.lit("")), F.lit(f"Properties={kinds} frame="), F.col("frame").cast("string"), F.coalesce(F.concat(F.lit(" time="), printed(F.col("t_fs"), 3)), F.lit("")),
        F.coalesce(F.concat(F.lit(" energy="), printed(F.col("energy"), 8)), F.lit("")),
    )
    f = frames.join(count, ["run_id", "frame"])
    return body.unionByName(f.select("run_id", "frame", F.lit(0).alias("line"), F.col("n").cast("string").alias("value"))).unionByName(f.select("run_id", "frame", F.lit(1).alias("line"), head.alias("value")))


def write_extxyz(atoms: DataFrame, frames: DataFrame, path: str) -> str:
    """Write a directory of text parts whose names sort in frame order; returns the path used. Atoms must be numbered densely."""
    path = free_path(atoms.sparkSession, path)
    extxyz_lines(atoms, frames).repartitionByRange("run_id", "frame").sortWithinPartitions("run_id", "frame", "line").select("value").write.text(path)
    return path


def read_cell_file(spark: SparkSession, path: str) -> DataFrame:
    """(frame, lattice) of a cell side file: rows of step, time, nine numbers, volume, or of three lengths. frame is null for a single row: it holds for all."""
    n = numbered(spark, path)
    t = n.where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select("no", fields(F.col("value")).alias("f"))
    v = lambda i: number(F.get("f", i))
    zero = F.lit(0.0)
    cell = F.when(F.size("f") >= 11, F.array(*[v(i) for i in range(2, 11)])).when(F.size("f") == 3, F.array(v(0), zero, zero, zero, v(1), zero, zero, zero, v(2)))
    # Comments may stand between rows: rows are numbered among themselves, inside stretches first.
    rows = t.where(cell.isNotNull()).select(F.lit(0).alias("file_id"), F.floor(F.col("no") / STRETCH).alias("k"), F.col("no").alias("line_no"), cell.alias("lattice"))
    rows = rows.join(frame_numbers(rows).select(F.col("block").alias("line_no"), "frame"), "line_no").select("lattice", "frame")
    one = rows.limit(2).count() == 1
    return rows.select(F.lit(None).cast("int").alias("frame") if one else F.col("frame"), "lattice")


def with_side_files(atoms: DataFrame, frames: DataFrame, cell_path: str | None = None, frc_path: str | None = None, vel_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells, forces and velocities of side files joined by frame (and atom); what a side file lacks stays null."""
    spark = atoms.sparkSession
    if cell_path:
        c = read_cell_file(spark, cell_path)
        if c.first() and c.first()["frame"] is None:
            frames = frames.withColumn("lattice", F.coalesce("lattice", F.array(*[F.lit(x) for x in c.first()["lattice"]])))
        else:
            frames = frames.join(c.select(F.col("frame").alias("source_frame"), F.col("lattice").alias("side")), "source_frame", "left").withColumn("lattice", F.coalesce("lattice", "side")).drop("side")
    for p, name in ((frc_path, "f"), (vel_path, "v")):
        if p:
            side, _ = read_extxyz(spark, p)
            back = frames.select("run_id", "frame", "source_frame")
            s = side.select(F.col("frame").alias("source_frame"), "at_idx", *[F.col(c).alias(name + c) for c in "xyz"])
            atoms = atoms.join(back, ["run_id", "frame"]).join(s, ["source_frame", "at_idx"], "left").drop("source_frame")
    return atoms, frames


__all__ = ["extxyz_lines", "free_path", "lines", "read_cell_file", "read_extxyz", "with_side_files", "write_extxyz"]
