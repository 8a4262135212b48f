"""LAMMPS dumps and data files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moltide.functions.elements import MASS
from moltide.operators.parse_faults import fields, number
from moltide.sources.text_lines import numbered, selected


#: Section names and lines of a whole number and a number (with a comment): one per atom type, wherever the section stands.
MASS_LINES = r"^\s*(?:[A-Za-z][A-Za-z ]*(?:#.*)?|\d+\s+[\d.eE+-]+\s*(?:#.*)?)$"


def type_symbols(text: str) -> dict[int, str]:
    """Element of each atom type from the Masses section of a data file: the comment if it names an element, else the nearest mass within 1."""
    out: dict[int, str] = {}
    inside = False
    for line in text.splitlines():
        bare = line.strip()
        if re.match(r"^Masses\b", bare):
            inside = True
        elif inside and bare and not bare[0].isdigit():
            break
        elif inside and (m := re.match(r"^(\d+)\s+([\d.eE+-]+)\s*(?:#\s*(\w+))?", bare)):
            near = min(MASS, key=lambda s: abs(MASS[s] - float(m[2])))
            if m[3] in MASS:
                out[int(m[1])] = m[3]
            elif abs(MASS[near] - float(m[2])) < 1.0:
                out[int(m[1])] = near
    return out


def read_lammps(spark: SparkSession, path: str, data_path: str | None = None, index=":", timestep: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(atoms, frames) of a dump, one record per frame. Atoms are in order of their ids; t_fs = step * timestep, and the step is kept.

    Columns are found by name: element, else the type through the data file, else X<type>; x y z, or xu yu zu, or scaled xs ys zs.
    A triclinic box is given by the bounds that enclose it, from which its own edges are taken.
    """
    kinds = {}
    if data_path:
        kinds = type_symbols("\n".join(r["value"] for r in spark.read.text(data_path).where(F.col("value").rlike(MASS_LINES)).collect()))
    rec = numbered(spark, path, "ITEM: TIMESTEP\n").where(F.trim("value") != "")
    rec = rec.withColumn("lines", F.split("value", r"\r?\n")).drop("value")
    # Text before the first frame makes no record of its own in a dump, so numbers are dense but for a first empty one.
    low = rec.groupBy("file").agg(F.min("no").alias("low"))
    rec = rec.join(low, "file").withColumn("frame", (F.col("no") - F.col("low")).cast("int")).withColumnRenamed("file", "run_id")
    pick = selected(rec.select("run_id", "frame"), index)
    rec = rec.join(pick, ["run_id", "frame"]).withColumnRenamed("frame", "source_frame").withColumn("frame", F.col("new").cast("int"))
    rec = rec.withColumn("step", F.trim(F.get("lines", F.lit(0))).try_cast("long")).withColumn("box", F.transform(F.slice("lines", 5, 3), lambda x: F.transform(fields(x), number))).withColumn("tilted", F.get("lines", F.lit(3)).contains("xy xz yz")).withColumn("names", fields(F.regexp_replace(F.get("lines", F.lit(7)), r"^ITEM: ATOMS", "")))
    b = lambda i, k: F.get(F.get("box", F.lit(i)), F.lit(k))
    zero = F.lit(0.0)
    xy, xz, yz = (F.when(F.col("tilted"), b(i, 2)).otherwise(0.0) for i in range(3))
    lx = b(0, 1) - b(0, 0) - (F.greatest(zero, xy, xz, xy + xz) - F.least(zero, xy, xz, xy + xz))
    ly = b(1, 1) - b(1, 0) - (F.greatest(zero, yz) - F.least(zero, yz))
    lz = b(2, 1) - b(2, 0)
    frames = rec.select("run_id", "frame", "source_frame", "step", (F.col("step") * float(timestep)).alias("t_fs"), F.lit(None).cast("double").alias("energy"), F.trim(F.get("lines", F.lit(2))).try_cast("int").alias("natoms"), F.array(lx, zero, zero, xy, ly, zero, xz, yz, lz).alias("lattice"), (b(0, 0) - F.least(zero, xy, xz, xy + xz)).alias("ox"), (b(1, 0) - F.least(zero, yz)).alias("oy"), b(2, 0).alias("oz"))
    a = rec.select("run_id", "frame", "names", F.explode(F.slice("lines", F.lit(9), F.size("lines"))).alias("line")).where(F.trim("line") != "").withColumn("f", fields(F.col("line")))
    col = lambda n: F.get("f", F.array_position("names", n).cast("int") - 1)
    has = lambda n: F.array_contains("names", n)
    by_type = F.lit(None).cast("string")
    if kinds:
        by_type = F.element_at(F.create_map(*[F.lit(v) for k, s in kinds.items() for v in (k, s)]), col("type").try_cast("int"))
    a = a.withColumn("id", col("id").try_cast("long")).withColumn("symb", F.coalesce(F.when(has("element"), col("element")), F.when(has("type"), F.coalesce(by_type, F.concat(F.lit("X"), col("type"))))))
    for c in "xyz":
        a = a.withColumn(c, F.coalesce(F.when(has(c), number(col(c))), F.when(has(f"{c}u"), number(col(f"{c}u"))))).withColumn(f"s{c}", F.when(has(f"{c}s"), number(col(f"{c}s"))))
    a = a.withColumn("at_idx", (F.row_number().over(Window.partitionBy("run_id", "frame").orderBy("id")) - 1).cast("int"))
    scaled = a.join(frames.select("run_id", "frame", "lattice", "ox", "oy", "oz"), ["run_id", "frame"])
    h = lambda i: F.get("lattice", F.lit(i))
    cart = {"x": F.col("ox") + F.col("sx") * h(0) + F.col("sy") * h(3) + F.col("sz") * h(6), "y": F.col("oy") + F.col("sy") * h(4) + F.col("sz") * h(7), "z": F.col("oz") + F.col("sz") * h(8)}
    atoms = scaled.select("run_id", "frame", "at_idx", "symb", *[F.coalesce(c, cart[c]).alias(c) for c in "xyz"])
    return atoms, frames.drop("ox", "oy", "oz")


__all__ = ["read_lammps", "type_symbols"]
