"""Numbered lines (or records) of text files of any size, read in parallel splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(spark: SparkSession, path: str | list[str], line_sep: str | None = None) -> DataFrame:
    """(file, no, value): every line with its number in its file, from 0.

    Splits are numbered by their place in the file; one small row per split (lines in it, first id) gives each its
    offset. The two reads plan the same splits, as these depend on the files alone.
    """
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    t = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    parts = t.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("file", "block", (before - F.col("first")).alias("offset"))
    return t.join(parts, ["file", "block"]).select("file", (F.col("id") + F.col("offset")).alias("no"), "value")


def chosen(index) -> tuple[str, object]:
    """A frame selection as ('all', None), ('slice', slice) or ('list', [numbers]); negative numbers count from the end."""
    if index is None or isinstance(index, str) and index.strip() in (":", "all"):
        return "all", None
    if isinstance(index, str):
        parts = [int(p) if p.strip() else None for p in index.split(":")]
        return ("list", parts) if len(parts) == 1 else ("slice", slice(*parts))
    if isinstance(index, slice):
        return "slice", index
    if isinstance(index, int):
        return "list", [index]
    return "list", [int(i) for i in index]


def selected(frames: DataFrame, index, run: str = "run_id") -> DataFrame:
    """(run, frame, new): the frames of a selection with their dense numbers. An int outside of a record raises IndexError."""
    kind, what = chosen(index)
    f = frames.select(run, "frame").distinct()
    if kind == "all":
        return f.withColumn("new", F.col("frame"))
    negative = kind == "list" and any(i < 0 for i in what) or kind == "slice" and any(i is not None and i < 0 for i in (what.start, what.stop))
    if negative or kind == "list":
        n = f.groupBy(run).agg((F.max("frame") + 1).alias("n"))
        f = f.join(n, run)
    if kind == "list":
        if isinstance(index, int):
            low = f.agg(F.min("n")).first()[0] or 0
            if not -low <= index < low:
                raise IndexError(f"frame {index} of {low}")
        rows = frames.sparkSession.createDataFrame(list(enumerate(what)), "new int, wanted int")
        return f.join(F.broadcast(rows), F.col("frame") == F.when(F.col("wanted") < 0, F.col("n") + F.col("wanted")).otherwise(F.col("wanted"))).select(run, "frame", "new")
    step = what.step or 1
    if step < 1:
        raise ValueError("frame slices go forward")
    at = lambda v: F.greatest(F.col("n") + v, F.lit(0)) if v < 0 else F.lit(v)
    start = at(what.start or 0)
    keep = (F.col("frame") >= start) & ((F.col("frame") - start) % step == 0)
    if what.stop is not None:
        keep = keep & (F.col("frame") < at(what.stop))
    return f.where(keep).select(run, "frame", ((F.col("frame") - start) / step).cast("int").alias("new"))
