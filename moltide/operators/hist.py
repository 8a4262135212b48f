"""Histograms with equal bins: half-open, the last closed, values out of range dropped, empty bins kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(value: Column, lo: float, hi: float, n: int) -> Column:
    """0-based bin, null out of range (and for null and NaN)."""
    if not (hi > lo and n > 0):
        raise ValueError("a histogram needs hi > lo and at least one bin")
    i = F.least(F.floor((value - lo) / (hi - lo) * n), F.lit(n - 1)).cast("int")
    return F.when((value >= lo) & (value <= hi), i)


def axis(spark, lo: float, hi: float, n: int) -> DataFrame:
    w = (hi - lo) / n
    return spark.range(n).select(F.col("id").cast("int").alias("bin"), (lo + F.col("id") * w).alias("lo"), (lo + (F.col("id") + 1) * w).alias("hi"), (lo + (F.col("id") + 0.5) * w).alias("x"))


def histogram(df: DataFrame, value: Column, lo: float, hi: float, n: int, *keys: str) -> DataFrame:
    """(keys, bin, lo, hi, x, count) with every bin of every key that has rows. Counts combine before the shuffle."""
    counted = df.select(*keys, bin_of(value, lo, hi, n).alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("count"))
    if not keys:
        return axis(df.sparkSession, lo, hi, n).join(F.broadcast(counted.where(F.col("bin").isNotNull())), "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    # At most n counts a key: they fill the axis in one step, and the rows before are read once.
    filled = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "count")))).alias("m"))
    w = (hi - lo) / n
    return filled.selectExpr(*keys, f"explode(sequence(0, {n - 1})) AS bin", "m").selectExpr(*keys, "bin", f"{lo}D + bin * {w!r}D AS lo", f"{lo}D + (bin + 1) * {w!r}D AS hi", f"{lo}D + (bin + 0.5D) * {w!r}D AS x", "coalesce(m[bin], 0L) AS count")


def heatmap(df: DataFrame, x: Column, y: Column, nx: int, ny: int) -> DataFrame:
    """histogram2d() over the range of the data, found in a first pass; nulls and NaN count nowhere."""
    v = df.select(x.alias("x"), y.alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    s = v.agg(*[f(c).alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max))]).first()
    span = lambda lo, hi, n: (0.0, 1.0, n) if lo is None else (lo, hi, n) if hi > lo else (lo - 0.5, lo + 0.5, n)
    return histogram2d(v, F.col("x"), F.col("y"), span(s["x0"], s["x1"], nx), span(s["y0"], s["y1"], ny))


def histogram2d(df: DataFrame, x: Column, y: Column, rx: tuple[float, float, int], ry: tuple[float, float, int]) -> DataFrame:
    """(bin_x, bin_y, x, y, count) of the cells that hold values."""
    mid = lambda b, r: r[0] + (F.col(b) + 0.5) * ((r[1] - r[0]) / r[2])
    c = df.select(bin_of(x, *rx).alias("bin_x"), bin_of(y, *ry).alias("bin_y")).where(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull()).groupBy("bin_x", "bin_y").agg(F.count("*").alias("count"))
    return c.select("bin_x", "bin_y", mid("bin_x", rx).alias("x"), mid("bin_y", ry).alias("y"), "count")
