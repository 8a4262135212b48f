"""The driver's tables as DataFrames, and the parts that the SQL of the queries shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltide.functions import geom
from moltide.functions.elements import elements
from moltide.operators.select import FARTHEST, cleaned


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sound atom record once."""
    return cleaned(table(spark, sf_dir, "atoms"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "frames").where(F.col("run_id").isNotNull() & F.col("frame").isNotNull()).drop("ingested_at").distinct()


def cells(spark: SparkSession, sf_dir: str) -> geom.Cells:
    """The cells of runs and of frames with another one; broadcast if their counted size allows."""
    return geom.frame_cells(table(spark, sf_dir, "frames"))


def symbols(spark: SparkSession, sf_dir: str) -> list[str]:
    """The symbols that occur, known elements only: at most 118."""
    return [r["symb"] for r in table(spark, sf_dir, "atoms").select("symb").distinct().join(F.broadcast(elements(spark).select(F.col("symbol").alias("symb"))), "symb").collect()]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, as sums depend on the order of their terms; no negative zeros."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


AXES = (1, 2, 3)
NEXT = {1: 2, 2: 3, 3: 1}

SQL_ATOMS = f"""a AS (SELECT DISTINCT row_id, run_id, frame, at_idx, symb, x, y, z FROM atoms
    WHERE run_id IS NOT NULL AND frame IS NOT NULL AND at_idx IS NOT NULL AND abs(x) < {FARTHEST} AND abs(y) < {FARTHEST} AND abs(z) < {FARTHEST})"""

_h = [f"m[{3 * (i - 1) + j}] AS h{i}{j}" for i in AXES for j in AXES]


def _cof(i: int, j: int) -> str:
    i1, i2, j1, j2 = NEXT[i], NEXT[NEXT[i]], NEXT[j], NEXT[NEXT[j]]
    return f"(h{i1}{j1} * h{i2}{j2} - h{i1}{j2} * h{i2}{j1})"




def _cells(name: str, source: str) -> str:
    """CTEs that end in one of cells with their inverses and volumes."""
    return f"""{name}1 AS (SELECT * EXCLUDE (m), {", ".join(_h)} FROM {source}),
    {name}2 AS (SELECT *, h11 * {_cof(1, 1)} + h12 * {_cof(1, 2)} + h13 * {_cof(1, 3)} AS det FROM {name}1),
    {name} AS (SELECT *, {", ".join(f"{_cof(j, i)} / det AS g{i}{j}" for i in AXES for j in AXES)}, abs(det) AS vol FROM {name}2)"""


#: cr: the first cell of each run; c: the cell of each frame that has atoms, its own or else the run's first.
SQL_CELLS = f"""lf AS (SELECT run_id, frame, min(lattice) AS m FROM frames WHERE run_id IS NOT NULL AND frame IS NOT NULL AND len(lattice) = 9 GROUP BY ALL),
    lr AS (SELECT run_id, arg_min(m, frame) AS m FROM lf GROUP BY run_id),
    la AS (SELECT fa.run_id, fa.frame, coalesce(lf.m, lr.m) AS m FROM (SELECT DISTINCT run_id, frame FROM a) fa JOIN lr ON lr.run_id = fa.run_id LEFT JOIN lf ON lf.run_id = fa.run_id AND lf.frame = fa.frame),
    {_cells("cr", "lr")},
    {_cells("c", "la")}"""

SQL_BASE = f"{SQL_ATOMS}, {SQL_CELLS}"


def sql_frac(d: tuple[str, str, str], c: str = "c") -> list[str]:
    return [f"({d[0]}) * {c}.g1{j} + ({d[1]}) * {c}.g2{j} + ({d[2]}) * {c}.g3{j}" for j in AXES]


def sql_cart(s, c: str = "c") -> list[str]:
    return [f"({s[0]}) * {c}.h1{j} + ({s[1]}) * {c}.h2{j} + ({s[2]}) * {c}.h3{j}" for j in AXES]


def sql_mic(d, c: str = "c") -> list[str]:
    """The nearest image of a difference, by single half-even rounding."""
    n = [f"round_even({s}, 0)" for s in sql_frac(d, c)]
    return [f"(({x}) - ({y}))" for x, y in zip(d, sql_cart(n, c), strict=True)]


def sql_diff(p: str, q: str) -> tuple[str, str, str]:
    return tuple(f"{q}.{k} - {p}.{k}" for k in "xyz")


def sql_bin(v: str, lo: float, hi: float, n: int) -> str:
    return f"CAST(least(floor(({v} - {lo}) / ({hi} - {lo}) * {n}), {n - 1}) AS INTEGER)"
