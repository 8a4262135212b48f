"""Contact records as JSON: sinks and sources of dimers and hydrogen bonds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltide.sources.text_lines import chosen

BOND = "donor: int, hydrogen: int, acceptor: int, `R(D-A)`: double, DHA_ang: double, `r(D-H)`: double"


def hbond_records(bonds: DataFrame, frames: DataFrame) -> DataFrame:
    """(run_id, frame, n_hbonds, hbonds): one record per frame, frames without bonds included. A record holds one frame's bonds."""
    one = F.struct(F.col("a0").alias("donor"), F.col("a1").alias("hydrogen"), F.col("a2").alias("acceptor"), F.col("r_da").alias("R(D-A)"), F.col("angle").alias("DHA_ang"), F.col("r_dh").alias("r(D-H)"))
    g = bonds.groupBy("run_id", "frame").agg(F.array_sort(F.collect_list(one)).alias("hbonds"))
    return frames.select("run_id", "frame").distinct().join(g, ["run_id", "frame"], "left").select("run_id", "frame", F.coalesce(F.size("hbonds"), F.lit(0)).alias("n_hbonds"), F.coalesce("hbonds", F.array().cast(f"array<struct<{BOND}>>")).alias("hbonds"))


def _per_frame(contacts: DataFrame, frames: DataFrame | None, *columns: str) -> DataFrame:
    """(run_id, frame, c): each frame's sorted contacts; with frames, those without any have an empty list."""
    g = contacts.groupBy("run_id", "frame").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("c"))
    if frames is None:
        return g
    none = F.array().cast(dict(g.dtypes)["c"])
    return frames.select("run_id", "frame").distinct().join(g, ["run_id", "frame"], "left").withColumn("c", F.coalesce("c", none))


def dimer_records(contacts: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """(run_id, frame, pairs, dists): one record per frame; always lists of pairs."""
    g = _per_frame(contacts, frames, "a0", "a1", "dist")
    return g.select("run_id", "frame", F.transform("c", lambda c: F.array(c.a0, c.a1)).alias("pairs"), F.transform("c", lambda c: c.dist).alias("dists"))


def hbond_dimer_records(bonds: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """(run_id, frame, d_h_a_pairs, d_a_dists, d_h_a_angles): one record per frame; always lists of triples."""
    g = _per_frame(bonds.withColumnsRenamed({"dist": "r_da"}), frames, "a0", "a1", "a2", "r_da", "angle")
    return g.select("run_id", "frame", F.transform("c", lambda c: F.array(c.a0, c.a1, c.a2)).alias("d_h_a_pairs"), F.transform("c", lambda c: c.r_da).alias("d_a_dists"), F.transform("c", lambda c: c.angle).alias("d_h_a_angles"))


def write_json(records: DataFrame, path: str) -> None:
    records.write.json(path)


def read_hbonds(spark: SparkSession, path: str, index=":") -> DataFrame:
    """Long bonds (run_id, frame, a0, a1, a2, r_da, angle, r_dh) of records; index: all, n for the first n frames, or [from, to]."""
    t = spark.read.schema(f"run_id string, frame int, n_hbonds int, hbonds array<struct<{BOND}>>").json(path)
    if isinstance(index, int):
        t = t.where(F.col("frame") < index)
    elif isinstance(index, (list, tuple)):
        t = t.where((F.col("frame") >= index[0]) & (F.col("frame") < index[1]))
    elif chosen(index)[0] == "slice":
        s = chosen(index)[1]
        t = t.where((F.col("frame") >= (s.start or 0)) & (F.lit(True) if s.stop is None else F.col("frame") < s.stop) & ((F.col("frame") - (s.start or 0)) % (s.step or 1) == 0))
    e = t.select("run_id", "frame", F.explode("hbonds").alias("b"))
    return e.select("run_id", "frame", F.col("b.donor").alias("a0"), F.col("b.hydrogen").alias("a1"), F.col("b.acceptor").alias("a2"), F.col("b.`R(D-A)`").alias("r_da"), F.col("b.DHA_ang").alias("angle"), F.col("b.`r(D-H)`").alias("r_dh"))


def contact_lists(records: DataFrame, keys: list[str], lists: str, size: int) -> DataFrame:
    """Long contacts (keys, a0, a1[, a2]) of JSON lists in text form: nested, flat for one contact, or empty. Repeats come once."""
    n = F.regexp_extract_all(F.col(lists), F.lit(r"\d+"), F.lit(0))
    e = records.where(F.col(lists).isNotNull()).select(*keys, F.explode(F.transform(F.slice(n, F.lit(1), F.floor(F.size(n) / size).cast("int")), lambda _, i: F.struct(*[F.get(n, i * size + k).cast("int").alias(f"a{k}") for k in range(size)]))).alias("c"))
    return e.select(*keys, *[F.col(f"c.a{k}").alias(f"a{k}") for k in range(size)]).distinct()
