"""How long contacts last: continuous survival and the joint distribution of lifetime and displacement.

Frames of a run are counted densely (places). A contact that is there in places p .. e without a gap lives e - p + 1
places from origin p; so lifetimes from every origin come from one pass over each contact's own places, and no
window of frames is ever joined with another one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moltide.functions import geom
from moltide.operators.hist import histogram2d

STRETCH = 4096


def places(frames: DataFrame, key: str) -> DataFrame:
    """(key, frame, place, places): each frame's dense number in its run, and their number.

    Frames are numbered inside stretches; one row per stretch gives what lies before it.
    """
    f = frames.select(key, "frame").distinct().withColumn("k", F.floor(F.col("frame") / STRETCH))
    per = f.groupBy(key, "k").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    before = F.coalesce(F.sum("n").over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(key, "k", before.alias("before"), F.sum("n").over(w).cast("int").alias("places"))
    own = F.row_number().over(Window.partitionBy(key, "k").orderBy("frame")) - 1
    return f.withColumn("own", own).join(per, [key, "k"]).select(key, "frame", (F.col("own") + F.col("before")).cast("int").alias("place"), "places")


def lifetimes(contacts: DataFrame, at: DataFrame, key: str, ids: list[str], sampling: int = 1) -> DataFrame:
    """(key, ids, place, life): from each place at which a contact is seen, how many sampled places in a row it is seen (this one included)."""
    c = contacts.select(key, *ids, "frame").distinct().join(at.select(key, "frame", "place"), [key, "frame"])
    c = c.withColumn("phase", F.col("place") % sampling).withColumn("step", F.floor(F.col("place") / sampling))
    w = Window.partitionBy(key, *ids, "phase")
    # Equal in a run of steps without a gap.
    c = c.withColumn("island", F.col("step") - F.row_number().over(w.orderBy("step")))
    end = F.max("step").over(Window.partitionBy(key, *ids, "phase", "island"))
    return c.select(key, *ids, "place", (end - F.col("step") + 1).cast("int").alias("life"))


def survival(contacts: DataFrame, frames: DataFrame, key: str, ids: list[str], nframes: int, sampling: int = 1, origin_stride: int = 1) -> DataFrame:
    """(key, k, c, error): share of an origin's contacts not yet missed at sampled place k, averaged over origins.

    Origins are the places with a whole window of nframes after them, every origin_stride-th; an origin without
    contacts counts as 0. error: stddev_pop over origins / sqrt(places // nframes).
    """
    at = places(frames, key)
    life = lifetimes(contacts, at, key, ids, sampling)
    origins = at.where((F.col("place") <= F.col("places") - nframes) & (F.col("place") % origin_stride == 0)).select(key, "place", "places")
    total = origins.groupBy(key).agg(F.count("*").alias("origins"), F.first("places").alias("places"))
    last = (nframes - 1) // sampling + 1
    n = life.join(origins.select(key, "place"), [key, "place"], "left_semi").groupBy(key, "place", F.least("life", F.lit(last)).alias("life")).agg(F.count("*").alias("n"))
    # Bounded by the window: an origin has at most `last` lifetimes, then one share for each k.
    per = n.groupBy(key, "place").agg(F.sum("n").alias("initial"), F.collect_list(F.struct("life", "n")).alias("lives"))
    share = per.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(last - 1)))).select(key, "k", (F.aggregate("lives", F.lit(0).cast("long"), lambda s, x: s + F.when(x.life > F.col("k"), x.n).otherwise(F.lit(0))) / F.col("initial")).alias("s"))
    m = share.groupBy(key, "k").agg(F.sum("s").alias("s1"), F.sum(F.col("s") * F.col("s")).alias("s2"))
    grid = total.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(last - 1))))
    j = grid.join(m, [key, "k"], "left")
    mean = F.coalesce("s1", F.lit(0.0)) / F.col("origins")
    var = F.greatest(F.coalesce("s2", F.lit(0.0)) / F.col("origins") - mean * mean, F.lit(0.0))
    return j.select(key, (F.col("k") * sampling).alias("k"), mean.alias("c"), (F.sqrt(var) / F.sqrt(F.floor(F.col("places") / nframes))).alias("error"))


def lifetime_displacement(contacts: DataFrame, centers: DataFrame, cells: geom.Cells | DataFrame | None, key: str, ids: list[str], nframes: int, origin_stride: int = 1) -> DataFrame:
    """(key, ids, place, life, dr): for each contact at each origin that is missed within the window, its lifetime in places and
    the displacement of its center from the origin to the first place it is missed, in the run's first cell. centers: (key, ids, frame, x, y, z)."""
    at = places(centers, key)
    life = lifetimes(contacts, at, key, ids)
    o = life.join(at.where((F.col("place") <= F.col("places") - nframes) & (F.col("place") % origin_stride == 0)).select(key, "place"), [key, "place"]).where(F.col("life") < nframes)
    c = centers.join(at.select(key, "frame", "place"), [key, "frame"]).select(key, *ids, "place", "x", "y", "z")
    first = c.select(key, *ids, "place", *[F.col(a).alias(f"a{a}") for a in "xyz"])
    dead = c.select(key, *ids, F.col("place").alias("gone"), *[F.col(a).alias(f"b{a}") for a in "xyz"])
    j = o.withColumn("gone", F.col("place") + F.col("life")).join(first, [key, *ids, "place"]).join(dead, [key, *ids, "gone"])
    j = j.join(geom.as_cells(cells).run, key) if cells is not None else j
    j = geom.with_images(j, {"d": geom.sub(geom.v("b"), geom.v("a"))}, periodic=cells is not None)
    return j.select(key, *ids, "place", "life", geom.norm(geom.v("d")).alias("dr"))


def dlddf(moved: DataFrame, dt_fs: float, tau: tuple[float, float, int], dr: tuple[float, float, int]) -> DataFrame:
    """(bin_x, bin_y, x, y, count): lifetime in ps against displacement."""
    return histogram2d(moved, F.col("life") * dt_fs / 1000.0, F.col("dr"), tau, dr)
