"""Repeated consecutive events in sequences collapse into one record with count and span (problem 5).

Adjacent agglomeration: the records of an entity, in order, form a linked list; a priority queue holds the
pairs of neighbours; the most similar pair merges first, until no pair meets the similarity and gap limits.
The similarity of two runs is the share of the contacts that any of their records has that all of them have (for two
records the Jaccard similarity). A run is held as these two sets, so a merge costs their size, whatever the run's
length. Merging never raises it, so two neighbouring records below the limit can never come into one run: they are
barriers at which a sequence falls into independent pieces. Equal sets (similarity 1) always merge first.

Sequences of any length are worked in two levels. Stretches of STRETCH frames are agglomerated first. At an end
of a stretch the neighbour is not known, so a pair there is left as it is, and so is every pair that would come after it
because of a run of its own: what does merge is what would merge in the whole sequence (of equally similar pairs
with equal gaps a hash of the place decides, so that such chains stay short). The runs that are left are cut at the
barriers and agglomerated across the ends of stretches. A task sees a stretch, or a piece between two barriers.

Defined results: a record without list (null in both list columns) is a barrier and belongs to no run;
rows without stream, frame or id are left out; records delivered twice (equal id) count once; records of one
frame follow each other by id; an empty list is the empty set, equal only to itself (similarity 0 to others).
Atom numbers are whole numbers below 2^63. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moltide.operators.grouped import group_ids, map_groups
from moltide.operators.parse_faults import let
from moltide.session import written

STRETCH = 4096


def contacts(dimers: DataFrame) -> DataFrame:
    """(stream_id, frame, dimer_id, items): the set of contacts of each record as sorted texts, null for a lost list.

    All numbers of a list in order, cut into twos (pairs, in any order of their atoms) or threes (donor and
    acceptor of a triple); so nesting and spacing play no part.
    """
    numbers = lambda c: F.transform(F.regexp_extract_all(F.col(c), F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("long"))

    def cut(c, size, make):
        return let(numbers(c), lambda n: F.transform(F.slice(n, F.lit(1), F.ceil(F.size(n) / size).cast("int")), lambda _, i: make(F.get(n, i * size), F.get(n, i * size + size - 1))))

    pair = cut("pairs", 2, lambda a, b: F.concat_ws("-", F.least(a, b).cast("string"), F.greatest(a, b).cast("string")))
    triple = cut("d_h_a_pairs", 3, lambda d, a: F.concat_ws(">", d.cast("string"), a.cast("string")))
    items = F.coalesce(F.when(F.col("pairs").isNotNull(), pair), F.when(F.col("d_h_a_pairs").isNotNull(), triple))
    return (
        dimers.where(F.col("stream_id").isNotNull() & F.col("frame").isNotNull() & F.col("dimer_id").isNotNull())
        .select("stream_id", F.col("frame").cast("long").alias("frame"), "dimer_id", F.array_sort(F.array_distinct(items)).alias("items"))
    )


def similarity(a: tuple, b: tuple) -> float:
    """Of two runs (contacts of all their records, contacts of any of them)."""
    if a == b and a[0] == a[1]:
        return 1.0
    return len(a[0] & b[0]) / max(len(a[1] | b[1]), 1)


def agglomerate(sets: list, first: np.ndarray, last: np.ndarray, gid: np.ndarray, limit: float, max_gap: int | None, closed: bool = True) -> tuple[list[list[int]], list]:
    """(members of each run as places in the input, its two sets), in order.

    sets: (contacts of all, contacts of any) or a frozenset of a record, None for a barrier; rows sorted by group and order.
    A linked list of runs and a priority queue of neighbouring pairs: most similar first, then the shortest gap, then by a hash
    of the place. closed=False: a group may go on beyond its ends, and what depends on that is left.
    """
    n = len(sets)
    members: list = [[i] for i in range(n)]
    kinds: list = [s if s is None or isinstance(s, tuple) else (s, s) for s in sets]
    prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
    lo, hi, alive, version, fixed = list(map(int, first)), list(map(int, last)), [True] * n, [0] * n, [False] * n
    if not closed and n:
        edge = np.flatnonzero(np.diff(gid)).tolist()
        for i in (0, n - 1, *edge, *(e + 1 for e in edge)):
            fixed[i] = True
    queue: list = []

    def offer(i):
        j = nxt[i]
        if j < 0 or gid[i] != gid[j] or kinds[i] is None or kinds[j] is None:
            return
        gap = lo[j] - hi[i]
        if max_gap is not None and gap > max_gap:
            return
        s = similarity(kinds[i], kinds[j])
        if s >= limit:
            heapq.heappush(queue, (-s, gap, lo[j] * 0x9E3779B97F4A7C15 >> 7 & 0xFFFFFFFF, i, version[i], version[j]))

    for i in range(n):
        offer(i)
    while queue:
        s, _, _, i, vi, vj = heapq.heappop(queue)
        j = nxt[i]
        if not alive[i] or j < 0 or version[i] != vi or version[j] != vj:
            continue
        # Equal sets merge in any order; others wait for what lies beyond an end.
        if s > -1.0 and (fixed[i] or fixed[j]):
            fixed[i] = fixed[j] = True
            continue
        members[i].extend(members[j])
        kinds[i] = kinds[i] if s == -1.0 else (kinds[i][0] & kinds[j][0], kinds[i][1] | kinds[j][1])
        hi[i], alive[j], fixed[i] = hi[j], False, fixed[i] or fixed[j]
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prev[nxt[j]] = i
        version[i] += 1
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    return [members[i] for i in range(n) if alive[i]], [kinds[i] for i in range(n) if alive[i]]


RUN = "stream_id {t}, {g} long, first_frame long, last_frame long, n_records long, common array<{i}>, every array<{i}>, lost boolean"


def _runs(pdf: pd.DataFrame, found: tuple[list[list[int]], list], group: str, n: np.ndarray, first: np.ndarray, last: np.ndarray) -> pd.DataFrame:
    runs, kinds = found
    head = [r[0] for r in runs]
    sums = np.add.reduceat(n, head) if head else np.zeros(0, "int64")
    part = lambda k: [[] if x is None else sorted(x[k]) for x in kinds]
    return pd.DataFrame({"stream_id": pdf.stream_id.to_numpy()[head], group: pdf[group].to_numpy()[head], "first_frame": first[head], "last_frame": [last[r[-1]] for r in runs], "n_records": sums, "common": part(0), "every": part(1), "lost": [x is None for x in kinds]})


def _level_one(limit: float, max_gap: int | None):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.drop_duplicates(["stream_id", "stretch", "dimer_id"]).reset_index(drop=True)
        gid, frame = group_ids(p, ["stream_id", "stretch"]), p.frame.to_numpy("int64")
        known: dict = {}
        sets = [None if x is None else known.setdefault(k, frozenset(k)) for x in p["items"] for k in [None if x is None else tuple(x)]]
        return _runs(p, agglomerate(sets, frame, frame, gid, limit, max_gap, closed=False), "stretch", np.ones(len(p), "int64"), frame, frame)

    return run


def _level_two(limit: float, max_gap: int | None):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gid = group_ids(pdf, ["stream_id", "segment"])
        first, last, n = (pdf[c].to_numpy("int64") for c in ("first_frame", "last_frame", "n_records"))
        sets = [(frozenset(a), frozenset(b)) for a, b in zip(pdf.common, pdf.every, strict=True)]
        return _runs(pdf, agglomerate(sets, first, last, gid, limit, max_gap), "segment", n, first, last)

    return run


def runs(records: DataFrame, min_similarity: float = 1.0, max_gap: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """(stream_id, first_frame, last_frame, n_records, n_common, n_contacts): every run, those of one record included.

    n_common counts the contacts that all its records have, n_contacts those that any has. records: (stream_id, frame, dimer_id,
    items) as from contacts(). max_gap None: no gap ends a run. At similarity 1 neighbouring sets are compared by a hash of 64
    bits, and the two counts are null.
    """
    t = dict(records.dtypes)["stream_id"]
    item = "string"
    if min_similarity >= 1:
        records, item = records.withColumn("items", F.when(F.col("items").isNotNull(), F.array(F.xxhash64("items")))), "long"
    cut = records.withColumn("stretch", F.floor(F.col("frame") / stretch).cast("long"))
    one = written(map_groups(cut, ["stream_id", "stretch"], ["frame", "dimer_id"], _level_one(min_similarity, max_gap), RUN.format(t=t, g="stretch", i=item)), "runs")
    order = ["first_frame", "last_frame", "n_records"]
    near = Window.partitionBy("stream_id", "stretch").orderBy(*order)
    shown = F.struct("last_frame", "common", "every", "lost")
    ends = one.groupBy("stream_id", "stretch").agg(F.max_by(shown, F.struct(*order)).alias("closing"))
    whole = Window.partitionBy("stream_id").orderBy("stretch")
    ends = ends.withColumn("before", F.lag("closing").over(whole)).drop("closing")
    j = one.withColumn("own", F.lag(shown).over(near)).join(ends, ["stream_id", "stretch"]).withColumn("p", F.coalesce("own", "before"))
    alike = (F.col("p.common") == F.col("common")) & (F.col("p.every") == F.col("every")) & (F.col("common") == F.col("every"))
    similar = F.when(alike, 1.0).otherwise(F.size(F.array_intersect("p.common", "common")) / F.greatest(F.size(F.array_union("p.every", "every")), F.lit(1)))
    barrier = F.col("p").isNull() | F.col("lost") | F.col("p.lost") | (similar < min_similarity)
    if max_gap is not None:
        barrier = barrier | (F.col("first_frame") - F.col("p.last_frame") > max_gap)
    kept = ["first_frame", "last_frame", "n_records", "common", "every", "lost"]
    j = j.withColumn("barrier", barrier).select("stream_id", "stretch", *kept, F.when(F.col("barrier"), F.col("first_frame")).alias("own_start"))
    # The start of a piece lies in the same stretch, or is the last one of an earlier stretch.
    starts = j.groupBy("stream_id", "stretch").agg(F.max("own_start").alias("s")).withColumn("open", F.last("s", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, -1))).drop("s")
    seg = j.withColumn("in_stretch", F.last("own_start", ignorenulls=True).over(near.rowsBetween(Window.unboundedPreceding, 0))).join(starts, ["stream_id", "stretch"])
    seg = seg.select("stream_id", F.coalesce("in_stretch", "open").alias("segment"), *kept).where(~F.col("lost"))
    two = map_groups(seg, ["stream_id", "segment"], order, _level_two(min_similarity, max_gap), RUN.format(t=t, g="segment", i=item))
    counts = [F.lit(None).cast("long") if item == "long" else F.size(c).cast("long") for c in ("common", "every")]
    return two.select("stream_id", "first_frame", "last_frame", "n_records", counts[0].alias("n_common"), counts[1].alias("n_contacts"))
