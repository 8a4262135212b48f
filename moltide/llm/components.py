"""Pairwise matches become groups (problem 4): deterministic Boruvka hooking over tables.

Each round, every component selects its smallest outgoing edge and points to the component at its other
end; of two components that chose the same edge the smaller becomes the root. Pointer doubling collapses the
trees to stars, edges are relabelled by the roots, loops and repeats drop out, and the next round begins, until
no edge remains. Components at least halve each round, so there are at most log2(n) rounds.

Each round's pointers are written to the shared folder, which cuts the lineage; nothing is collected
but counts. Selecting an edge is a minimum, which combines before the shuffle. A component with very many
edges would make the relabelling join lopsided: such components (more than a thousandth of all edge ends, so
at most a thousand of them) are looked up from a broadcast table of that bound, all others by a shuffle.

Defined results: edges with a null end, with an end that is no known id, or from an id to itself link
nothing; edges may repeat in any direction; ids delivered twice count once; null ids are left out; an id without
edge is its own group. Empty tables give one group per id, or nothing. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltide.session import written

#: The most components a hot table can hold: each has more than 1/HOT of all edge ends.
HOT = 1000
#: Below this number of edge ends no component counts as hot.
HOT_LEAST = 100_000


def _double(p: DataFrame) -> DataFrame:
    """Every pointer (u, p) moved to its target's target; a root points to itself."""
    q = p.select(F.col("u").alias("p"), F.col("p").alias("pp"))
    return p.join(q, "p").select("u", F.col("pp").alias("p"))


def _relabel(edges: DataFrame, end: str, to: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Replace one end of the edges by the root it points to."""
    look = to.select(F.col("u").alias(end), F.col("p").alias("root"))
    other = "b" if end == "a" else "a"
    if hot is None:
        return edges.join(look, end).select(F.col("root").alias(end), other)
    few = F.broadcast(look.join(F.broadcast(hot.select(F.col("u").alias(end))), end, "left_semi"))
    rest = edges.join(F.broadcast(hot.select(F.col("u").alias(end))), end, "left_anti")
    return edges.join(few, end).select(F.col("root").alias(end), other).unionByName(rest.join(look, end).select(F.col("root").alias(end), other))


def _distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, group_id) for each distinct id: the smallest id linked to it. ids: (id); edges: (a, b)."""
    ids = ids.where(F.col("id").isNotNull()).select("id").distinct()
    known = lambda c: ids.select(F.col("id").alias(c))
    e = _distinct_edges(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b").where(F.col("a") != F.col("b")))
    e = written(e.join(known("a"), "a", "left_semi").join(known("b"), "b", "left_semi"), "edges")
    rounds: list[DataFrame] = []
    while n := e.count():
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        chosen = written(both.groupBy("u").agg(F.min(F.struct(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))).alias("m"), F.count("*").alias("degree")).select("u", F.when(F.col("m.lo") == F.col("u"), F.col("m.hi")).otherwise(F.col("m.lo")).alias("p"), "degree"), "chosen")
        back = chosen.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        # Two that chose each other chose the same edge: the smaller is the root.
        p = chosen.join(back, "p").select("u", F.when((F.col("pp") == F.col("u")) & (F.col("u") < F.col("p")), F.col("u")).otherwise(F.col("p")).alias("p"))
        while True:
            p = written(_double(_double(p)), "pointers")
            roots = p.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            if not p.join(roots, "p").where(F.col("p") != F.col("pp")).limit(1).count():
                break
        rounds.append(p)
        hot = chosen.where(F.col("degree") > 2 * n / HOT).select("u") if 2 * n > HOT_LEAST else None
        e = written(_distinct_edges(_relabel(_relabel(e, "a", p, hot), "b", p, hot)), "edges")
    if not rounds:
        return ids.select("id", F.col("id").alias("group_id"))
    final = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        later = final.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        final = earlier.join(later, "p", "left").select("u", F.coalesce("pp", "p").alias("p"))
    if len(rounds) > 1:
        final = written(final, "roots")
    # The smallest member names the group; a minimum combines before the shuffle, and the names are one row per group.
    names = final.groupBy("p").agg(F.min("u").alias("group_id"))
    named = final.join(names, "p").select(F.col("u").alias("id"), "group_id")
    return ids.join(named, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))
