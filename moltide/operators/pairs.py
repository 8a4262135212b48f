"""Tuples of atoms: combinations of index groups, candidate pairs of contacts, and neighbours by cell list.

Index groups are the caller's lists and small; their tuples are broadcast. Positions of tuples come from one pass
and one aggregation over the atoms, not from one join per member. All-against-all searches go by grid cells, so
that the pairs grow with the neighbours and not with the square of a frame.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltide.functions import geom
from moltide.operators.select import KEY


def make_comb(a, b) -> list[tuple[int, int]]:
    """Pairs of two selections: number with number, number with list, a list with itself (i < j by position), two
    lists position by position (cut to the shorter), or lists of lists sublist by sublist."""
    one = lambda s: isinstance(s, int) or not hasattr(s, "__len__")
    if one(a) and one(b):
        return [(int(a), int(b))]
    if one(a) or one(b):
        xs, ys = ([a], b) if one(a) else (a, [b])
        return [(int(x), int(y)) for x in xs for y in ys]
    a, b = list(a), list(b)
    if a and b and all(hasattr(s, "__len__") for s in a + b):
        return [p for x, y in zip(a, b, strict=False) for p in zip(map(int, x), map(int, y), strict=False)]
    if a == b:
        return [(int(x), int(y)) for x, y in itertools.combinations(a, 2)]
    return [(int(x), int(y)) for x, y in zip(a, b, strict=False)]


def product(*groups: list[int]) -> list[tuple[int, ...]]:
    """Every combination of the groups' members, those with repeated atoms included."""
    return list(itertools.product(*groups))


def dimer_pairs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Every pair of the two groups once, without an atom and itself and without mirrored pairs."""
    seen, out = set(), []
    for x, y in itertools.product(a, b):
        if x != y and (min(x, y), max(x, y)) not in seen:
            seen.add((min(x, y), max(x, y)))
            out.append((x, y))
    return out


def hbond_triples(donors: list[tuple[int, list[int]]], acceptors: list[int]) -> list[tuple[int, int, int]]:
    """(donor, hydrogen, acceptor) for each donor, each of its hydrogens and each other acceptor, in order."""
    return [(d, h, a) for d, hs in donors for h in hs for a in acceptors if a != d]


def tuples(spark, rows: list[tuple[int, ...]]) -> DataFrame:
    """(tuple_id, a0, a1, ...) of a list of tuples."""
    n = len(rows[0]) if rows else 2
    return spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(rows)], "tuple_id int, " + ", ".join(f"a{k} int" for k in range(n)))


def size_of(tups: DataFrame) -> int:
    return sum(c.startswith("a") and c[1:].isdigit() for c in tups.columns)


def positions(atoms: DataFrame, tups: DataFrame, *carry: str) -> DataFrame:
    """(run_id, frame, tuple_id, a0.., p0x, p0y, p0z, ..): the members' positions; frames lacking a member have no row.

    Number columns to carry come as p0<c>, p1<c>, .. too. A record has one row per atom and frame, so the greatest value is the
    only one; numbers keep the aggregation in generated code.
    """
    n = size_of(tups)
    members = tups.select("tuple_id", F.posexplode(F.array(*[F.col(f"a{k}") for k in range(n)])).alias("role", "at_idx"))
    j = atoms.select(*KEY, "at_idx", "x", "y", "z", *carry).join(F.broadcast(members), "at_idx")
    g = j.groupBy(*KEY, "tuple_id").agg(*[F.max(F.when(F.col("role") == k, F.col(c))).alias(f"p{k}{c}") for k in range(n) for c in ("x", "y", "z", *carry)])
    for k in range(n):
        g = g.where(F.col(f"p{k}x").isNotNull())
    return g.join(F.broadcast(tups), "tuple_id")


def vectors(placed: DataFrame, cells: geom.Cells | DataFrame | None, i: int = 0, j: int = 1, lattice: str = "rows") -> DataFrame:
    """Adds dx, dy, dz from member i to member j; by the nearest image if cells are given."""
    p = geom.as_cells(cells).on(placed, *geom.CELL, *geom.INVERSE) if cells is not None else placed
    d = geom.with_images(p, {"d": geom.sub(geom.v(f"p{j}"), geom.v(f"p{i}"))}, lattice, cells is not None)
    return d.select(*placed.columns, "dx", "dy", "dz")


#: Frames with up to this number of partners have one grid cell: fewer pairs to look at than copies for 27 neighbouring cells.
FEW = 64


def gridded(d: DataFrame, cells: geom.Cells | DataFrame, cutoff: float, lattice: str = "rows", carry: tuple[str, ...] = (), partners: DataFrame | None = None) -> DataFrame:
    """d with its frame's cell, the number of grid cells along each axis (n1, n2, n3) and each atom's own (c1, c2, c3).

    partners: (run_id, frame, partners), the atoms that may be met in each frame; frames without any drop out.
    """
    d = d.select(*KEY, "at_idx", "x", "y", "z", *carry)
    d = d.join(partners, KEY) if partners is not None else d.withColumn("partners", F.lit(FEW + 1))
    t = "t" if lattice == "rows" else "u"
    e = geom.as_cells(cells).on(d, *geom.CELL, *geom.INVERSE, *[f"{t}{k}" for k in (1, 2, 3)])
    e = e.selectExpr(*[c for c in e.columns if c not in ("partners", f"{t}1", f"{t}2", f"{t}3")], *[f"CASE WHEN partners > {FEW} AND {t}{k} / {cutoff}D >= 4 THEN int({t}{k} / {cutoff}D) ELSE 1 END AS n{k}" for k in (1, 2, 3)])
    frac = lambda j: " + ".join(f"{a} * " + (f"g{i}{j}" if lattice == "rows" else f"g{j}{i}") for i, a in zip((1, 2, 3), "xyz", strict=True))
    # Fractions just below a whole number may round up to it: they belong to the first cell.
    return e.selectExpr("*", *[f"CASE WHEN n{k} = 1 THEN 0 ELSE pmod(int(floor(pmod({frac(k)}, 1D) * n{k})), n{k}) END AS c{k}" for k in (1, 2, 3)])


def around(d: DataFrame) -> DataFrame:
    """Gridded rows, copied to each of the cells that may hold partners."""
    for k in (1, 2, 3):
        d = d.withColumn(f"c{k}", F.expr(f"explode(CASE WHEN n{k} = 1 THEN array(0) ELSE array(pmod(c{k} - 1, n{k}), c{k}, pmod(c{k} + 1, n{k})) END)"))
    return d


def neighbours(a: DataFrame, b: DataFrame, cells: geom.Cells | DataFrame, cutoff: float, same: bool, lattice: str = "rows", carry: tuple[str, ...] = ()) -> DataFrame:
    """(run_id, frame, i, j, dist, and the carried columns c as c_i and c_j) with dist <= cutoff by the single-rounding rule; i from a, j from b.

    same: a and b are one set, and each pair comes once (i < j); else i <> j.

    Grid cells are at least cutoff thick, so partners lie in neighbouring cells; an axis that would have three
    cells or fewer has one, as then nothing could be left out, and so have frames with few partners. a is copied to the neighbouring cells; the join is on (run,
    frame, cell), so even a huge frame spreads over many tasks.
    """
    # Counts by frame come without a shuffle where b is partitioned by frames, as cleaned() leaves it.
    partners = b.groupBy(*KEY).agg(F.count("*").alias("partners"))
    # The copied side is narrow; the other one brings the cell.
    left = around(gridded(a, cells, cutoff, lattice, carry, partners).select(*KEY, F.col("at_idx").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"), *[F.col(c).alias(f"{c}_i") for c in carry], "n1", "n2", "n3", "c1", "c2", "c3")).drop("n1", "n2", "n3")
    right = gridded(b, cells, cutoff, lattice, carry, partners).select(*KEY, F.col("at_idx").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"), *[F.col(c).alias(f"{c}_j") for c in carry], *geom.CELL, *geom.INVERSE, "c1", "c2", "c3")
    j = left.join(right, [*KEY, "c1", "c2", "c3"]).where(F.col("i") < F.col("j") if same else F.col("i") != F.col("j"))
    d = geom.with_images(j, {"d": geom.sub(geom.v("b"), geom.v("a"))}, lattice)
    return geom.keep(d.select(*KEY, "i", "j", geom.norm(geom.v("d")).alias("dist"), *[f"{c}_{s}" for c in carry for s in "ij"]), F.col("dist") <= cutoff)


def find_d_a(sites: list[dict[str, int]]) -> tuple[list[dict[str, int]], list[dict[str, int]]]:
    """Donors and acceptors of named sites, by the element of the first key and the number of its hydrogens.

    F first: acceptor. N: one donor per hydrogen (two at most). O with a second O: acceptor. O with one hydrogen: donor.
    O with two: a donor for each, and an acceptor. A lone O is an acceptor. Other sites give neither.
    """
    donors, acceptors = [], []
    for site in sites:
        keys = list(site)
        el = [k.rstrip("0123456789") for k in keys]
        hydrogens = [k for k, e in zip(keys, el, strict=True) if e == "H"]
        if el[0] == "F" or el[0] == "O" and (len(keys) == 1 or el[1] == "O"):
            acceptors.append(dict(site))
        elif el[0] in ("N", "O"):
            donors += [{keys[0]: site[keys[0]], h: site[h]} for h in hydrogens[:2]]
            if el[0] == "O" and len(hydrogens) > 1:
                acceptors.append({keys[0]: site[keys[0]]})
    return donors, acceptors


def pair_d_a(donors: list[dict[str, int]], acceptors: list[dict[str, int]]) -> list[tuple[str, int, int, str, int]]:
    """(donor element, donor, hydrogen, acceptor element, acceptor): acceptors of several sites give one row per site; never an atom with itself."""
    out = []
    for d in donors:
        dk = next(k for k in d if not k.startswith("H"))
        hk = next(k for k in d if k.startswith("H"))
        for a in acceptors:
            out += [(dk.rstrip("0123456789"), d[dk], d[hk], k.rstrip("0123456789"), i) for k, i in a.items() if i != d[dk]]
    return out
