"""Contacts: dimers by distance, centers of mass or hydrogen-bond geometry; hydrogen bonds of named sites.

A contact is one row (run_id, frame, tuple_id, dist[, angle]): the number of contacts of a frame never changes a
record's shape, and frames without any have no row (hbond_counts gives their zero).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltide.functions import geom
from moltide.functions.elements import elements, radius
from moltide.operators import pairs as P
from moltide.operators.select import KEY, center_of_mass

CRITERION = re.compile(r"^\s*(\d*\.?\d+)?\s*(coval|vdw)(?:_r|_sum)?\s*$")


def parse_criterion(text: str) -> tuple[float, str]:
    """(factor, 'vdw' or 'coval') of "1.02vdw_sum", "1.1coval_sum" and the like."""
    if not (m := CRITERION.match(text)):
        raise ValueError(f"no distance criterion: {text!r}")
    return float(m[1] or 1.0), m[2]


def cutoff(criterion: str | float, first: str, second: str) -> float:
    """The distance in angstrom a criterion means for two elements."""
    if isinstance(criterion, (int, float)):
        return float(criterion)
    factor, kind = parse_criterion(criterion)
    return factor * (radius(first, kind) + radius(second, kind))


def _limit(criterion: str | float, a: int, b: int) -> Column:
    """The limit for members a and b of tuples placed with radii; null, so no contact, for elements without radius."""
    if isinstance(criterion, (int, float)):
        return F.lit(float(criterion))
    factor, kind = parse_criterion(criterion)
    r = {"vdw": "r_vdw", "coval": "r_cov"}[kind]
    return factor * (F.col(f"p{a}{r}") + F.col(f"p{b}{r}"))


def dimers_distance(atoms: DataFrame, cells: geom.Cells | DataFrame | None, tups: DataFrame, criterion: str | float) -> DataFrame:
    """(run_id, frame, tuple_id, a0, a1, dist) of the listed pairs with dist <= criterion."""
    p = P.vectors(P.positions(atoms, tups) if isinstance(criterion, (int, float)) else _with_radii(atoms, tups), cells)
    d = p.withColumn("dist", geom.norm(geom.v("d")))
    return geom.keep(d, F.col("dist") <= _limit(criterion, 0, 1)).select(*KEY, "tuple_id", "a0", "a1", "dist")


def _with_radii(atoms: DataFrame, tups: DataFrame) -> DataFrame:
    """Placed tuples with the members' radii as p0r_vdw, p0r_cov, ..; null where the symbol or its radius is unknown."""
    r = elements(atoms.sparkSession).select(F.col("symbol").alias("symb"), "r_vdw", "r_cov")
    return P.positions(atoms.join(F.broadcast(r), "symb", "left"), tups, "r_vdw", "r_cov")


def contacts_within(a: DataFrame, b: DataFrame, cells: geom.Cells | DataFrame, limit: float, same: bool) -> DataFrame:
    """Contacts of all atoms of two sets by cell list: (run_id, frame, i, j, dist)."""
    return P.neighbours(a, b, cells, limit, same)


def dimers_com(atoms: DataFrame, cells: geom.Cells | DataFrame | None, members: DataFrame, mol_pairs: DataFrame, limit: float) -> DataFrame:
    """(run_id, frame, tuple_id, a0, a1, dist): pairs of molecules whose centers of mass are within the limit.

    members: (mol, at_idx); mol_pairs: (tuple_id, a0, a1) of mol numbers; both are the caller's lists.
    """
    com = center_of_mass(atoms.join(F.broadcast(members), "at_idx"), *KEY, "mol")
    placed = P.positions(com.select(*KEY, F.col("mol").alias("at_idx"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z")), mol_pairs)
    d = P.vectors(placed, cells).withColumn("dist", geom.norm(geom.v("d")))
    return geom.keep(d, F.col("dist") <= limit).select(*KEY, "tuple_id", "a0", "a1", "dist")


def hbond_geometry(atoms: DataFrame, cells: geom.Cells | DataFrame | None, triples: DataFrame) -> DataFrame:
    """(run_id, frame, tuple_id, a0 donor, a1 hydrogen, a2 acceptor, radii p0r_vdw.., r_da, r_dh, angle at the hydrogen)."""
    p = _with_radii(atoms, triples)
    p = geom.as_cells(cells).on(p, *geom.CELL, *geom.INVERSE) if cells is not None else p
    leg = lambda i, j: geom.sub(geom.v(f"p{j}"), geom.v(f"p{i}"))
    p = geom.with_images(p, {"da": leg(0, 2), "dh": leg(0, 1), "hd": leg(1, 0), "ha": leg(1, 2)}, periodic=cells is not None)
    return p.select(
        *KEY, "tuple_id", "a0", "a1", "a2", *[f"p{k}{r}" for k in range(3) for r in ("r_vdw", "r_cov")],
        geom.norm(geom.v("da")).alias("r_da"), geom.norm(geom.v("dh")).alias("r_dh"), geom.angle(geom.v("hd"), geom.v("ha")).alias("angle"),
    )


def dimers_angle(atoms: DataFrame, cells: geom.Cells | DataFrame | None, triples: DataFrame, criterion: str | float, angle: str | float) -> DataFrame:
    """Hydrogen-bond contacts: D-A distance <= criterion and D-H-A angle >= angle.

    A flexible angle such as "120f" is compared with the angle times r(D-H) over 1.05 covalent radii sums of D and H.
    """
    g = hbond_geometry(atoms, cells, triples)
    limit = _limit(criterion, 0, 2)
    if isinstance(angle, str):
        if not angle.endswith("f"):
            raise ValueError(f"no angle criterion: {angle!r}")
        shown = F.col("angle") * F.col("r_dh") / (1.05 * (F.col("p0r_cov") + F.col("p1r_cov")))
        least = float(angle[:-1])
    else:
        shown, least = F.col("angle"), float(angle)
    # NaN compares as the greatest value: degenerate angles are no contact.
    return geom.keep(g, (F.col("r_da") <= limit) & ~F.isnan("angle") & (shown >= least)).select(*KEY, "tuple_id", "a0", "a1", "a2", F.col("r_da").alias("dist"), "angle")


def hbonds(atoms: DataFrame, cells: geom.Cells | DataFrame | None, triples: DataFrame, factor: float = 1.02) -> DataFrame:
    """Hydrogen bonds by the distance-dependent angle rule: R(D-A) <= factor * van der Waals sum, and
    angle >= (degrees(atan2(R(D-A), r(D-H))) + 180) * 3 / 8."""
    g = hbond_geometry(atoms, cells, triples)
    limit = _limit(f"{factor}vdw_sum", 0, 2)
    least = (F.degrees(F.atan2("r_da", "r_dh")) + 180) * 3 / 8
    return geom.keep(g, (F.col("r_da") <= limit) & ~F.isnan("angle") & (F.col("angle") >= least)).select(*KEY, "tuple_id", "a0", "a1", "a2", "r_da", "r_dh", "angle")


def hbond_counts(bonds: DataFrame, frames: DataFrame) -> DataFrame:
    """(run_id, frame, n_hbonds) for every frame, 0 where there is no bond."""
    n = bonds.groupBy(*KEY).agg(F.count("*").alias("n"))
    return frames.select(*KEY).distinct().join(n, KEY, "left").select(*KEY, F.coalesce("n", F.lit(0)).alias("n_hbonds"))


def involving(bonds: DataFrame, ids: list[int]) -> DataFrame:
    """Bonds in which one of the atoms takes part as donor, hydrogen or acceptor."""
    return bonds.where(F.col("a0").isin(ids) | F.col("a1").isin(ids) | F.col("a2").isin(ids))
