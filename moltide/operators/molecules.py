"""Molecules from the bond graph of each frame, their formulas and counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltide.functions import geom
from moltide.functions.elements import R_COV, elements
from moltide.operators import pairs as P
from moltide.operators.grouped import group_ids, map_groups
from moltide.operators.select import KEY


def bonds(atoms: DataFrame, cells: geom.Cells | DataFrame, factor: float = 1.05, symbols: list[str] | None = None) -> DataFrame:
    """(run_id, frame, i, j, dist): dist < factor * (sum of covalent radii). Atoms without a known radius have no bonds.

    symbols: those that occur; they bound the search, which else reaches as far as the widest bond of any element.
    """
    r = elements(atoms.sparkSession).where(F.col("r_cov").isNotNull()).select(F.col("symbol").alias("symb"), "r_cov")
    a = atoms.join(F.broadcast(r), "symb")
    widest = max((v for s, v in R_COV.items() if symbols is None or s in symbols), default=1.0)
    near = P.neighbours(a, a, cells, factor * 2 * widest, True, carry=("r_cov",))
    return geom.keep(near, F.col("dist") < factor * (F.col("r_cov_i") + F.col("r_cov_j"))).select(*KEY, "i", "j", "dist")


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component: hook to the smaller neighbour's label, then shorten, until nothing changes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(atoms: DataFrame, bonded: DataFrame) -> DataFrame:
    """(run_id, frame, at_idx, mol): mol is the smallest at_idx of the atom's molecule in that frame.

    Components are local to a frame; many frames are worked at once by array operations.
    """
    nodes = atoms.select(*KEY, F.col("at_idx").alias("i"), F.lit(None).cast("int").alias("j"))
    rows = nodes.unionByName(bonded.select(*KEY, "i", "j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = group_ids(pdf, KEY)
        node = pdf.j.isna().to_numpy()
        key = np.stack([g[node], pdf.i[node].to_numpy("int64")], 1)
        order = np.lexsort((key[:, 1], key[:, 0]))
        key = key[order]
        width = int(max(pdf.i.max(), pdf.j.max() if (~node).any() else 0)) + 1
        flat = key[:, 0] * width + key[:, 1]
        e, ge = pdf[~node], g[~node]
        a = np.searchsorted(flat, ge * width + e.i.to_numpy("int64"))
        b = np.searchsorted(flat, ge * width + e.j.to_numpy("int64"))
        root = _smallest(len(flat), a, b)
        own = pdf[node].iloc[order]
        return pd.DataFrame({"run_id": own.run_id.to_numpy(), "frame": own.frame.to_numpy(), "at_idx": key[:, 1].astype("int32"), "mol": key[root, 1].astype("int32")})

    return map_groups(rows, KEY, ["i"], run, "run_id string, frame int, at_idx int, mol int")


def molecules(atoms: DataFrame, members: DataFrame) -> DataFrame:
    """(run_id, frame, mol, formula, at_idx): element counts in alphabetical order, a count of one left out."""
    m = members.join(atoms.select(*KEY, "at_idx", "symb"), [*KEY, "at_idx"])
    n = m.groupBy(*KEY, "mol", "symb").agg(F.count("*").alias("n"), F.collect_list("at_idx").alias("ids"))
    part = F.struct("symb", "n")
    g = n.groupBy(*KEY, "mol").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("at_idx"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(F.coalesce(p.symb, F.lit("?")), F.when(p.n > 1, p.n.cast("string")).otherwise(F.lit("")))), "")
    return g.select(*KEY, "mol", text.alias("formula"), "at_idx")


def formula_counts(mols: DataFrame) -> DataFrame:
    return mols.groupBy("run_id", "formula").agg(F.count("*").alias("n"))


__all__ = ["bonds", "components", "formula_counts", "molecules"]
