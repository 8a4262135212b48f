"""Implausible readings per source: spikes, stuck values, impossible values (problem 2).

A source is one series of readings: an atom of a run, or the energy of a run. Each source is compared
with its own usual course by a Hampel filter (rolling median, median absolute deviation), stuck values
are found by run length, impossible ones by bounds.

Sources of any length are cut into stretches of ``STRETCH`` frames that overlap by ``MARGIN`` frames, so
that no task needs a whole source, and what holds for the whole source (an atom that is held in place
for the whole run) is decided from one summary row per stretch.

Defined results: rows with a null source or position are left out; null readings are passed over (an
atom with some null coordinates is judged by the others and takes no part in run lengths); rows
delivered twice (equal id) count once; positions are compared up to lattice vectors where the cell is
known, so folding is no spike; a run without cell is compared as it is. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltide.operators.grouped import group_ids, map_groups
from moltide.operators.select import FARTHEST, HIGHEST
from moltide.session import broadcast_if_small, written

STRETCH, MARGIN = 2048, 64
#: Records on either side in the rolling median.
HALF = 5
#: Deviations from the rolling median, in robust standard deviations of the source, that are spikes.
LIMIT, LIMIT_AT_END = 12.0, 24.0
#: A spike comes back within this many records.
SPIKE_RECORDS = 3
#: Records in a row from which an unchanged reading is stuck.
STUCK_RECORDS = 5
#: How far a reading can be from the middle of its source's stretch: in cell lengths, or in angstrom without a cell; for
#: energies in shares of the middle. To each comes FREE times the median deviation of the stretch, which is its own travel.
CELLS_FAR, ANGSTROM_FAR, SHARES_FAR, FREE = 1.5, 200.0, 2.0, 40.0


def _rolling_median(v: np.ndarray, gid: np.ndarray) -> np.ndarray:
    """Median of the readings within HALF records of the same group; v is (rows, values) without gaps."""
    n = len(v)
    g = np.pad(gid, HALF, constant_values=-1)
    same = sliding_window_view(g, 2 * HALF + 1) == gid[:, None]
    count = same.sum(1)
    out = np.empty_like(v)
    rows = np.arange(n)
    for c in range(v.shape[1]):
        w = np.where(same, sliding_window_view(np.pad(v[:, c], HALF), 2 * HALF + 1), np.inf)
        w.sort(axis=1)
        out[:, c] = (w[rows, (count - 1) // 2] + w[rows, count // 2]) / 2
    return out


def _group_median(v: np.ndarray, gid: np.ndarray, groups: int) -> np.ndarray:
    """Median of v for each group; 0 for a group without values."""
    order = np.lexsort((v, gid))
    lo, hi = np.searchsorted(gid[order], [np.arange(groups), np.arange(groups) + 1])
    n = hi - lo
    s = np.append(v[order], 0.0)
    return np.where(n > 0, (s[np.where(n > 0, lo + (n - 1) // 2, -1)] + s[np.where(n > 0, lo + n // 2, -1)]) / 2, 0.0)


def _runs(flag: np.ndarray) -> np.ndarray:
    """For each row of a run of true flags its length, 0 elsewhere. Rows between groups must be false."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flag.astype("int8"), [0]))))
    out = np.zeros(len(flag), "int64")
    for_start, for_end = edge[::2], edge[1::2]
    length = for_end - for_start
    out[flag] = np.repeat(length, length)
    return out


def _unchanged(v: np.ndarray, gid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal to the record before, number of equal records in a row with this one among them)."""
    same = np.zeros(len(v), bool)
    same[1:] = (gid[1:] == gid[:-1]) & (v[1:] == v[:-1]).all(1)
    start = np.flatnonzero(~same)
    length = np.diff(np.append(start, len(v)))
    return same, np.repeat(length, length)


def _fold(d: np.ndarray, h: np.ndarray, inv: np.ndarray) -> np.ndarray:
    """Shortest image of the differences d by the single-rounding rule."""
    s = np.einsum("ni,nij->nj", d, inv)
    return d - np.einsum("ni,nij->nj", np.rint(s), h)


def hampel(pdf: pd.DataFrame, values: list[str], cell: list[str], relative: float, limit: float) -> pd.DataFrame:
    """Judge sorted whole groups of (source, stretch): columns id, kind for the flagged rows, and a summary row per group.

    Values of the size of limit or more can't be readings of any source. kind: 'sure' flagged; 'unless_held' stuck in a stretch without any movement; 'span' the summary, with the
    values' least and greatest usual reading as lo and hi.
    """
    p = pdf[~pdf.duplicated(["source", "part", "stretch", "id"])].reset_index(drop=True)
    gid = group_ids(p, ["source", "part", "stretch"])
    groups = int(gid[-1]) + 1
    raw = p[values].to_numpy("float64")
    null = p[[f"{v}_null" for v in values]].to_numpy(bool)
    core = p["core"].to_numpy(bool)
    impossible = ((~np.isfinite(raw) | (np.abs(raw) >= limit)) & ~null).any(1)
    flagged = impossible.copy()

    full = np.flatnonzero(~impossible & ~null.any(1))
    v, g = raw[full], gid[full]
    has_cell = bool(cell)
    if has_cell:
        h = p[cell].to_numpy("float64")[full].reshape(-1, 3, 3)
        known = np.isfinite(h).all((1, 2)) & (np.abs(np.linalg.det(np.where(np.isfinite(h), h, 0))) > 1e-9)
        h = np.where(known[:, None, None], h, np.eye(3) * 1e12)
        inv = np.linalg.inv(h)
        u = v.copy()
        if len(v) > 1:
            s = np.einsum("ni,nij->nj", v, inv)
            jump = np.rint(np.diff(s, axis=0))
            jump[g[1:] != g[:-1]] = 0
            total = np.concatenate((np.zeros((1, 3)), np.cumsum(jump, axis=0)))
            first = np.searchsorted(g, g)
            u = v - np.einsum("ni,nij->nj", total - total[first], h)
    else:
        u = v
    scale = np.zeros(groups)
    if len(v):
        med = _rolling_median(u, g)
        dev = u - med
        if has_cell:
            dev = _fold(dev, h, inv)
        a = np.abs(dev)
        scale = 1.4826 * _group_median(a.ravel(), np.repeat(g, v.shape[1]), groups)
        scale = np.maximum(scale, 1e-6)
        z = a.max(1) / scale[g]
        place = np.arange(len(g)) - np.searchsorted(g, g)
        rest = np.searchsorted(g, g, "right") - 1 - np.arange(len(g))
        limit = np.where((place < 2) | (rest < 2), LIMIT_AT_END, LIMIT)
        out = z > limit
        # Near a lasting move the median may lie on the other side of a drift: a spike also stands off from the records around it.
        k = np.flatnonzero(out)
        if len(k):
            calm = np.flatnonzero(~out)
            at = np.searchsorted(calm, k)
            apart = np.ones(len(k), bool)
            first = np.zeros(len(k), bool)
            for s, side in enumerate(((-3, -2, -1), (0, 1, 2))):
                j = at[:, None] + np.array(side)[None]
                ok = (j >= 0) & (j < len(calm))
                j = calm[np.clip(j, 0, max(len(calm) - 1, 0))] if len(calm) else np.zeros_like(j)
                ok = ok & (g[j] == g[k][:, None])
                w = np.where(ok[:, :, None], u[j], np.inf)
                w.sort(axis=1)
                n_ok = ok.sum(1)
                m = w[np.arange(len(k)), np.maximum(n_ok - 1, 0) // 2]
                off = np.where(n_ok[:, None] > 0, u[k] - np.where(np.isfinite(m), m, u[k]), 0)
                if s == 0:
                    first = n_ok == 0
                elif first.any():
                    # At the start of a source it may still relax: the line through the records after is what it should be on.
                    start = first & (n_ok == 3)
                    a, b = u[j[start, 0]], u[j[start, 2]]
                    steps = (j[start, 2] - j[start, 0])[:, None]
                    off[start] = u[k[start]] - (a + (a - b) / steps * (j[start, 0] - k[start])[:, None])
                if has_cell:
                    off = _fold(off, h[k], inv[k])
                apart &= (n_ok == 0) | (np.abs(off).max(1) > np.where(first, LIMIT_AT_END, LIMIT / 2) * scale[g[k]])
            out[k] = apart
        # Out of the source's own bounds: a block of such readings, however long, is still far from the middle of the stretch.
        # Stored positions count here: taking out lattice vectors would bring any value back into the cell.
        middle = np.stack([_group_median(v[:, c], g, groups) for c in range(v.shape[1])], 1)[g]
        travel = np.stack([_group_median(np.abs(v[:, c] - middle[:, c]), g, groups) for c in range(v.shape[1])], 1)[g]
        bound = np.where(known[:, None], np.abs(h).sum(1) * CELLS_FAR, ANGSTROM_FAR) if has_cell else SHARES_FAR * np.maximum(np.abs(middle), 1.0)
        beyond = (np.abs(v - middle) > bound + FREE * travel).any(1)
        # Farther from the usual place than any image can be.
        near = _rolling_median(v, g)
        reach = np.abs(h).sum(1) * 1.5 if has_cell else np.full(v.shape, np.inf)
        far = (np.abs(v - near) > np.where(known[:, None], reach, np.inf)).any(1) if has_cell else np.zeros(len(v), bool)
        if relative:
            base = _group_median(v[:, 0], g, groups)[g]
            far |= (np.abs(v[:, 0] - base) > relative * np.abs(base)) & (z > 4 * LIMIT)
        far |= beyond
        # Runs of outliers that don't come back in time are lasting moves. A false row parts the groups.
        gap = g + np.arange(len(g))
        spread = np.zeros(len(g) + groups + 1, bool)
        spread[gap] = out
        short = _runs(spread)[gap] <= SPIKE_RECORDS
        bad = (out & short) | far
        flagged[full[bad]] = True
        same, length = _unchanged(v, g)
        stuck = same & (length >= STUCK_RECORDS) & ~bad
        lo, hi = np.full((groups, v.shape[1]), np.inf), np.full((groups, v.shape[1]), -np.inf)
        fine = ~bad
        np.minimum.at(lo, g[fine], v[fine])
        np.maximum.at(hi, g[fine], v[fine])
        held = (lo == hi).all(1)
        sure = stuck & ~held[g] if has_cell else stuck
        flagged[full[sure]] = True
        maybe = full[stuck & held[g]] if has_cell else full[:0]
        # Records with some values only: the others against the rolling median of their neighbours.
        part = np.flatnonzero(~impossible & null.any(1) & ~null.all(1))
        if len(part):
            at = np.clip(np.searchsorted(full, part), 0, len(full) - 1)
            at = np.where(g[at] == gid[part], at, np.maximum(at - 1, 0))
            ok = g[at] == gid[part]
            part, at = part[ok], at[ok]
            d = raw[part] - near[at]
            if has_cell:
                shifts = np.array([(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)], float)
                every = d[:, None, :] + np.einsum("si,nij->nsj", shifts, h[at])
                every[np.broadcast_to(null[part][:, None, :], every.shape)] = 0
                best = np.abs(every).max(2).min(1)
            else:
                best = np.where(null[part], 0, np.abs(d)).max(1)
            flagged[part[best > LIMIT_AT_END * scale[gid[part]]]] = True
    else:
        maybe, lo, hi = full[:0], np.zeros((groups, len(values))), np.ones((groups, len(values)))
        held = np.zeros(groups, bool)
    rows = [pd.DataFrame({"id": p.id[flagged & core], "source": p.source[flagged & core], "part": p.part[flagged & core], "kind": "sure"})]
    if has_cell:
        m = maybe[core[maybe]]
        rows.append(pd.DataFrame({"id": p.id[m], "source": p.source[m], "part": p.part[m], "kind": "unless_held"}))
        head = np.searchsorted(gid, np.arange(groups))
        some = np.isfinite(lo).all(1)
        rows.append(pd.DataFrame({"id": p.id[head], "source": p.source[head], "part": p.part[head], "kind": "span", "lo": list(lo), "hi": list(hi)})[some])
    found = pd.concat(rows, ignore_index=True)
    for c in ("lo", "hi"):
        if c not in found:
            found[c] = None
        found[c] = found[c].where(found[c].notna(), None)
    return found[["id", "source", "part", "kind", "lo", "hi"]]


def _stretched(df: DataFrame, frame: str) -> DataFrame:
    """Give every row its stretch, and the rows near an end of a stretch to the neighbour as well, as margin."""
    k = F.floor(F.col(frame) / STRETCH).cast("long")
    off = F.col(frame) - k * STRETCH
    own = F.struct(k.alias("k"), F.lit(True).alias("core"))
    before = F.when((off < MARGIN) & (k > 0), F.struct((k - 1).alias("k"), F.lit(False).alias("core")))
    after = F.when(off >= STRETCH - MARGIN, F.struct((k + 1).alias("k"), F.lit(False).alias("core")))
    return df.withColumn("e", F.explode(F.filter(F.array(own, before, after), lambda x: x.isNotNull()))).withColumn("stretch", F.col("e.k")).withColumn("core", F.col("e.core")).drop("e")


SCHEMA = "id long, source string, part int, kind string, lo array<double>, hi array<double>"


def run_cells(frames: DataFrame) -> DataFrame:
    """(source, c0 .. c8): the cell of each run, from its first frame that has one."""
    whole = F.when(F.size("lattice") == 9, F.col("lattice"))
    return frames.where(F.col("run_id").isNotNull() & whole.isNotNull()).groupBy(F.col("run_id").alias("source")).agg(F.min_by("lattice", "frame").alias("m")).select("source", *[F.get("m", i).alias(f"c{i}") for i in range(9)])


def faulty_atoms(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """(record_id): the atom records whose position can't be true."""
    cell = [f"c{i}" for i in range(9)]
    xyz = ["x", "y", "z"]
    a = atoms.where(F.col("run_id").isNotNull() & F.col("frame").isNotNull() & F.col("at_idx").isNotNull() & F.col("row_id").isNotNull() & F.coalesce(*xyz).isNotNull())
    a = _stretched(a.select(F.col("row_id").alias("id"), F.col("run_id").alias("source"), F.col("at_idx").cast("int").alias("part"), F.col("frame").cast("long").alias("frame"), *xyz), "frame")
    cells, small = broadcast_if_small(run_cells(frames), 256)
    if small:
        joined = a.join(cells, "source", "left")
    else:  # Long runs are spread over 64 salts, each with its copy of the run's cell.
        salts = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        joined = a.withColumn("salt", F.pmod(F.hash("part", "stretch"), F.lit(64))).join(salts, ["source", "salt"], "left").drop("salt")
    ready = joined.select("id", "source", "part", "stretch", "frame", "core", *[F.coalesce(c, F.lit(float("nan"))).alias(c) for c in xyz], *[F.col(c).isNull().alias(f"{c}_null") for c in xyz], *cell)
    judged = written(map_groups(ready, ["source", "part", "stretch"], ["frame", "id"], lambda p: hampel(p, xyz, cell, 0.0, FARTHEST), SCHEMA), "spikes")
    spans = judged.where(F.col("kind") == "span").groupBy("source", "part").agg(
        *[F.min(F.get("lo", i)).alias(f"lo{i}") for i in range(3)], *[F.max(F.get("hi", i)).alias(f"hi{i}") for i in range(3)]
    )
    moving = spans.where((F.col("lo0") < F.col("hi0")) | (F.col("lo1") < F.col("hi1")) | (F.col("lo2") < F.col("hi2")))
    stuck = judged.where(F.col("kind") == "unless_held").join(moving, ["source", "part"], "left_semi")
    return judged.where(F.col("kind") == "sure").select("id").union(stuck.select("id")).select(F.col("id").alias("record_id"))


def faulty_energies(frames: DataFrame) -> DataFrame:
    """(record_id): the frame records whose energy can't be true."""
    f = frames.where(F.col("run_id").isNotNull() & F.col("frame").isNotNull() & F.col("frame_id").isNotNull() & F.col("energy").isNotNull())
    f = _stretched(f.select(F.col("frame_id").alias("id"), F.col("run_id").alias("source"), F.lit(0).alias("part"), F.col("frame").cast("long").alias("frame"), "energy", F.lit(False).alias("energy_null")), "frame")
    judged = map_groups(f, ["source", "part", "stretch"], ["frame", "id"], lambda p: hampel(p, ["energy"], [], 0.2, HIGHEST), SCHEMA)
    return judged.where(F.col("kind") == "sure").select(F.col("id").alias("record_id"))


def faulty(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """(record_kind, record_id) of all implausible readings."""
    return (
        faulty_atoms(atoms, frames).select(F.lit("atom").alias("record_kind"), "record_id")
        .union(faulty_energies(frames).select(F.lit("frame").alias("record_kind"), "record_id"))
    )
