"""Spikes, stuck and impossible readings of made-up sources with known faults."""

import math

import numpy as np

from moltide.operators import spikes as SP

ATOMS = "row_id long, run_id string, frame int, at_idx int, symb string, x double, y double, z double, extra int"
FRAMES = "frame_id long, run_id string, frame int, energy double, lattice array<double>"
CELL = [20.0, 0.0, 0.0, 0.0, 20.0, 0.0, 0.0, 0.0, 20.0]


def walk(seed, n, start=10.0, step=0.03):
    return start + np.cumsum(np.random.default_rng(seed).normal(0, step, (n, 3)), axis=0)


def rows_of(p, run="r", atom=0, base=0):
    return [(base + i, run, i, atom, "H", *(None if v is None else float(v) for v in q), 1) for i, q in enumerate(p)]


def atoms(spark, rows, frames=None):
    a = spark.createDataFrame(rows, ATOMS)
    f = spark.createDataFrame(frames if frames is not None else [(1, "r", 0, 1.0, CELL)], FRAMES)
    return sorted(r["record_id"] for r in SP.faulty_atoms(a, f).collect())


def test_spikes_of_one_to_three_records(spark):
    p = walk(1, 300)
    p[50] += 3
    p[100:102, 1] -= 2.5
    p[150:153, 2] += 4
    p[200:] += 5  # a lasting move
    assert atoms(spark, rows_of(p)) == [50, 100, 101, 150, 151, 152]


def test_folding_is_no_spike(spark):
    p = walk(2, 400, start=0.0, step=0.1) % 20.0
    assert np.abs(np.diff(p, axis=0)).max() > 15
    assert atoms(spark, rows_of(p)) == []
    p[77] = [9999.0, p[77, 1], p[77, 2]]
    assert atoms(spark, rows_of(p)) == [77]


def test_stuck_and_held(spark):
    p = walk(3, 200)
    p[60:68] = p[60]
    p[120:124] = p[120]  # four records are not enough
    held = np.tile([1.0, 2.0, 3.0], (200, 1))
    spiked = held.copy()
    spiked[90] = [1.0, 7.0, 3.0]
    rows = rows_of(p) + rows_of(held, atom=1, base=1000) + rows_of(spiked, atom=2, base=2000)
    assert atoms(spark, rows) == [*range(61, 68), 2090]


def test_impossible_null_repeated_rows(spark):
    p = [list(q) for q in walk(4, 120)]
    p[10] = [math.nan, 1.0, 1.0]
    p[20][0] = math.inf
    p[30][2] = 1e20
    p[40] = [None, None, None]
    p[50][1] = None
    rows = rows_of(p)
    assert atoms(spark, rows + rows[:15] + [(9999, None, 1, 0, "H", 1.0, 1.0, 1.0, 1)]) == [10, 20, 30]
    assert atoms(spark, [], []) == []


def test_stretches_agree_with_whole_sources(spark, monkeypatch):
    n = 3 * SP.STRETCH
    p = walk(5, n, step=0.02)
    for i in (SP.STRETCH - 1, SP.STRETCH, 2 * SP.STRETCH + 1, 777):
        p[i] += 2
    p[2 * SP.STRETCH - 3 : 2 * SP.STRETCH + 4] = p[2 * SP.STRETCH - 3]
    want = sorted([SP.STRETCH - 1, SP.STRETCH, 777, *range(2 * SP.STRETCH - 2, 2 * SP.STRETCH + 4)])
    p[2 * SP.STRETCH + 1] = p[2 * SP.STRETCH - 3]
    assert atoms(spark, rows_of(p)) == want
    held = np.tile([1.0, 2.0, 3.0], (n, 1))
    assert atoms(spark, rows_of(held)) == []
    held[-100:] += 0.5  # it moves in the last stretch, for good: the earlier ones are stuck after all
    got = atoms(spark, rows_of(held))
    assert got == [i for i in range(n) if i not in (0, n - 100)]


def test_energies(spark):
    rng = np.random.default_rng(6)
    e = -4000 + rng.normal(0, 0.01, 400) + 2 * np.exp(-np.arange(400) / 15)
    e[100] += 1.0
    e[200:206] = e[200]
    e[250] = math.nan
    e[300:] += 0.7
    e[350] = 0.0
    rows = [(i, "r", i, float(v), CELL) for i, v in enumerate(e)] + [(900, "q", i, None, CELL) for i in range(30)]
    got = sorted(r["record_id"] for r in SP.faulty_energies(spark.createDataFrame(rows, FRAMES)).collect())
    assert got == [100, 201, 202, 203, 204, 205, 250, 350]


def test_cells_too_many_to_broadcast(spark, monkeypatch):
    p = walk(7, 200, start=0.0, step=0.1) % 20.0
    p[90] = (p[90] + 7) % 20.0
    want = atoms(spark, rows_of(p))
    assert want == [90]
    monkeypatch.setattr(SP, "broadcast_if_small", lambda df, row_bytes: (df, False))
    assert atoms(spark, rows_of(p)) == want


def test_long_blocks_of_impossible_values(spark):
    """Twenty and more readings in a row that the system cannot have, with and without a cell."""
    p = walk(5, 400)
    p[100:120] += 5e3 + np.random.default_rng(6).normal(0, 0.03, (20, 3))
    want = list(range(100, 120))
    assert atoms(spark, rows_of(p)) == want
    assert atoms(spark, rows_of(p), [(1, "r", 0, 1.0, None)]) == want
    p[200:260] = 5e5 + np.random.default_rng(7).normal(0, 0.03, (60, 3))
    assert atoms(spark, rows_of(p)) == [*want, *range(200, 260)]
    e = [(i, "r", i, -1500.0 + 0.1 * math.sin(i) + (9e4 + i if 60 <= i < 90 else 0.0), None) for i in range(300)]
    f = spark.createDataFrame(e, FRAMES)
    assert sorted(r["record_id"] for r in SP.faulty_energies(f).collect()) == list(range(60, 90))
