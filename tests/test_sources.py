"""Readers and writers: every header form, side files, dumps, round trips."""

import numpy as np
import pytest

from moltide.operators import contacts as K
from moltide.sources import lammps, records, xyz
from moltide.sources.text_lines import chosen
from moltide.sources.trajectory import Trajectory

FRAMES = [
    '2\nLattice="1 0 0 0 2 0 0 0 3" Properties=species:S:1:pos:R:3 frame=0 time=1.500 energy=-2.5\nO 0 0 0\nH 1 2 3\n',
    "2\ni = 1, time = 0.500, E = -1.2\nO 1.0 0 0\nH 1D0 2 3\n",
    '2\ncell="4 5 6" Properties=species:S:1:pos:R:3:forces:R:3\nO 2 0 0 9 9 9\nH 1 2 3 9 9 9\n',
    "2\nProperties = frame: 3, t: 15 fs, Cell: [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.5, 1.0]]\nO 3 0 0\nH 1 2 3\n",
    "2\n\nO 4 0 0\nH 1 2 3\n",
]


@pytest.fixture
def file(tmp_path):
    p = tmp_path / "a.xyz"
    p.write_text("".join(FRAMES))
    return str(p)


def test_header_forms(spark, file):
    atoms, frames = xyz.read_extxyz(spark, file, timestep=5.0, cell=[[7, 0, 0], [0, 7, 0], [0, 0, 7]])
    f = frames.orderBy("frame").collect()
    assert [r["t_fs"] for r in f] == [1.5, 0.5, 10.0, 15.0, 20.0] and [r["energy"] for r in f] == [-2.5, -1.2, None, None, None]
    assert [r["lattice"][4] for r in f] == [2.0, 7.0, 5.0, 1.0, 7.0] and f[3]["lattice"][7] == 0.5 and [r["natoms"] for r in f] == [2] * 5
    o = atoms.where("symb = 'O'").orderBy("frame").collect()
    assert [(r["frame"], r["x"]) for r in o] == [(i, float(i)) for i in range(5)]


def test_frame_selection(spark, file):
    pick = lambda i: [r["x"] for r in xyz.read_extxyz(spark, file, i)[0].where("symb = 'O'").orderBy("frame").collect()]
    assert pick("1:4:2") == [1.0, 3.0] and pick(-1) == [4.0] and pick([3, 0]) == [3.0, 0.0] and pick(slice(-2, None)) == [3.0, 4.0]
    with pytest.raises(IndexError):
        pick(5)
    assert chosen("all") == ("all", None) and chosen(2) == ("list", [2])


def test_empty_file(spark, tmp_path):
    p = tmp_path / "e.xyz"
    p.write_text("")
    with pytest.raises(ValueError):
        xyz.read_extxyz(spark, str(p))


def test_round_trip_and_handle(spark, tmp_path):
    rng = np.random.default_rng(1)
    t = Trajectory.from_memory(spark, "H2O", rng.uniform(0, 9, (4, 3, 3)).round(6).tolist(), cell=[[9, 0, 0], [1, 9, 0], [0, 0, 9]], timestep=2.0)
    path = t.write(str(tmp_path / "out.xyz"))
    assert t.write(str(tmp_path / "out.xyz")).endswith("out-1.xyz")
    back = Trajectory.from_path(spark, path)
    key = lambda d: sorted((r["frame"], r["at_idx"], r["symb"], r["x"], r["y"], r["z"]) for r in d.atoms.collect())
    assert key(back) == key(t)
    assert [r["t_fs"] for r in back.frames.orderBy("frame").collect()] == [0.0, 2.0, 4.0, 6.0]
    half = t[::2]
    assert half.timestep == 4.0 and half.frames.count() == 2 and half.atoms.count() == 6
    with pytest.raises(ValueError):
        t.wrap2box().unwrapped()
    assert t.calib().atoms.count() == 12


def test_side_files(spark, tmp_path):
    (tmp_path / "run-pos-1.xyz").write_text("1\n i = 0, time = 0.0, E = -1.0\nH 1 1 1\n1\n i = 1, time = 1.0, E = -1.0\nH 2 2 2\n")
    (tmp_path / "run-frc-1.xyz").write_text("1\n\nH 0.1 0.2 0.3\n1\n\nH 0.4 0.5 0.6\n")
    (tmp_path / "run-1.cell").write_text("# Step Time\n0 0.0 5 0 0 0 6 0 0 0 7 210\n1 1.0 5 0 0 0 6 0 0 0 8 240\n")
    t = Trajectory.from_path(spark, str(tmp_path))
    assert [r["lattice"][8] for r in t.frames.orderBy("frame").collect()] == [7.0, 8.0]
    assert [(r["x"], r["fy"]) for r in t.atoms.orderBy("frame").collect()] == [(1.0, 0.2), (2.0, 0.5)]


def test_lammps(spark, tmp_path):
    head = "ITEM: TIMESTEP\n{s}\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS xy xz yz pp pp pp\n0.0 12.0 2.0\n0.0 8.0 0.0\n0.0 6.0 0.0\nITEM: ATOMS id type x y z\n"
    (tmp_path / "d.lammpstrj").write_text(head.format(s=0) + "7 1 1 2 3\n3 2 4 5 6\n" + head.format(s=50) + "3 2 4 5 7\n7 9 1 2 4\n")
    (tmp_path / "d.data").write_text("header\n\nMasses\n\n1 15.9994 # O\n2 1.01\n\nAtoms\n\n1 1 0 0 0\n")
    atoms, frames = lammps.read_lammps(spark, str(tmp_path / "d.lammpstrj"), str(tmp_path / "d.data"), timestep=0.5)
    got = [(r["frame"], r["at_idx"], r["symb"], r["z"]) for r in atoms.orderBy("frame", "at_idx").collect()]
    assert got == [(0, 0, "H", 6.0), (0, 1, "O", 3.0), (1, 0, "H", 7.0), (1, 1, "X9", 4.0)]
    f = frames.orderBy("frame").collect()
    assert [r["t_fs"] for r in f] == [0.0, 25.0] and f[0]["lattice"] == [10.0, 0, 0, 2.0, 8.0, 0, 0, 0, 6.0]
    assert lammps.type_symbols("Masses\n\n1 500\n2 12.0 # Q\n") == {2: "C"}
    assert Trajectory.from_path(spark, str(tmp_path), 1).atoms.count() == 2


def test_contact_records(spark, tmp_path):
    b = spark.createDataFrame([("r", 0, 0, 1, 2, 3, 2.8, 170.0, 1.0)], "run_id string, frame int, tuple_id int, a0 int, a1 int, a2 int, r_da double, angle double, r_dh double")
    fr = spark.createDataFrame([("r", 0), ("r", 1)], "run_id string, frame int")
    records.write_json(records.hbond_records(b, fr), str(tmp_path / "h"))
    back = records.read_hbonds(spark, str(tmp_path / "h"))
    assert [tuple(r) for r in back.collect()] == [("r", 0, 1, 2, 3, 2.8, 170.0, 1.0)]
    assert records.read_hbonds(spark, str(tmp_path / "h"), [1, 5]).count() == 0
    assert [r["n_hbonds"] for r in K.hbond_counts(b, fr).orderBy("frame").collect()] == [1, 0]
    d = spark.createDataFrame([(1, "[[1,2],[3,4],[1,2]]"), (2, "[5,6]"), (3, "[]"), (4, None)], "frame int, pairs string")
    assert sorted(tuple(r) for r in records.contact_lists(d, ["frame"], "pairs", 2).collect()) == [(1, 1, 2), (1, 3, 4), (2, 5, 6)]
