"""Queries against their SQL on the smallest tables, and the driver's contract."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CHOSEN = ("rdf", "wrap_pretty", "msd_by_lag", "vrd_per_pair", "hbond_records", "survival_sampled", "molecule_formulas", "xyz_export")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_equal_rows(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.sql(entry.oracle_sql()[name]).to_df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda d: sorted(tuple(r) for r in d[sorted(d.columns)].astype(object).where(d.notna(), None).astype(str).to_numpy())
    a, b = key(got), key(want)
    assert len(a) == len(b)
    for p, q in zip(a, b):
        for x, y in zip(p, q):
            if x != y:
                assert float(x) == pytest.approx(float(y), abs=1e-9)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_vanhove_takes_whole_groups(spark, duck):
    test_equal_rows(spark, duck, "vanhove_distinct_groups")


def test_contract():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and "rdf" in q


def test_core_stands_alone():
    """The core neither imports the llm subpackage nor needs it."""
    code = "import sys; sys.modules['moltide.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p4_found' not in q; e.oracle_sql(); assert not [m for m in sys.modules if m.startswith('moltide.llm.')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_export_prints_as_its_sql(spark, tmp_path):
    """Signs of zero, ties and near ties of the last decimal, nulls and values that are not finite; frames that differ only in what isn't printed."""
    odd = [-0.0, 0.0, 0.001953125, 0.005859375, -0.001953125, 1.000000005, -1.000000005, 1234.000000015, 2.675000005, -1e-10, 4.9999e-9, 5e-9, -5e-9, 9999.999999995, 0.1, 7.0]
    at = [(i, "r", 1, i, "H" if i else "Uue", v, odd[i - 1], -v) for i, v in enumerate(odd)]
    at += at[:3] + [(90, "r", 2, 0, None, 1.0, 1.0, 1.0), (91, "r", 3, 0, "O", float("nan"), 1.0, 1.0), (92, "r", 4, 0, "O", 1.0, 1.0, -0.0), (93, "r", 5, 0, "O", 1.0, 1.0, 1.0)]
    cell = [1.0, -0.0, None, 0.001953125, float("nan"), float("inf"), -float("inf"), 2.0, 1e7]
    fr = [
        (1, "r", 1, 2.0625, -0.0, 1.0, cell), (1, "r", 1, 2.0625, -0.0, 2.0, cell), (2, "r", 1, None, 2e7, None, None), (2, "r", 1, None, 3e7, None, None), (3, "r", 4, 0.0005, -2.000000005, None, []),
        (4, "r", 5, float("nan"), float("nan"), None, [1.5] * 9), (5, "r", 5, -0.0, 9999999.123456785, None, None), (6, "r", 9, 1.0, 1.0, None, None),
    ]
    con = duckdb.connect()
    for name, rows, schema in (("atoms", at, "row_id long, run_id string, frame int, at_idx int, symb string, x double, y double, z double"), ("frames", fr, "frame_id long, run_id string, frame int, t_fs double, energy double, temperature_k double, lattice array<double>")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in entry.queries()["xyz_export"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(entry.oracle_sql()["xyz_export"]).fetchall())
