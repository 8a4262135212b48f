"""Lines that fail to parse, against a line-by-line reading."""

import re

import pytest
from pyspark.sql import functions as F

from moltide.operators import parse_faults as PF

ELEMENTS = ["H", "C", "O", "N", "Zn"]
LINES = "line_id long, file_id long, line_no int, raw_line string, extra string"
NUM = re.compile(r"^[+-]?(\d+\.?\d*|\.\d+)([eEdD][+-]?\d+)?$")


def good(t):
    return bool(NUM.match(t)) and abs(float(t.replace("d", "e").replace("D", "e"))) < float("inf")


def brute(rows):
    """{line_id: reason} by following each file's blocks one line after the other."""
    out = {}
    for f in {r[1] for r in rows}:
        at = {}
        for r in sorted((r for r in rows if r[1] == f), key=lambda r: (r[2], r[0])):
            at.setdefault(r[2], []).append(r)
        i = 1
        while i in at:
            n = int(at[i][0][3])
            head = at[i + 1][0][3] or ""
            m = re.search(r"Properties=((?:\w+:\w:\d+:?)+)", head)
            spec = m[1].strip(":").split(":") if m else []
            want = sum(map(int, spec[2::3])) or 4
            for r in at[i + 1]:
                t = r[3] or ""
                if t.count('"') % 2:
                    out[r[0]] = "quoting"
                    continue
                m = re.search(r'(?i)(?:lattice|cell)\s*[=:]\s*("[^"]*"|\[\[.*\]\])', t)
                if m:
                    v = m[1].strip('"')
                    if v.startswith("["):
                        parts = [p.split(",") for p in re.findall(r"\[([^\[\]]*)\]", v)]
                        ok = len(parts) == 3 and all(len(p) == 3 and all(good(x.strip()) for x in p) for p in parts)
                    else:
                        ok = len(v.split()) in (3, 9) and all(map(good, v.split()))
                    if not ok:
                        out[r[0]] = "bad_lattice"
            for k in range(i + 2, i + 2 + n):
                for r in at.get(k, []):
                    t = r[3] or ""
                    f_ = t.split()
                    if t.count('"') % 2:
                        out[r[0]] = "quoting"
                    elif len(f_) != want:
                        out[r[0]] = "column_count"
                    elif f_[0] not in ELEMENTS:
                        out[r[0]] = "bad_symbol"
                    elif not all(good(x) for x in f_[1:4]):
                        out[r[0]] = "bad_number"
            i += n + 2
    return out


def lines(*files):
    rows, i = [], 0
    for f, text in enumerate(files):
        for k, t in enumerate(text, 1):
            i += 1
            rows.append((i, f, k, t, "x"))
    return rows


SAMPLE = lines(
    ["3", 'Lattice="1 0 0 0 1 0 0 0 1" Properties=species:S:1:pos:R:3 e=1', "H 0 0 0", "C 1e0 2D+1 .5", "Qz 0 0 0", "2", 'cell="1 2', "H 0 0", "O 1 2 nan"],
    ["1", "", "H 1 2 3", "1", "frame 1", "Zn\t1.\t+2\t−3", "1", "Properties = frame: 3, t: 15 fs, Cell: [[1, 0, 0], [0, 1, 0], [0, 0]]", 'H "1 2 3'],
    ["1", 'cell="1 2 3" Properties=species:S:1:pos:R:3:forces:R:3', "H 1 2 3 4 5 6", "2", 'Lattice=""', "", None],
    ["4", "step 4", "1 2 3 4", "12", "H 1e999 0 0", "h 1 1 1"],
)


def found(spark, rows, stretch=PF.STRETCH):
    e = spark.createDataFrame([(s,) for s in ELEMENTS], "symb string")
    return {r["line_id"]: r["reason"] for r in PF.judged(spark.createDataFrame(rows, LINES), e, stretch).collect()}


@pytest.mark.parametrize("stretch", [PF.STRETCH, 4])
def test_reasons(spark, stretch):
    assert found(spark, SAMPLE, stretch) == brute(SAMPLE)


def test_repeats_nulls_and_empty(spark):
    rows = [*SAMPLE, *SAMPLE[:9], (901, None, 1, "H", "x"), (902, 0, None, "H", "x")]
    assert found(spark, rows) == brute(SAMPLE)
    assert found(spark, []) == {}
    long = lines(["1", "x" * 200_000, "H 1 2 " + "3" * 5000])
    assert found(spark, long) == {3: "bad_number"}


def test_sound_rows(spark):
    e = spark.createDataFrame([(s,) for s in ELEMENTS], "symb string")
    t = spark.createDataFrame(SAMPLE, LINES)
    atoms = PF.sound_atoms(t, e).where(F.col("file_id") == 0).orderBy("line_id").collect()
    assert [(a["symb"], a["x"], a["y"], a["z"]) for a in atoms] == [("H", 0.0, 0.0, 0.0), ("C", 1.0, 20.0, 0.5)]
    heads = {r["line_id"]: r for r in PF.sound_headers(t, e).collect()}
    assert heads[2]["a1x"] == 1.0 and heads[2]["has_cell"]
    assert not heads[11]["has_cell"] and heads[11]["a1x"] is None
    diagonal = next(r for r in heads.values() if r["a2y"] == 2.0)
    assert (diagonal["a1x"], diagonal["a3z"], diagonal["a1y"]) == (1.0, 3.0, 0.0)


def test_table_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    t = spark.read.parquet(f"{d}/xyz_lines.parquet")
    e = spark.read.parquet(f"{d}/elements.parquet")
    global ELEMENTS
    keep, ELEMENTS = ELEMENTS, [r["symb"] for r in e.collect()]
    try:
        rows = [tuple(r) for r in t.select("line_id", "file_id", "line_no", "raw_line").distinct().collect()]
        got = {r["line_id"]: r["reason"] for r in PF.judged(t, e).collect()}
        assert got == brute(rows)
    finally:
        ELEMENTS = keep
