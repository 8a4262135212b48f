"""Schema changes between the files of made-up series."""

import datetime as dt

from moltide.operators import drift as DR

SCHEMA = "header_id long, series_id long, file_id long, frame int, header_text string, first_atom string, written_at timestamp, ingested_at timestamp"
T = dt.datetime(2024, 1, 1)
CELL = '"1.0 0.0 0.0 0.0 1.0 0.0 0.0 0.0 1.0"'


def table(spark, files, atom="H 1.0 2.0 3.0", base=0):
    rows = []
    for i, (series, file, hours, text) in enumerate(files):
        t = T + dt.timedelta(hours=hours)
        rows.append((base + i, series, file, 0, text, atom, t, t))
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, files):
    return sorted((r["series_id"], r["file_id"], r["field"], r["change"]) for r in DR.changes(table(spark, files)).collect())


def test_each_change(spark):
    files = [
        (1, 9, 0, f"Lattice={CELL} Properties=species:S:1:pos:R:3 energy=-1.5 time=1.0"),
        (1, 3, 5, f"energy = -1.5, TIME = 2.0, lattice = {CELL}, Properties = species:S:1:pos:R:3"),  # no change
        (1, 7, 50, f'box={CELL} Properties=species:I:1:pos:R:3:charge:R:1 energy="-1.5 eV"'),
        (1, 5, 51, '[[x]] cell=[[1, 0, 0], [0, 1, 0], [0, 0, 1]] Properties=element:I:1:pos:R:3 energy="-1.5 eV" temp=300'),
    ]
    assert changes(spark, files) == [
        (1, 5, "box", "renamed"), (1, 5, "box", "retyped"), (1, 5, "properties.charge", "removed"), (1, 5, "properties.species", "renamed"), (1, 5, "temp", "added"),
        (1, 7, "energy", "retyped"), (1, 7, "lattice", "renamed"), (1, 7, "properties.charge", "added"), (1, 7, "properties.species", "retyped"), (1, 7, "time", "removed"),
    ]


def test_other_quantities_are_not_renamed(spark):
    files = [(1, 1, 0, f"lattice={CELL} time=1.0"), (1, 2, 1, f"stress={CELL} temp=1.0")]
    assert changes(spark, files) == [(1, 2, "lattice", "removed"), (1, 2, "stress", "added"), (1, 2, "temp", "added"), (1, 2, "time", "removed")]


def test_nulls_repeats_and_empty(spark):
    files = [(1, 1, 0, "frame=1"), (1, 1, 0, None), (1, 2, 1, None), (1, 3, 2, "frame=2 e=1.0"), (2, 4, 0, ""), (None, 5, 0, "frame=1")]
    t = table(spark, files)
    got = [(r["file_id"], r["field"], r["change"]) for r in DR.changes(t.union(t)).collect()]
    assert got == [(3, "e", "added")]
    assert DR.changes(table(spark, [])).count() == 0


def test_kinds(spark):
    values = {"1": "whole", "-2": "whole", "1.0": "decimal", "1e3": "decimal", '"1 2 3"': "numbers3", CELL: "numbers9", "[[1,0,0],[0,1,0],[0,0,1]]": "bracketed", '"T T T"': "text", '"1.0 eV"': "text"}
    d = spark.createDataFrame([(k,) for k in values], "v string")
    assert {r["v"]: r["k"] for r in d.select("v", DR.kind_of(d.v).alias("k")).collect()} == values


def test_one_table(spark):
    files = [
        (1, 1, 0, f"Lattice={CELL} Properties=species:S:1:pos:R:3 energy=-1.5 time=1.0 odd=1"),
        (1, 2, 1, 'box="2 3 4" Properties=pos:R:3:element:S:1:tag:I:1 etot="-2.5 eV" frame_no=x'),
    ]
    t = table(spark, files[:1]).union(table(spark, files[1:], "1.0 2.0 3.0 C 7", 9))
    rows = {r["file_id"]: r for r in DR.consistent_table(t).collect()}
    assert rows[1]["energy"] == -1.5 and rows[1]["position"] == [1.0, 2.0, 3.0] and rows[1]["other_fields"] == ["odd"]
    assert rows[2]["energy"] == -2.5 and rows[2]["lattice"] == [2.0, 0, 0, 0, 3.0, 0, 0, 0, 4.0] and rows[2]["species"] == "C" and rows[2]["tag"] == 7
    assert rows[2]["failed_casts"] == ["frame"] and rows[1]["failed_casts"] == []


def test_unknown_names_are_renamed_by_their_values(spark):
    first = f"Lattice={CELL} Properties=species:S:1:pos:R:3:magmom:R:1 enthalpy=-812.25 gauge=0.5 note=alpha"
    then = f"Lattice={CELL} Properties=species:S:1:pos:R:3:spin:R:1 h_total=-811.75 flux=300.5 remark=alpha"
    assert changes(spark, [(1, 1, 0, first), (1, 2, 5, then)]) == [
        (1, 2, "enthalpy", "renamed"), (1, 2, "flux", "added"), (1, 2, "gauge", "removed"), (1, 2, "note", "renamed"), (1, 2, "properties.magmom", "renamed"),
    ]


def test_rate_over_frames_tells_a_clock(spark):
    rows = []
    for i, (frame, text) in enumerate([(1, "clock=2.5 heat=301.5"), (2, "clock=5.0 heat=299.0"), (3, "ticks=7.5 warmth=300.0"), (4, "ticks=10.0 warmth=302.0")]):
        t = T + dt.timedelta(hours=frame // 3)
        rows.append((i, 1, frame // 3, frame, text, "H 1 2 3", t, t))
    got = sorted((r["field"], r["change"]) for r in DR.changes(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("clock", "renamed"), ("heat", "renamed")]


def test_table_follows_renames_by_values(spark):
    files = [
        (1, 1, 0, "e_sys=-812.25 frame=1 gauge=0.5"),  # not known yet
        (1, 2, 30, "energy=-812.5 frame=2 flux=0.5"),
        (1, 3, 31, "h_total=-811.75 frame=3 flux=0.5"),
        (1, 4, 60, "h_sum=-812.0 frame=4 flux=0.5"),
        (1, 6, 61, "h_sum=-812.0 h_total=7.5 frame=5 flux=0.5"),  # the name given up stands for something else
        (2, 5, 0, "h_total=3.0"),
    ]
    rows = {r["file_id"]: r for r in DR.consistent_table(table(spark, files)).collect()}
    assert [rows[i]["energy"] for i in (1, 2, 3, 4, 6, 5)] == [-812.25, -812.5, -811.75, -812.0, -812.0, None]
    assert [[tuple(v) for v in rows[i]["other_values"]] for i in (1, 2, 3, 4, 6, 5)] == [
        [("gauge", "gauge", "0.5")], [("gauge", "flux", "0.5")], [("gauge", "flux", "0.5")], [("gauge", "flux", "0.5")], [("h_total", "h_total", "7.5"), ("gauge", "flux", "0.5")], [("h_total", "h_total", "3.0")],
    ]


def test_table_keeps_every_value(spark):
    files = [(1, 1, 0, 'energy="-2.5 eV" e=-3.0 time="1.5 ps" frame=12.0 temp=3.0D2 odd=1 odd=2 Properties=species:I:1:pos:R:3:tag:S:1'), (None, 2, 0, "energy=1.0"), (1, None, 0, "energy=2.0")]
    rows = {r["file_id"]: r for r in DR.consistent_table(table(spark, files, "8 1.0 x 3.0 A7")).collect()}
    r = rows[1]
    assert (r["energy"], r["time_fs"], r["frame_no"], r["temperature_k"], r["species"], r["position"], r["tag"]) == (-2.5, None, 12, 300.0, "O", None, None)
    assert r["failed_casts"] == ["time", "properties.pos", "properties.tag"] and r["other_fields"] == ["odd"]
    assert [tuple(v) for v in r["other_values"]] == [
        ("energy", "energy", "-2.5 eV"), ("energy", "e", "-3.0"), ("time", "time", "1.5 ps"), ("odd", "odd", "1"), ("odd", "odd", "2"), ("properties.pos", "properties.pos", "1.0 x 3.0"), ("properties.tag", "properties.tag", "A7"),
    ]
    assert rows[2]["energy"] == 1.0 and rows[None]["energy"] == 2.0
