"""Schemas that drift between files (problem 3): one typed table, and each change against the file before.

Header lines are read as maps from path to raw value and its kind. Statistics of (file, path, kind) give each
file's layout and what the values of each path are like; the layouts of successive files of a series are compared,
where a name that vanishes and a new one are one field renamed if their values are alike; and one table with typed
columns is projected from the maps, with the casts that failed.

Order of files: written_at, then file_id. Successive files are found inside each day first and the days of a
series are then linked by one row per day, so a series of any length never lies in one task.

Defined results: null and blank headers have no paths and change nothing (a file with no other header is
passed over); a path that stands in fewer than half of a file's readable headers is no part of its layout;
headers delivered twice (equal but for ingested_at) count once; rows without header_id, series_id or file_id take no part
in the changes but are read into the table, files without written_at come first. An empty table gives empty results.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltide.functions.elements import MASS
from moltide.operators.parse_faults import cell_numbers, fields, let, number
from moltide.session import broadcast_if_small, written

#: Weights of an equal kind or place and of known names in the likeness of two fields, and the least one of a renaming.
PART, NAME, LEAST = 0.2, 0.6, 0.65
#: Frames of a file whose headers are read in one task.
FRAMES = 256
#: Share of its mean that a quantity may differ by from file to file beside its spread.
NEAR = 0.05

#: Names under which one quantity is known to go, the first being the column of the consistent table.
#: A renaming is found by what the values are like; known names decide where that is not clear.
HEADER_NAMES = (
    "lattice cell box unit_cell h_matrix simulation_cell",
    "energy etot e potential_energy total_energy e_pot epot",
    "time t time_fs",
    "frame i frame_no frame_id step",
    "temp temperature t_inst",
    "pressure press p",
    "pbc periodic",
    "stress virial",
)
ENTRY_NAMES = (
    "species element elements symbols symbol type",
    "pos xyz positions position coords",
    "forces force frc",
    "velocities velo vel velocity momenta",
    "charge q partial_charge charges",
    "tag tags site_id",
)

#: Columns of the consistent table and the quantity each holds.
COLUMNS = {
    "lattice": "lattice", "energy": "energy", "time_fs": "time", "frame_no": "frame", "temperature_k": "temp", "pressure": "pressure", "pbc": "pbc", "stress": "stress", "species": "properties.species", "position": "properties.pos",
    "force": "properties.forces", "velocity": "properties.velocities", "charge": "properties.charge", "tag": "properties.tag",
}
#: Units of its columns; a number in another one is a failed cast.
UNITS = {"energy": "ev", "time": "fs", "temp": "k"}

PAIR = r'([A-Za-z_][\w.\-]*)\s*[=:]\s*("[^"]*"|\[\s*\[[^=]*?\]\s*\]|\[[^\]]*\]|[^\s,;]+)'
ENTRY_LIST = r"^[A-Za-z_][\w\-]*:[A-Za-z]:\d+(:[A-Za-z_][\w\-]*:[A-Za-z]:\d+)*$"
ONE = r"[+-]?(\d+\.?\d*|\.\d+)([eEdD][+-]?\d+)?"


def kind_of(value: Column) -> Column:
    """The kind of a raw value: whole, decimal, numbers3, numbers9, bracketed or text."""
    bare = F.trim(F.regexp_replace(value, '"', ""))
    return let(bare, lambda b: (
        F.when(b.rlike(r"^[+-]?\d+$"), "whole")
        .when(b.rlike(f"^{ONE}$"), "decimal")
        .when(b.rlike(rf"^{ONE}([\s,]+{ONE}){{2}}$"), "numbers3")
        .when(b.rlike(rf"^{ONE}([\s,]+{ONE}){{8}}$"), "numbers9")
        .when(b.rlike(r"^\[\s*\[[^\[\]]*\]\s*,?\s*\[[^\[\]]*\]\s*,?\s*\[[^\[\]]*\]\s*\]$"), "bracketed")
        .otherwise("text")
    ))


def paths(header: Column, first_atom: Column) -> Column:
    """Array of (path, kind, value) of one header; Properties entries get the fields of the first atom line as value."""
    bare = F.regexp_replace(header, r"(?i)^\s*properties\s*=\s*(?=\w+\s*:\s)", "")
    pairs = F.transform(
        F.regexp_extract_all(bare, F.lit(PAIR), F.lit(0)),
        lambda m: F.struct(F.lower(F.regexp_extract(m, r"^[\w.\-]+", 0)).alias("key"), F.regexp_replace(m, r"^[\w.\-]+\s*[=:]\s*", "").alias("value")),
    )
    is_list = lambda p: (p.key == "properties") & F.replace(p.value, F.lit('"'), F.lit("")).rlike(ENTRY_LIST)
    plain = F.transform(F.filter(pairs, lambda p: p.key != "properties"), lambda p: F.struct(p.key.alias("path"), kind_of(p.value).alias("kind"), F.trim(F.replace(p.value, F.lit('"'), F.lit(""))).alias("value")))

    def entries(spec, atom):
        n = (F.size(spec) / 3).cast("int")
        return F.aggregate(
            F.slice(spec, F.lit(1), n),
            F.struct(F.lit(0).alias("i"), F.lit(1).alias("at"), F.array().cast("array<struct<path string, kind string, value string>>").alias("found")),
            lambda a, _: let(F.coalesce(F.get(spec, a.i * 3 + 2).try_cast("int"), F.lit(0)), lambda w: F.struct(
                (a.i + 1).alias("i"),
                (a.at + w).alias("at"),
                F.array_append(a.found, F.struct(
                    F.concat(F.lit("properties."), F.lower(F.get(spec, a.i * 3))).alias("path"),
                    F.concat(F.upper(F.get(spec, a.i * 3 + 1)), F.lit(":"), w.cast("string")).alias("kind"),
                    F.array_join(F.slice(atom, a.at, w), " ").alias("value"),
                )).alias("found"),
            )),
            lambda a: a.found,
        )

    lists = F.transform(F.filter(pairs, is_list), lambda p: F.split(F.replace(p.value, F.lit('"'), F.lit("")), ":"))
    listed = let(F.get(lists, 0), lambda spec: F.when(spec.isNotNull(), entries(spec, F.coalesce(fields(first_atom), F.array().cast("array<string>")))))
    none = F.array().cast("array<struct<path string, kind string, value string>>")
    return F.concat(plain, F.coalesce(listed, none))


def path_values(headers: DataFrame) -> DataFrame:
    """Each distinct header with its (path, kind, value) array."""
    return (
        headers.select("header_id", "series_id", "file_id", "frame", "header_text", "first_atom", "written_at", F.floor(F.coalesce("frame", F.hash("header_id")) / FRAMES).alias("chunk"))
        # The headers of a file come together, those of a long one in chunks of frames: what is counted combines before it is shuffled.
        .repartition("series_id", "file_id", "chunk")
        .distinct()
        .withColumn("paths", paths(F.coalesce("header_text", F.lit("")), F.coalesce("first_atom", F.lit(""))))
        .drop("header_text", "first_atom", "chunk")
    )


def placed(headers: DataFrame) -> DataFrame:
    """The headers that belong to a file of a series."""
    return headers.where(F.col("header_id").isNotNull() & F.col("series_id").isNotNull() & F.col("file_id").isNotNull())


def exploded(values: DataFrame) -> DataFrame:
    """One row per header and path of path_values() with its kind, value, numbers and place; beside them one row per readable header (path null)."""
    p = values.where(F.size("paths") > 0)
    none = F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"))
    e = p.select("series_id", "file_id", "written_at", "frame", F.posexplode(F.array_append("paths", none)).alias("at", "e"))
    e = e.select("series_id", "file_id", "written_at", "frame", "at", "e.*")
    numbers = F.transform(F.regexp_extract_all("value", F.lit(ONE), F.lit(0)), lambda x: F.translate(x, "dD", "ee").try_cast("double"))
    return e.withColumn("numbers", numbers)


def path_profiles(values: DataFrame) -> DataFrame:
    """(series_id, file_id, path, kind, n_headers, written_at and sums of the path's values): what is counted of each kind of a path in a file."""
    x = F.filter("numbers", lambda v: v.isNotNull() & (v != 0))
    e = exploded(values).withColumn("x", x).withColumn("rate", F.when((F.size("numbers") == 1) & (F.col("frame") != 0), F.get("numbers", F.lit(0)) / F.col("frame")))
    total = lambda c: F.aggregate("x", F.lit(0.0), lambda a, v: a + (v if c == 1 else v * v))
    e = e.select("series_id", "file_id", "path", "kind", "written_at", "at", "rate", F.size("numbers").alias("width"), F.size("x").alias("n"), total(1).alias("s1"), total(2).alias("s2"), F.when(F.size("numbers") == 0, F.xxhash64("value")).alias("text"))
    return e.groupBy("series_id", "file_id", "path", "kind").agg(
        F.count("*").alias("n_headers"), F.min("written_at").alias("written_at"), F.avg("at").alias("at"), F.avg("width").alias("width"), F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"),
        F.min("rate").alias("rate_lo"), F.max("rate").alias("rate_hi"), F.min("text").alias("text_lo"), F.max("text").alias("text_hi"),
    )


def path_statistics(headers: DataFrame) -> DataFrame:
    """(series_id, file_id, written_at, path, kind, n_headers, n_readable): how often each kind of a path stands in a file."""
    per_file = Window.partitionBy("series_id", "file_id")
    n = path_profiles(path_values(placed(headers))).withColumn("n_readable", F.max(F.when(F.col("path").isNull(), F.col("n_headers"))).over(per_file))
    return n.where(F.col("path").isNotNull()).select("series_id", "file_id", "written_at", "path", "kind", "n_headers", "n_readable")


def layouts(values: DataFrame) -> DataFrame:
    """(series_id, file_id, written_at, layout map path -> profile) of path_values(): each file's paths with their most frequent kind and what their values are like.

    A profile has the kind, the numbers in a value (width), mean and spread of those that are not 0, the rate (value
    over frame number) if it is the same in all frames, the place among the entries of Properties, and the least and greatest text.
    """
    per_file = Window.partitionBy("series_id", "file_id")
    n = path_profiles(values).withColumn("of", F.max(F.when(F.col("path").isNull(), F.col("n_headers"))).over(per_file)).where(F.col("path").isNotNull())
    most = F.struct("n_headers", "kind")
    g = n.groupBy("series_id", "file_id", "path").agg(
        F.sum("n_headers").alias("total"), F.max("of").alias("of"), F.min("written_at").alias("written_at"), F.max_by("kind", most).alias("kind"), F.max_by("width", most).alias("width"), F.max_by("at", most).alias("at"),
        F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.min("rate_lo").alias("rate_lo"), F.max("rate_hi").alias("rate_hi"), F.min("text_lo").alias("text_lo"), F.max("text_hi").alias("text_hi"),
    ).where(F.col("total") * 2 >= F.col("of"))
    mean = F.when(F.col("n") > 0, F.col("s1") / F.col("n")).otherwise(0.0)
    spread = F.when(F.col("n") > 0, F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)))).otherwise(0.0) + NEAR * F.abs(mean)
    rate = F.when(F.abs(F.col("rate_hi") - F.col("rate_lo")) <= 1e-3 * F.abs("rate_hi"), F.col("rate_hi"))
    # Header keys come in any order; entries of Properties have a place.
    place = F.when(F.col("path").startswith("properties."), F.rank().over(per_file.orderBy(F.when(F.col("path").startswith("properties."), F.col("at")).otherwise(1e9))))
    g = g.select("series_id", "file_id", "path", "written_at", F.struct("kind", "width", mean.alias("mean"), spread.alias("spread"), rate.alias("rate"), place.alias("place"), "text_lo", "text_hi").alias("profile"))
    return g.groupBy("series_id", "file_id").agg(
        F.min("written_at").alias("written_at"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "profile")))).alias("layout")
    )


def with_day(lay: DataFrame) -> DataFrame:
    return lay.withColumn("day", F.coalesce(F.floor(F.unix_micros("written_at") / 86_400_000_000) if dict(lay.dtypes)["written_at"] == "timestamp" else F.unix_date(F.col("written_at").cast("date")), F.lit(-(10**9))).cast("long"))


def with_layout_before(lay: DataFrame) -> DataFrame:
    """Each file with the layout of the file before it in its series, null for the first."""
    d = with_day(lay)
    order = ["written_at", "file_id"]
    inside = Window.partitionBy("series_id", "day").orderBy(*order)
    last = d.groupBy("series_id", "day").agg(F.max_by("layout", F.struct(*order)).alias("closing"))
    days = last.withColumn("opening", F.lag("closing").over(Window.partitionBy("series_id").orderBy("day"))).drop("closing")
    return d.withColumn("own", F.lag("layout").over(inside)).join(days, ["series_id", "day"]).withColumn("before", F.coalesce("own", "opening")).drop("own", "opening", "day")


def _names() -> Column:
    pairs = [(n, g.split()[0]) for g in HEADER_NAMES for n in g.split()] + [(f"properties.{n}", f"properties.{g.split()[0]}") for g in ENTRY_NAMES for n in g.split()]
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def likeness(a: Column, b: Column, same_name: Column) -> Column:
    """How much two profiles look like one quantity.

    Values: 1 for one rate over the frames; else how near the means are beside the spreads, times how near the spreads are;
    for texts the share of equal ends of their range. A kind and a place in Properties count PART more if equal. Names that are
    known as one quantity count NAME more, as two quantities NAME less.
    """
    near = F.exp(-F.abs(a.mean - b.mean) / (a.spread + b.spread + 1e-12)) * F.exp(-F.abs(F.ln((a.spread + 1e-12) / (b.spread + 1e-12))) / 2)
    rates = F.coalesce(F.abs(a.rate - b.rate) <= 1e-3 * F.abs(a.rate), F.lit(False))
    texts = (F.coalesce((a.text_lo == b.text_lo).cast("double"), F.lit(0.0)) + F.coalesce((a.text_hi == b.text_hi).cast("double"), F.lit(0.0))) / 2
    wide = (F.least(a.width, b.width) >= 3) | (F.round(a.width) == F.round(b.width))
    values = F.when((a.width == 0) | (b.width == 0), F.when((a.width == 0) & (b.width == 0), texts).otherwise(0.0)).when(~wide, 0.0).when(rates, 1.0).otherwise(near)
    part = (a.kind == b.kind).cast("double") + F.coalesce((a.place == b.place).cast("double"), F.lit(0.0))
    return values + PART * part + F.coalesce(F.when(same_name, NAME).when(~same_name, -NAME), F.lit(0.0))


def kind(m: str, k: Column) -> Column:
    """The kind of a path in a layout."""
    return F.element_at(m, k)["kind"]


def matched(lay: DataFrame) -> DataFrame:
    """The files whose layout is not that of the file before, with gone, new and kept paths and the (old, to) pairs that go on as one field.

    Of the names that vanish and those that are new, the pairs that are most alike go on as one field, each name once, down
    to a likeness of LEAST.
    """
    f = with_layout_before(lay).where(F.col("before").isNotNull())
    names = _names()
    f = f.select(
        "series_id", "file_id", "written_at", "layout", "before",
        F.array_except(F.map_keys("before"), F.map_keys("layout")).alias("gone"),
        F.array_except(F.map_keys("layout"), F.map_keys("before")).alias("new"),
        F.array_intersect(F.map_keys("before"), F.map_keys("layout")).alias("kept"),
    ).where((F.size("gone") > 0) | (F.size("new") > 0) | F.exists("kept", lambda k: kind("before", k) != kind("layout", k)))
    entry = lambda k: k.startswith("properties.")
    alike = F.flatten(F.transform("gone", lambda g: F.transform(F.filter("new", lambda n: entry(n) == entry(g)), lambda n: F.struct(
        likeness(F.element_at("before", g), F.element_at("layout", n), F.element_at(names, g) == F.element_at(names, n)).alias("score"), g.alias("old"), n.alias("to")))))
    ranked = F.array_sort(F.transform(F.filter(alike, lambda p: p.score >= LEAST), lambda p: F.struct((-F.round(p.score, 9)).alias("rank"), p.old.alias("old"), p.to.alias("to"))))
    none = F.array().cast("array<struct<rank double, old string, to string>>")
    return f.withColumn("pairs", F.aggregate(ranked, none, lambda a, p: F.when(F.exists(a, lambda x: (x.old == p.old) | (x.to == p.to)), a).otherwise(F.array_append(a, p))))


def changes(headers: DataFrame) -> DataFrame:
    """(series_id, file_id, field, change): added, removed, renamed, retyped against the file before."""
    f = matched(written(layouts(path_values(placed(headers))), "layouts"))
    row = lambda field, change: F.struct(field.alias("field"), F.lit(change).alias("change"))
    matched_old, matched_new = F.transform("pairs", lambda p: p.old), F.transform("pairs", lambda p: p.to)
    rows = F.concat(
        F.transform(F.array_except("gone", matched_old), lambda k: row(k, "removed")),
        F.transform(F.array_except("new", matched_new), lambda k: row(k, "added")),
        F.transform("pairs", lambda p: row(p.old, "renamed")),
        F.transform(F.filter("pairs", lambda p: kind("before", p.old) != kind("layout", p.to)), lambda p: row(p.old, "retyped")),
        F.transform(F.filter("kept", lambda k: kind("before", k) != kind("layout", k)), lambda k: row(k, "retyped")),
    )
    return f.select("series_id", "file_id", F.explode(rows).alias("r")).select("series_id", "file_id", "r.field", "r.change")


def map_sorted(df: DataFrame, keys: list[str], order: list[str], fn: Callable, schema: str) -> DataFrame:
    """fn(state, row) on the rows of each key in order, with a dict of its own per key; the rows it returns. No key's rows are held."""

    def run(batches):
        key, state = None, {}
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                k = tuple(getattr(r, c) for c in keys)
                if k != key:
                    key, state = k, {}
                out.append(fn(state, r))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def followed(lay: DataFrame) -> DataFrame | None:
    """(series_id, file_id, origin map name -> first name, quantity map first name -> known quantity) of the series that rename a name not known; None if there are none.

    A renaming hands on the first name its field had in the series; a name given up so and used again is another field, marked by * and the file. Renames are followed inside
    each day first, the days of a series are then linked by one row per day. The quantity of a first name is its own or else the first known one among its later names.
    """
    names = _names()
    unknown = lambda p: F.element_at(names, p.old).isNull() | F.element_at(names, p.to).isNull()
    pairs = written(matched(lay).where(F.exists("pairs", unknown)).select("series_id", "file_id", F.transform("pairs", lambda p: p.old).alias("olds"), F.transform("pairs", lambda p: p.to).alias("tos")), "renames")
    if pairs.isEmpty():
        return None
    files = with_day(lay.select("series_id", "file_id", "written_at").join(pairs.select("series_id").distinct(), "series_id", "left_semi")).join(pairs, ["series_id", "file_id"], "left")

    def inside(state, r):
        if r.olds is not None:
            origins = [state.get(o, o) for o in r.olds]
            state.update({o: f"*{r.file_id}*{o}" for o in r.olds})
            state.update(zip(r.tos, origins))
        return r.series_id, r.file_id, r.written_at, r.day, list(state), list(state.values())

    def across(state, r):
        opening = dict(state)
        state.update({n: o if o.startswith("*") else opening.get(o, o) for n, o in zip(r.names, r.origins)})
        return r.series_id, r.day, list(opening), list(opening.values())

    at = dict(files.dtypes)
    listed = "names array<string>, origins array<string>"
    f = written(map_sorted(files, ["series_id", "day"], ["written_at", "file_id"], inside, f"series_id {at['series_id']}, file_id {at['file_id']}, written_at {at['written_at']}, day long, {listed}"), "origins")
    closing = f.groupBy("series_id", "day").agg(F.max_by(F.struct("names", "origins"), F.struct("written_at", "file_id")).alias("c")).select("series_id", "day", "c.*")
    opening = map_sorted(closing, ["series_id"], ["day"], across, f"series_id {at['series_id']}, day long, {listed}").select("series_id", "day", F.map_from_arrays("names", "origins").alias("opening"))
    own = F.map_from_arrays("names", F.transform("origins", lambda o: F.when(o.startswith("*"), o).otherwise(F.coalesce(F.element_at("opening", o), o))))
    f = f.join(opening, ["series_id", "day"]).select("series_id", "file_id", "written_at", F.map_concat(F.map_filter("opening", lambda k, _: ~F.array_contains("names", k)), own).alias("origin"))
    f = written(f, "followed")
    e = f.select("series_id", "written_at", "file_id", F.explode("origin").alias("name", "first")).withColumn("known", F.element_at(names, F.col("name"))).where(F.col("known").isNotNull())
    e = e.groupBy("series_id", "first").agg(F.min_by("known", F.struct("written_at", "file_id", "name")).alias("known"))
    q = e.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("first", "known"))).alias("quantity"))
    return f.drop("written_at").join(q, "series_id", "left")


def consistent_table(headers: DataFrame) -> DataFrame:
    """All headers under one schema, with the quantities whose value could not be cast in failed_casts.

    A name that is not known goes into the column of the quantity it was renamed from or to, as changes() finds it. other_values
    holds, as (field, name, value), whatever no column holds in full: other fields under the first name they had in the series, second
    values of a field, failed casts, and numbers with a unit.
    """
    names = _names()
    p = written(path_values(headers), "paths")
    seen = followed(written(layouts(placed(p)), "layouts"))
    known = lambda x: F.element_at(names, x)
    if seen is None:
        field = lambda x: F.coalesce(known(x), x)
    else:
        p = p.join(broadcast_if_small(seen, 1000)[0], ["series_id", "file_id"], "left")
        first = lambda x: F.coalesce(F.element_at("origin", x), x)
        field = lambda x: F.coalesce(known(x), let(first(x), lambda o: F.coalesce(known(o), F.element_at("quantity", o), F.regexp_replace(o, r"^\*.*\*", ""))))
    p = p.select("header_id", "series_id", "file_id", "frame", "written_at", F.transform("paths", lambda x: F.struct(field(x.path).alias("field"), x.path.alias("name"), x.value.alias("value"))).alias("e"))
    p = p.withColumn("e", let(F.transform("e", lambda x: x.field), lambda f: F.transform("e", lambda x, i: F.struct(x.field.alias("field"), x["name"].alias("name"), x.value.alias("value"), (F.array_position(f, x.field) == i + 1).alias("one")))))
    m = p.withColumn("m", F.map_from_entries(F.transform(F.filter("e", lambda x: x.one & x.field.isin(*COLUMNS.values())), lambda x: F.struct(x.field, x.value))))
    raw = lambda q: F.element_at("m", F.lit(q))
    one = lambda q: let(raw(q), lambda v: F.when(v.rlike(rf"(?i)^({ONE})\s*({UNITS[q]})?$" if q in UNITS else f"^({ONE})"), number(F.regexp_extract(v, f"^({ONE})", 1))))
    whole = lambda q: let(raw(q), lambda v: F.coalesce(v.try_cast("long"), let(number(v), lambda d: F.when((d == F.floor(d)) & (F.abs(d) < 2**53), d.cast("long")))))
    all_numbers = lambda a, n: F.when((F.size(a) == n if n else F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull()), a)
    listed = lambda q, n=None: let(F.transform(fields(F.regexp_replace(raw(q), r"[\[\],]+", " ")), number), lambda a: all_numbers(a, n))
    symbols = F.create_map(*[F.lit(x) for i, s in enumerate(MASS) for x in (str(i + 1), s)])
    typed = {
        "lattice": cell_numbers(raw("lattice")),
        "energy": one("energy"),
        "time_fs": one("time"),
        "frame_no": whole("frame"),
        "temperature_k": one("temp"),
        "pressure": one("pressure"),
        "pbc": raw("pbc"),
        "stress": listed("stress"),
        "species": let(raw("properties.species"), lambda v: F.coalesce(F.element_at(symbols, v), v)),
        "position": listed("properties.pos", 3),
        "force": listed("properties.forces", 3),
        "velocity": listed("properties.velocities", 3),
        "charge": one("properties.charge"),
        "tag": whole("properties.tag"),
    }
    t = m.select("header_id", "series_id", "file_id", "frame", "written_at", "m", "e", *[c.alias(k) for k, c in typed.items()])
    failed = F.filter(F.array(*[F.when(F.map_contains_key("m", F.lit(q)) & F.col(k).isNull(), F.lit(q)) for k, q in COLUMNS.items()]), lambda x: x.isNotNull())
    t = t.withColumn("failed_casts", failed)
    united = lambda x: x.field.isin("energy", "time", "temp", "pressure", "properties.charge") & ~x.value.rlike(f"^{ONE}$")
    rest = F.filter("e", lambda x: ~x.one | ~x.field.isin(*COLUMNS.values()) | F.array_contains("failed_casts", x.field) | united(x))
    other = F.array_distinct(F.transform(F.filter("e", lambda x: ~x.field.isin(*COLUMNS.values())), lambda x: x.field))
    return t.withColumn("other_fields", F.array_sort(other)).withColumn("other_values", F.transform(rest, lambda x: F.struct(x.field.alias("field"), x["name"].alias("name"), x.value.alias("value")))).drop("m", "e")
