"""Rows of line-oriented extended XYZ that fail to parse (problem 1).

Lines of a file follow each other in blocks: a count line, a header line, that many atom lines. The
place of a line in its block decides how it is judged, so the blocks are found first, then

1. structural checks (unpaired quotes, number of fields) are made per line,
2. the symbol, the three coordinates and the cell of a line are exploded into (column, value); each
   distinct value of a column is cast once; those that fail form a dictionary of invalid values with
   their reason, which is joined back to the lines.

Files may be of any length: they are cut into stretches of ``STRETCH`` lines. The chain of count
lines is followed inside each stretch, and a table with one row per stretch and possible way through it
links the stretches, so no task sees a whole file's lines.

Defined results: a null raw_line counts as an empty text. A line without file_id or line_no, and lines
that no block reaches, belong to no block and are neither sound nor faulty. If a count line is not
where the chain expects it, the chain goes on at the next whole-number line. Lines delivered twice
(equal line_id) count once; two ids at one place are both judged by that place. An empty table gives
empty results. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltide.operators.grouped import group_ids, map_groups
from moltide.session import broadcast_if_small, written

STRETCH = 65536

#: The reasons, in the order in which they apply.
REASONS = ("quoting", "column_count", "bad_symbol", "bad_number", "bad_lattice")

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eEdD][+-]?\d+)?$"
BLANK = r"[ \t\r\n\x0B\f]+"
WHOLE = r"^\s*\d{1,9}\s*$"
PROPERTY_LIST = r'(?i)\bproperties\s*=\s*"?([A-Za-z_]\w*:[A-Za-z]:\d+(?::[A-Za-z_]\w*:[A-Za-z]:\d+)*)'
CELL_KEY = r"(?i)(?<![A-Za-z0-9_])(?:lattice|cell)\s*[=:]\s*"
CELL_VALUE = CELL_KEY + r'("[^"]*"|\[\s*\[[^=]*\]|\[[^\]=]*\]|[^",\[=]*?(?=,|\s+\w+\s*=|$))'


def let(value: Column, body) -> Column:
    """body(value), with value computed once instead of once per use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def number(text: Column) -> Column:
    """The finite double a decimal text (exponent marked by E or D) stands for, null if it is none."""
    value = F.when(text.rlike(NUMBER), F.translate(text, "dD", "ee").try_cast("double"))
    return F.nullif(F.nullif(value, F.lit(float("inf"))), F.lit(float("-inf")))


def fields(text: Column) -> Column:
    """Blank-separated fields; an empty array for a blank text."""
    return F.filter(F.split(text, BLANK), lambda f: f != "")


def cell_text(header: Column) -> Column:
    """The text of the Lattice or cell value with its quotes or brackets, null if the header has none."""
    return F.when(header.rlike(CELL_KEY), F.regexp_extract(header, CELL_VALUE, 1))


def cell_numbers(value: Column) -> Column:
    """9 doubles from a quoted list of 9, a diagonal of 3, or 3 bracketed rows of 3; null for anything else."""
    bare = F.regexp_replace(value, r'^[\s"]+|[\s"]+$', "")
    row = r"\[((?:[^\[\],]+,){2}[^\[\],]+)\]"
    rows = F.regexp_replace(bare, rf"^\[\s*{row}\s*,\s*{row}\s*,\s*{row}\s*\]$", "$1,$2,$3")
    one = lambda part: F.trim(F.regexp_replace(part, r"\s", " "))
    listed = F.when(bare.startswith("["), F.transform(F.split(rows, ","), lambda x: number(one(x)))).otherwise(F.transform(fields(bare), number))
    zero = F.lit(0.0)
    spread = lambda d: F.when(F.size(d) == 3, F.array(F.get(d, 0), zero, zero, zero, F.get(d, 1), zero, zero, zero, F.get(d, 2))).when(F.size(d) == 9, d)
    return let(let(listed, spread), lambda d: F.when(F.forall(d, lambda x: x.isNotNull()), d))


def _layout(header: Column) -> Column:
    """Struct (n, s, p): number of fields, symbol field, first position field from the Properties list; 4, 1, 2 without one."""
    entry = lambda i, spec: F.struct(F.lower(F.get(spec, i * 3)).alias("name"), F.lower(F.get(spec, i * 3 + 1)).alias("kind"), F.get(spec, i * 3 + 2).try_cast("int").alias("n"))
    step = lambda a, e: F.struct(
        (a.n + e.n).alias("n"),
        F.when((a.s == 0) & (e.kind == "s") & e["name"].isin("species", "symbol", "symbols", "element"), a.n + 1).otherwise(a.s).alias("s"),
        F.when((a.p == 0) & (e.kind == "r") & (e.n == 3) & e["name"].isin("pos", "position", "positions", "xyz"), a.n + 1).otherwise(a.p).alias("p"),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("s"), F.lit(0).alias("p"))
    done = lambda a: F.struct(F.when(a.n > 0, a.n).otherwise(4).alias("n"), F.when(a.s > 0, a.s).otherwise(1).alias("s"), F.when(a.p > 0, a.p).otherwise(2).alias("p"))
    parts = F.filter(F.split(F.regexp_extract(header, PROPERTY_LIST, 1), ":"), lambda x: x != "")
    return let(parts, lambda spec: F.aggregate(F.transform(F.slice(spec, F.lit(1), (F.size(spec) / 3).cast("int")), lambda _, i: entry(i, spec)), start, step, done))


def _chain(gid: np.ndarray, at: np.ndarray, to: np.ndarray, width: int) -> np.ndarray:
    """For each row the first row of the same group whose `at` is `to` or more; its own number if there is none."""
    i = np.searchsorted(gid * width + at, gid * width + np.minimum(to, width - 1))
    own = np.arange(len(at))
    inside = (i < len(at)) & (gid[np.minimum(i, len(at) - 1)] == gid)
    return np.where(inside, i, own)


def _reached(root: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Mask of rows on the chains from root, by doubling the pointers."""
    mask = np.zeros(len(nxt), bool)
    mask[root] = True
    while True:
        more = mask.copy()
        more[nxt[mask]] = True
        if (nxt[nxt] == nxt).all():
            return more
        mask, nxt = more, nxt[nxt]


def _exits(stretch: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Runs of candidate lines with the line expected after the last block they lead to in this stretch."""
        c = pdf.drop_duplicates(["file_id", "k", "line_no"]).reset_index(drop=True)
        gid, k, at = group_ids(c, ["file_id", "k"]), c.k.to_numpy("int64"), c.line_no.to_numpy("int64")
        after = at + c.n.to_numpy("int64") + 2
        nxt = _chain(gid, at - k * stretch, after - k * stretch, stretch + 1)
        while (nxt[nxt] != nxt).any():
            nxt = nxt[nxt]
        out = np.maximum(after[nxt], (k + 1) * stretch)
        new = np.ones(len(c), bool)
        new[1:] = (gid[1:] != gid[:-1]) | (out[1:] != out[:-1])
        last = np.append(new[1:], True)
        return pd.DataFrame({"file_id": c.file_id[new], "k": k[new], "lo": at[new], "hi": at[last], "out": out[new]})

    return run


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The first block start of each stretch, following the links between the stretches of a file."""
    gid, lo, hi, out = group_ids(pdf, ["file_id"]), *(pdf[c].to_numpy("int64") for c in ("lo", "hi", "out"))
    nxt = _chain(gid, hi, out, int(max(hi.max(), out.max())) + 2)
    root = np.searchsorted(gid, np.arange(gid[-1] + 1))
    mask = _reached(root, nxt)
    entry = lo.copy()
    step = mask & (nxt != np.arange(len(nxt)))
    entry[nxt[step]] = np.maximum(out[step], lo[nxt[step]])
    return pd.DataFrame({"file_id": pdf.file_id[mask], "k": pdf.k[mask], "entry": entry[mask]})


def _walk(stretch: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """All block starts of a stretch from its first."""
        c = pdf.drop_duplicates(["file_id", "k", "line_no"]).reset_index(drop=True)
        gid, off = group_ids(c, ["file_id", "k"]), c.k.to_numpy("int64") * stretch
        at = c.line_no.to_numpy("int64") - off
        nxt = _chain(gid, at, at + c.n.to_numpy("int64") + 2, stretch + 1)
        first = np.searchsorted(gid, np.arange(gid[-1] + 1))
        root = np.searchsorted(gid * (stretch + 1) + at, gid[first] * (stretch + 1) + (c.entry.to_numpy("int64") - off)[first])
        return c[_reached(root, nxt)][["file_id", "k", "line_no", "n"]]

    return run


def block_starts(lines: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(file_id, k, line_no, n): the true count lines, k the stretch they lie in."""
    cand = (
        lines.where(F.col("raw_line").rlike(WHOLE) & F.col("file_id").isNotNull() & F.col("line_no").isNotNull())
        .select("file_id", F.floor(F.col("line_no") / stretch).cast("long").alias("k"), F.col("line_no").cast("long").alias("line_no"), F.trim(F.regexp_replace("raw_line", r"\s", "")).cast("long").alias("n"))
    )
    t = dict(lines.dtypes)["file_id"]
    exits = map_groups(cand, ["file_id", "k"], ["line_no"], _exits(stretch), f"file_id {t}, k long, lo long, hi long, out long")
    entries = map_groups(exits, ["file_id"], ["hi"], _entries, f"file_id {t}, k long, entry long")
    return map_groups(cand.join(entries, ["file_id", "k"]), ["file_id", "k"], ["line_no"], _walk(stretch), f"file_id {t}, k long, line_no long, n long")


def placed(lines: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Each distinct line with its block start, the block's atom count and layout, and its role (0 count, 1 header, 2.. atom)."""
    starts = written(block_starts(lines, stretch), "block-starts")
    own = lines.where(F.col("file_id").isNotNull() & F.col("line_no").isNotNull()).select(
        "line_id", "file_id", F.floor(F.col("line_no") / stretch).cast("long").alias("k"), F.col("line_no").cast("long").alias("line_no"), F.coalesce("raw_line", F.lit("")).alias("raw_line")
    )
    # A block that runs over the end of a stretch is announced in each later stretch, with its header's layout.
    over = (
        starts.withColumn("last", F.floor((F.col("line_no") + F.col("n") + 1) / stretch))
        .where(F.col("last") > F.col("k"))
        .withColumn("to", F.explode(F.sequence(F.col("k") + 1, F.col("last"))))
    )
    heads = own.select("file_id", (F.col("line_no") - 1).alias("line_no"), _layout(F.col("raw_line")).alias("lay"))
    over = over.join(heads, ["file_id", "line_no"], "left").dropDuplicates(["file_id", "line_no", "to"])
    lay = "struct<n int, s int, p int>"
    begin = F.struct(F.col("line_no").alias("at"), F.col("n"))
    null = lambda kind: F.lit(None).cast(kind)
    u = (
        own.select("line_id", "file_id", "k", "line_no", "raw_line", null("struct<at bigint, n bigint>").alias("b"), null(lay).alias("l"), F.lit(1).alias("typ"))
        .unionByName(starts.select(null(dict(own.dtypes)["line_id"]).alias("line_id"), "file_id", "k", "line_no", null("string").alias("raw_line"), begin.alias("b"), null(lay).alias("l"), F.lit(0).alias("typ")))
        .unionByName(over.select(null(dict(own.dtypes)["line_id"]).alias("line_id"), "file_id", F.col("to").alias("k"), (F.col("to") * stretch - 1).alias("line_no"), null("string").alias("raw_line"), begin.alias("b"), F.col("lay").alias("l"), F.lit(0).alias("typ")))
    )
    w = Window.partitionBy("file_id", "k").orderBy("line_no", "typ", "line_id").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("b", F.last("b", ignorenulls=True).over(w)).withColumn("role", F.col("line_no") - F.col("b.at"))
    u = u.withColumn("l", F.last(F.when(F.col("typ") == 0, F.col("l")).when(F.col("role") == 1, _layout(F.col("raw_line"))), ignorenulls=True).over(w))
    return (
        u.where((F.col("typ") == 1) & (F.col("role") <= F.col("b.n") + 1))
        .dropDuplicates(["file_id", "k", "line_no", "line_id"])
        .select("line_id", "file_id", F.col("b.at").alias("block"), "line_no", "role", "raw_line", F.coalesce(F.col("l.n"), F.lit(4)).alias("want"), F.coalesce(F.col("l.s"), F.lit(1)).alias("s"), F.coalesce(F.col("l.p"), F.lit(2)).alias("p"))
    )


#: Copies of the dictionary of invalid values where it is too large to be broadcast: a value of a third of all lines meets as many tasks.
SALTS = 32


def judged(lines: DataFrame, elements: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(line_id, reason): one row per faulty header or atom line, with the first reason that applies."""
    return judged_placed(written(placed(lines, stretch), "placed-lines"), elements)


def judged_placed(lines: DataFrame, elements: DataFrame) -> DataFrame:
    """As judged(), of lines that placed() has given their place."""
    at = lines.where(F.col("role") >= 1)
    f = fields(F.col("raw_line"))
    atom = F.col("role") >= 2
    quotes = F.length("raw_line") - F.length(F.replace("raw_line", F.lit('"'), F.lit("")))
    at = at.withColumn("f", F.when(atom, f)).withColumn(
        "broken", F.when(quotes % 2 == 1, 0).when(atom & (F.size("f") != F.col("want")), 1)
    )
    value = lambda rank, v: F.struct(F.lit(rank).alias("col"), v.alias("v"))
    get = lambda i: F.get(F.col("f"), i)
    values = F.when(
        F.col("broken").isNotNull(), F.array(value(-1, F.lit(None).cast("string")))
    ).when(
        atom, F.array(value(2, get(F.col("s") - 1)), *[value(3, get(F.col("p") - 1 + i)) for i in range(3)])
    ).otherwise(F.array(value(4, cell_text(F.col("raw_line")))))
    long = at.select("line_id", "broken", F.explode(values).alias("e")).select("line_id", "broken", "e.col", "e.v")
    # Every distinct value of a column is cast once; what fails is the dictionary.
    distinct = long.where(F.col("broken").isNull() & F.col("v").isNotNull()).groupBy("col", "v").agg(F.min("line_id").alias("example"))
    known = elements.where(F.col("symb").isNotNull()).select(F.col("symb").alias("v"), F.lit(2).alias("col"), F.lit(True).alias("known")).distinct()  # at most the known elements
    fine = F.when(F.col("col") == 2, F.col("known").isNotNull()).when(F.col("col") == 3, number(F.col("v")).isNotNull()).otherwise(cell_numbers(F.col("v")).isNotNull())
    invalid, small = broadcast_if_small(distinct.join(F.broadcast(known), ["col", "v"], "left").where(~fine).select("col", "v"), 200)
    looked = long.where(F.col("broken").isNull())
    if small:
        by_value = looked.join(invalid, ["col", "v"])
    else:
        salts = invalid.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        by_value = looked.withColumn("salt", F.pmod(F.hash("line_id"), F.lit(SALTS))).join(salts, ["col", "v", "salt"])
    by_value = by_value.select("line_id", F.col("col").alias("rank"))
    by_shape = long.where(F.col("broken").isNotNull()).select("line_id", F.col("broken").alias("rank"))
    return (
        by_value.unionByName(by_shape).groupBy("line_id").agg(F.min("rank").alias("rank"))
        .select("line_id", F.element_at(F.array(*map(F.lit, REASONS)), F.col("rank") + 1).alias("reason"))
    )


def sound_atoms(lines: DataFrame, elements: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Atom lines without fault as (line_id, file_id, block, at_idx, symb, x, y, z)."""
    every = written(placed(lines, stretch), "placed-lines")
    at = every.where(F.col("role") >= 2)
    f = fields(F.col("raw_line"))
    get = lambda i: F.get(f, i)
    return at.join(judged_placed(every, elements), "line_id", "left_anti").select(
        "line_id", "file_id", "block", (F.col("role") - 2).cast("int").alias("at_idx"), get(F.col("s") - 1).alias("symb"), *[number(get(F.col("p") - 1 + i)).alias(c) for i, c in enumerate("xyz")]
    )


def sound_headers(lines: DataFrame, elements: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Header lines without fault as (line_id, file_id, block, has_cell, a1x .. a3z)."""
    every = written(placed(lines, stretch), "placed-lines")
    at = every.where(F.col("role") == 1)
    cell = cell_numbers(cell_text(F.col("raw_line")))
    names = [f"a{i}{c}" for i in (1, 2, 3) for c in "xyz"]
    return at.join(judged_placed(every, elements), "line_id", "left_anti").withColumn("cell", cell).select(
        "line_id", "file_id", "block", F.col("cell").isNotNull().alias("has_cell"), *[F.get("cell", i).alias(n) for i, n in enumerate(names)]
    )
