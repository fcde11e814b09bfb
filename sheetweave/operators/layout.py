"""Tables in grids: header tests as column expressions, and regions of filled cells, found in strips of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .linked import components

#: Rows after a header that are looked at; rows of a sheet in which regions are looked for at once.
FOLLOWERS, STRIP = 3, 4096


def filled(cells: Column) -> Column:
    return F.filter(cells, lambda c: F.trim(c) != "")


def header_like(cells: Column) -> Column:
    """At least two cells, all but one with a letter, at most one of digits with at most one point."""
    own = filled(cells)
    letters = F.size(F.filter(own, lambda c: c.rlike(r"\p{L}")))
    numbers = F.size(F.filter(own, lambda c: F.trim(c).rlike(r"^(?=.*[0-9])[0-9]*\.?[0-9]*$")))
    return (F.size(own) >= 2) & (letters >= F.greatest(F.lit(2), F.size(own) - 1)) & (numbers <= 1)


def profile(grid: DataFrame) -> DataFrame:
    """Rows, widest row, blank rows and the median of filled cells, for each source."""
    n = F.size(filled(F.col("cells")))
    return grid.groupBy("source_id").agg(F.count("*").alias("row_count"), F.max(F.size("cells")).cast("bigint").alias("column_count"), F.count_if(n == 0).alias("blank_rows"), F.percentile(n, F.lit(0.5)).alias("median_filled"))


def median_of(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """The exact median of each group, the mean of the two middle values where there are two; from partial counts of each value."""
    return rows.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias(name))


def footers(grid: DataFrame) -> DataFrame:
    """Rows with a cell that says total, grand total or rounding error and nothing else."""
    marks = F.array(F.lit("total"), F.lit("grand total"), F.lit("rounding error"))
    return grid.where(F.arrays_overlap(F.transform("cells", lambda c: F.lower(F.trim(c))), marks))


def occupancy(rows: list[list[str]]) -> np.ndarray:
    """Filled cells; a blank between two filled ones of a column counts as filled, and the first row as blank."""
    width = max((len(r) for r in rows), default=0)
    full = np.array([[i < len(r) and bool(r[i].strip()) for i in range(width)] for r in rows], bool).reshape(len(rows), width)
    closed = full.copy()
    closed[1:-1] |= full[:-2] & full[2:]
    closed[:1] = False
    return fill_holes(closed)


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true cells by row (row, first, last), and the number of each one's region.

    Runs that touch in neighbouring rows are joined, row after row, so the time
    follows the cells, whatever shape a region has.
    """
    edges = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edges == 1)
    last = np.nonzero(edges == -1)[1] - 1
    root = list(range(len(row)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    at = np.searchsorted(row, np.arange(len(mask) + 1))
    for r in range(1, len(mask)):
        i, j = at[r - 1], at[r]
        while i < at[r] and j < at[r + 1]:
            if first[i] <= last[j] and first[j] <= last[i]:
                a, b = sorted((find(i), find(j)))
                root[b] = a
            if last[i] < last[j]:
                i += 1
            else:
                j += 1
    return row, first, last, np.array([find(x) for x in range(len(root))], int)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Blank cells that no path of blanks joins to the border become filled."""
    row, first, last, region = _stretches(np.pad(~mask, 1, constant_values=True))
    out = mask.copy()
    for r, a, b, k in zip(row, first, last, region, strict=True):
        if k != region[0]:
            out[r - 1, a - 1 : b] = True
    return out


def boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Bounding boxes (first row, last row, first column, last column) of 4-connected regions, in order."""
    found: dict[int, tuple[int, int, int, int]] = {}
    for r, a, b, k in zip(*(x.tolist() for x in _stretches(mask)), strict=True):
        top, _, left, right = found.get(k, (r, r, a, b))
        found[k] = (top, r, min(left, a), max(right, b))
    return sorted(found.values())


def _cells(part: pd.DataFrame, strip: int) -> tuple[np.ndarray, bool, bool]:
    """A strip's occupancy, and whether the sheet goes on above and below it.  ``part`` also has the rows next to the strip."""
    first, last, width = (int(part[c].iloc[0]) for c in ("strip", "last", "width"))
    top, bottom = first * strip, min(first * strip + strip - 1, last)
    full = np.zeros((bottom - top + 3, width), bool)
    for r, active in zip(part["row_id"], part["active"], strict=True):
        full[r - top + 1, np.asarray(active, int)] = True
    closed = full[1:-1] | (full[:-2] & full[2:])
    if top == 0:
        closed[:1] = False
    return closed, top > 0, bottom < last


def _blanks(closed: np.ndarray, above: bool, below: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of blank cells as ``_stretches`` gives them; regions that reach the sheet's border within the strip are -1."""
    padded = np.pad(~closed, ((int(not above), int(not below)), (1, 1)), constant_values=True)
    row, first, last, region = _stretches(padded)
    outside = np.unique(region[(first == 0) | (last == padded.shape[1] - 1)])
    return row - int(not above), first - 1, last - 1, np.where(np.isin(region, outside), -1, region)


_RUN = "source_id string, border long, strip long, first int, last int, region int"
_EDGE = "source_id string, s1 long, r1 int, s2 long, r2 int"
_PART = "source_id string, strip long, region int, row_start int, row_end int, column_start int, column_end int, open boolean, runs array<struct<border:bigint,first:int,last:int>>"


def _at_edges(n: int, strip: int, above: bool, below: bool, row: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Which runs lie on an edge behind which the sheet goes on, and the number of that border: that of the strip below it."""
    return [(np.nonzero(row == r)[0], border) for go_on, r, border in ((above, 0, strip), (below, n - 1, strip + 1)) if go_on]


def _open_blanks(strip: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        closed, above, below = _cells(part, strip)
        row, first, last, region = _blanks(closed, above, below)
        key, n = part["source_id"].iloc[0], int(part["strip"].iloc[0])
        found = [(key, border, n, first[i], last[i], region[i]) for at, border in _at_edges(len(closed), n, above, below, row) for i in at]
        return pd.DataFrame(found, columns=["source_id", "border", "strip", "first", "last", "region"])

    return run


def _met(runs: pd.DataFrame) -> pd.DataFrame:
    """Regions of which runs touch across one border between two strips; the sheet's outside is region -1 of strip -1."""
    border = runs["border"].iloc[0]
    upper, lower = (runs[runs["strip"] == s].sort_values("first")[["first", "last", "region"]].to_numpy() for s in (border - 1, border))
    i = j = 0
    found = set()
    while i < len(upper) and j < len(lower):
        if upper[i][0] <= lower[j][1] and lower[j][0] <= upper[i][1]:
            a, b = ((s if r >= 0 else -1, int(r)) for s, r in ((border - 1, upper[i][2]), (border, lower[j][2])))
            if a != b:
                found.add((*a, *b))
        if upper[i][1] < lower[j][1]:
            i += 1
        else:
            j += 1
    return pd.DataFrame([(runs["source_id"].iloc[0], *e) for e in sorted(found)], columns=["source_id", "s1", "r1", "s2", "r2"])


def _joined(runs: DataFrame) -> DataFrame:
    """``node, component`` of regions that touch across borders, as structs of source, strip and region."""
    edges = runs.groupBy("source_id", "border").applyInPandas(_met, _EDGE)
    return components(edges.select(*(F.struct("source_id", F.col(f"s{i}").alias("strip"), F.col(f"r{i}").alias("region")).alias(n) for i, n in ((1, "a"), (2, "b")))))


def _parts(strip: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        closed, above, below = _cells(part, strip)
        key, n = part["source_id"].iloc[0], int(part["strip"].iloc[0])
        row, first, last, region = _blanks(closed, above, below)
        outside = part["outside"].iloc[0]
        hole = ~np.isin(region, [-1, *(outside if outside is not None else [])])
        for r, a, b in zip(row[hole], first[hole], last[hole], strict=True):
            closed[r, a : b + 1] = True
        row, first, last, region = _stretches(closed)
        runs: dict[int, list] = {}
        for at, border in _at_edges(len(closed), n, above, below, row):
            for i in at:
                runs.setdefault(int(region[i]), []).append({"border": border, "first": int(first[i]), "last": int(last[i])})
        found: dict[int, tuple[int, int, int, int]] = {}
        for r, a, b, k in zip(*(x.tolist() for x in (row, first, last, region)), strict=True):
            top, _, left, right = found.get(k, (r, r, a, b))
            found[k] = (top, r, min(left, a), max(right, b))
        down = n * strip
        told = [(key, n, k, t + down, b + down, left, right, k in runs, runs.get(k, [])) for k, (t, b, left, right) in found.items()]
        return pd.DataFrame(told, columns=["source_id", "strip", "region", "row_start", "row_end", "column_start", "column_end", "open", "runs"])

    return run


def regions(grid: DataFrame, strip: int = STRIP) -> DataFrame:
    """``source_id, row_start, row_end, column_start, column_end`` of the regions of filled cells of each sheet, from 0.

    Rows are counted by ``row_id`` from 0; a row that isn't there is blank.  A
    blank between two filled cells of a column counts as filled, the first row
    as blank, and blanks that no path of blanks joins to the border are filled.
    Sheets are worked on in strips of rows.  Only what lies on the border of two
    strips is joined across it: first blanks, which tells holes from the outside,
    then filled cells.  A sheet of one strip needs neither.
    """
    filled = F.expr(r"coalesce(filter(transform(cells, (c, i) -> if(c rlike '(?U)[^\\s\\x1c-\\x1f]', i, null)), i -> i is not null), array())")
    sizes = grid.groupBy("source_id").agg(F.max("row_id").cast("long").alias("last"), F.greatest(F.max(F.size("cells")), F.lit(0)).alias("width"))
    told = sizes.select(F.col("source_id").alias("_s"), "last", "width")
    home = F.array(*(F.floor((F.col("row_id") + d) / strip).cast("long") for d in (-1, 0, 1)))
    cut = grid.select("source_id", F.col("row_id").cast("long").alias("row_id"), filled.alias("active"), F.explode(F.array_distinct(home)).alias("strip"))
    cut = cut.join(told, F.col("source_id").eqNullSafe(F.col("_s"))).drop("_s").where(F.col("strip").between(0, F.floor(F.col("last") / strip)))
    box = ["row_start", "row_end", "column_start", "column_end"]
    by = ["source_id", "strip"]
    tall = F.col("last") >= strip
    nothing_outside = F.lit(None).cast("array<int>").alias("outside")
    one = cut.where(~tall).withColumn("outside", nothing_outside).groupBy(*by).applyInPandas(_parts(strip), _PART).select("source_id", *box)
    if sizes.where(tall).isEmpty():
        return one
    long = cut.where(tall)
    reached = _joined(long.groupBy(*by).applyInPandas(_open_blanks(strip), _RUN)).where("component.strip = -1 and node.strip >= 0")
    outside = reached.groupBy(F.col("node.source_id").alias("_s"), F.col("node.strip").alias("_n")).agg(F.collect_set("node.region").alias("outside"))
    parts = long.join(outside, F.col("source_id").eqNullSafe(F.col("_s")) & (F.col("strip") == F.col("_n")), "left").drop("_s", "_n")
    parts = checkpointed(parts.groupBy(*by).applyInPandas(_parts(strip), _PART))
    runs = parts.where("open").select("source_id", "strip", "region", F.explode("runs").alias("x")).select("source_id", "x.border", "strip", "x.first", "x.last", "region")
    node = F.struct("source_id", "strip", "region")
    across = parts.where("open").withColumn("node", node).join(_joined(runs), "node", "left").withColumn("whole", F.coalesce("component", "node"))
    across = across.groupBy("whole").agg(F.min("row_start").alias("row_start"), F.max("row_end").alias("row_end"), F.min("column_start").alias("column_start"), F.max("column_end").alias("column_end"))
    return one.unionByName(parts.where("not open").select("source_id", *box)).unionByName(across.select("whole.source_id", *box))
