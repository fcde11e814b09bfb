"""Table and metadata blocks of grids.

Everything that looks at a row and its neighbours is a window expression, and
everything that compares rows with a table's span is a join that is bounded by
the next blank row, so long sheets spread over tasks.  Rows are counted by
``row_id`` from 0 without gaps.  Only the choice among overlapping candidates, a
fold over the few rows that can start a table, is handled grid by grid.  Windows look a few rows ahead, so they run in
strips that also see the rows after them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed
from .inspection import structure_hints
from .layout import header_like, regions
from .scan import running_last

# How far a header looks down, what makes a later header stronger, and the share of cells a body row has.
FOLLOW, FOLLOW_BODY, AHEAD, WIDER, NEW_COLUMNS, SHORT, SHORT_SHARE, BODY_SHARE = 3, 5, 6, 4, 2, 10, 0.75, 0.35
#: More filled cells that make a later header of the same region stronger; rows of a strip in which spans and rows meet.
REGION_WIDER, STRIP = 2, 1024


def _active() -> Column:
    return F.expr("filter(transform(cells, (c, i) -> if(trim(c) != '', i, null)), i -> i is not null)")


def described(grid: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows with what the neighbours say: ``anchor`` (can head a table), ``starts`` (and no stronger header follows soon), ``until`` (the next blank row)."""
    home = F.floor(F.col("row_id") / STRIP).cast("long")
    seen_by = F.sequence(F.floor((F.col("row_id") - AHEAD - FOLLOW_BODY) / STRIP).cast("long"), home)
    own = W.partitionBy("source_id", "_strip_of").orderBy("row_id")
    rows = grid.withColumn("_strip_of", F.explode(seen_by)).where("_strip_of >= 0").withColumn("active", _active()).withColumn("n", F.size("active")).withColumn("width", F.size("cells"))
    short = F.size(F.filter("cells", lambda c: (F.trim(c) != "") & (F.length(F.trim(c)) <= SHORT)))
    rows = rows.withColumn("header", header_like(F.col("cells"))).withColumn("prefix", (F.col("n") >= 2) & (short >= F.greatest(F.lit(2), F.bround(F.col("n") * SHORT_SHARE))))
    below = F.collect_list(F.struct("n", "width")).over(own.rowsBetween(1, FOLLOW_BODY))
    rows = rows.withColumn("below", below).withColumn("body", F.expr("slice(below, 1, coalesce(nullif(array_position(transform(below, b -> b.n = 0), true), 0) - 1, size(below)))"))
    rows = rows.withColumn("near", F.slice("body", 1, FOLLOW)).withColumn("widest", F.expr("array_max(transform(near, b -> b.width))"))
    even = F.expr("size(filter(near, b -> b.width = greatest(widest, width) and b.n >= 2))")
    rows = rows.withColumn("anchor", F.col("header") & (F.size("near") > 0) & (even >= F.when(F.col("n") <= 3, 2).otherwise(1)))
    rows = rows.withColumn("ahead", F.collect_list(F.struct("anchor", "n", "active")).over(own.rowsBetween(1, AHEAD)))
    stronger = F.expr(f"exists(ahead, a -> a.anchor and (prefix or a.n >= n + {WIDER} or size(array_except(filter(a.active, i -> i < width), active)) >= {NEW_COLUMNS}))")
    middle = F.expr(f"greatest(2, int(bround({BODY_SHARE} * array_median)))")
    rows = rows.withColumn("stronger", stronger).withColumn("starts", F.col("anchor") & ~F.col("stronger")).where(F.col("_strip_of") == home).drop("_strip_of")
    return (
        running_last(rows, ["source_id"], "row_id", F.when(F.col("n") == 0, F.col("row_id")), "until", later=True)
        .withColumn("expected", F.expr("greatest(width, coalesce(array_max(transform(body, b -> b.width)), width))"))
        .withColumn("_sorted", F.expr("array_sort(transform(body, b -> b.n))"))
        .withColumn("array_median", F.expr("if(size(_sorted) = 0, 0, (_sorted[(size(_sorted) - 1) div 2] + _sorted[size(_sorted) div 2]) / 2.0)"))
        .withColumn("least_cells", middle)
        .select("source_id", "row_id", "cells", "active", "n", "width", "starts", "until", "expected", "least_cells", *keep)
    )


def in_reach(spans: DataFrame, first: Column, last: Column, rows: DataFrame) -> DataFrame:
    """``spans`` with the ``rows(_s, r)`` of their sheets from ``first`` to ``last``; they meet by strips of rows, so a span meets only those beside it."""
    cut = spans.withColumn("_from", first.cast("long")).withColumn("_to", last.cast("long")).where("_from <= _to")
    cut = cut.withColumn("_strip", F.explode(F.sequence(F.floor(F.col("_from") / STRIP), F.floor(F.col("_to") / STRIP))))
    near = rows.withColumn("_strip", F.floor(F.col("r") / STRIP)).withColumnRenamed("_strip", "_strip_r")
    return cut.join(near, (F.col("source_id") == F.col("_s")) & (F.col("_strip") == F.col("_strip_r")) & F.col("r").between(F.col("_from"), F.col("_to"))).drop("_from", "_to", "_strip", "_strip_r")


def _chosen(starts: pd.DataFrame) -> pd.DataFrame:
    """From the top, each start that the table chosen before it doesn't cover."""
    keep, covered = [], -1
    for row, last in starts.groupby("header_row")["last_row"].max().sort_index().items():
        if row > covered:
            keep.append(row)
            covered = last
    return starts[starts["header_row"].isin(keep)]


def tables(rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """``source_id, header_row, last_row, column_start, column_end, columns`` of every table, all from 0."""
    heads = rows.where("starts").select("source_id", F.col("row_id").alias("header_row"), F.col("cells").alias("header"), F.col("active").alias("head_active"), "expected", "until", "least_cells")
    at = heads.select(F.col("source_id").alias("_s"), F.col("header_row").alias("r"), F.col("head_active").alias("_a"))
    hit = in_reach(boxes, F.col("row_start"), F.col("row_end"), at).where(F.exists("_a", lambda i: i.between(F.col("column_start"), F.col("column_end"))))
    hit = hit.select("_s", "r", "row_end", "column_start", "column_end")
    placed = heads.join(hit, (F.col("source_id") == F.col("_s")) & (F.col("header_row") == F.col("r")), "left")
    placed = placed.select(
        "source_id", "header_row", "header", "expected", "until", "head_active",
        F.col("_s").isNotNull().alias("boxed"),
        F.coalesce("column_start", F.array_min("head_active")).alias("first_column"),
        F.coalesce("column_end", F.array_max("head_active")).alias("last_column"),
        F.coalesce("row_end", F.lit(2**31 - 1)).cast("bigint").alias("box_end"),
        F.when(F.col("_s").isNotNull(), 2).otherwise(F.col("least_cells")).alias("least_cells"),
    )
    placed = placed.withColumn("inside", F.expr("filter(head_active, i -> i between first_column and last_column)")).where(F.size("inside") > 0)
    placed = checkpointed(placed)
    key = ["source_id", "header_row", "first_column", "last_column"]
    body = rows.select(F.col("source_id").alias("_s"), F.col("row_id").alias("r"), F.col("active").alias("a"), F.col("width").alias("w"), F.col("cells").alias("c"))
    # Columns that at least two rows of the box fill.
    in_box = in_reach(placed.where("boxed"), F.col("header_row") + 1, F.col("box_end"), body)
    filled = in_box.select(*key, F.explode("a").alias("i")).where("i between first_column and last_column").groupBy(*key, "i").agg(F.count("*").alias("k")).where("k >= 2")
    supported = filled.groupBy(*key).agg(F.collect_set("i").alias("supported"))
    placed = placed.join(supported, key, "left").withColumn("needed", F.expr("array_except(coalesce(supported, array()), array(first_column))"))
    placed = placed.withColumn("needed", F.expr("if(size(needed) > 0, needed, if(size(inside) > 1, slice(inside, 2, size(inside)), inside))"))
    # Rows down to the next blank one; the first that doesn't fit ends the table.
    bottom = body.groupBy(F.col("_s").alias("source_id")).agg(F.max("r").alias("_bottom"))
    below = in_reach(placed.join(bottom, "source_id"), F.col("header_row") + 1, F.least("box_end", F.coalesce(F.col("until") - 1, F.col("_bottom")), "_bottom"), body).drop("_bottom")
    below = below.withColumn("own", F.expr("filter(a, i -> i between first_column and last_column)")).withColumn("total", F.expr("exists(own, i -> startswith(lower(trim(c[i])), 'total '))"))
    fits = F.expr("w = expected and (size(own) >= least_cells or (total and size(own) >= 2)) and (array_contains(own, first_column) or total) and arrays_overlap(needed, own)")
    ends = below.groupBy(*key).agg(F.coalesce(F.min(F.when(~fits, F.col("r"))), F.max("r") + 1).alias("stop"))
    found = placed.join(ends, key).where("stop > header_row + 1").withColumn("last_row", F.col("stop") - 1)
    names = F.expr("""transform(if(boxed, slice(header, first_column + 1, last_column - first_column + 1), header),
        (h, i) -> case when trim(h) != '' then trim(h) when i = 0 then 'row_label' else concat('column_', i + 1) end)""")
    listed = found.select("source_id", "header_row", "last_row", F.when(F.col("boxed"), F.col("first_column")).otherwise(0).alias("column_start"), F.when(F.col("boxed"), F.col("last_column")).otherwise(F.size("header") - 1).alias("column_end"), names.alias("columns"))
    return listed.groupBy("source_id").applyInPandas(_chosen, listed.schema)


def stretches(rows: DataFrame) -> DataFrame:
    """``source_id, row_start, row_end`` of the runs of consecutive ``rows(source_id, row_id)``; runs of strips first, which are then joined."""
    strip = rows.withColumn("_strip", F.floor(F.col("row_id") / STRIP).cast("long"))
    number = F.col("row_id") - F.row_number().over(W.partitionBy("source_id", "_strip").orderBy("row_id"))
    own = strip.withColumn("_run", number).groupBy("source_id", "_strip", "_run").agg(F.min("row_id").alias("row_start"), F.max("row_id").alias("row_end"))
    order = W.partitionBy("source_id").orderBy("row_start")
    begins = F.when(F.lag("row_end").over(order) + 1 == F.col("row_start"), 0).otherwise(1)
    told = own.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(order))
    return told.groupBy("source_id", "_run").agg(F.min("row_start").alias("row_start"), F.max("row_end").alias("row_end")).drop("_run")


def segment(grid: DataFrame) -> DataFrame:
    """``source_id, kind, row_start, row_end, column_start, column_end, columns`` of all table and metadata blocks, from 0.

    Metadata blocks are runs of rows that aren't blank and that no table covers.
    """
    rows = checkpointed(described(grid))
    found = checkpointed(tables(rows, checkpointed(regions(grid))))
    spans = found.groupBy("source_id", "header_row").agg(F.max("last_row").alias("last"))
    full = rows.where("n > 0").select("source_id", "row_id")
    covered = in_reach(spans, F.col("header_row"), F.col("last"), full.select(F.col("source_id").alias("_s"), F.col("row_id").alias("r"))).select("source_id", F.col("r").alias("row_id"))
    notes = stretches(full.join(covered, ["source_id", "row_id"], "left_anti"))
    none = F.lit(None)
    notes = notes.select("source_id", F.lit("metadata").alias("kind"), "row_start", "row_end", none.cast("int").alias("column_start"), none.cast("int").alias("column_end"), none.cast("array<string>").alias("columns"))
    return found.select("source_id", F.lit("table").alias("kind"), F.col("header_row").alias("row_start"), F.col("last_row").alias("row_end"), "column_start", "column_end", "columns").unionByName(notes)


def header_candidates(rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """``source_id, row, non_empty, stronger, cells`` of the header of each region, rows from 1.

    ``rows`` are ``described`` ones that keep ``anchor, ahead, stronger``.  A
    region's header is the topmost row, from the one above the region on, that
    can head a table and has no stronger one soon after it within the region; if
    all have, the topmost that can head one.  A row is a candidate once, however
    many regions choose it.
    """
    body = rows.where("anchor").select(F.col("source_id").alias("_s"), F.col("row_id").alias("r"), "n", "width", "active", "ahead", F.col("stronger").alias("_stronger"), F.col("cells").alias("_cells"))
    met = in_reach(boxes.select("source_id", "row_start", "row_end"), F.greatest(F.lit(0), F.col("row_start") - 1), F.col("row_end"), body)
    within = F.expr(f"exists(slice(ahead, 1, greatest(0, int(row_end - r))), a -> a.anchor and (a.n >= n + {REGION_WIDER} or size(array_except(filter(a.active, i -> i < width), active)) >= {NEW_COLUMNS}))")
    chosen = met.groupBy("source_id", "row_start", "row_end").agg(F.coalesce(F.min(F.when(~within, F.col("r"))), F.min("r")).alias("r")).select("source_id", "r").distinct()
    told = body.select(F.col("_s").alias("source_id"), "r", "n", "_stronger", "_cells")
    return told.join(chosen, ["source_id", "r"]).select("source_id", (F.col("r") + 1).cast("long").alias("row"), F.col("n").alias("non_empty"), F.col("_stronger").alias("stronger"), F.col("_cells").alias("cells"))


def profiled(grid: DataFrame, samples: int = 5) -> DataFrame:
    """One row for each sheet: its dimensions, blank and filled rows, header candidates, regions, hints and first rows.

    ``source_id, row_count, column_count, non_empty_rows, blank_rows,
    max_non_empty, median_non_empty, header_row, data_row, header_candidates,
    regions, sample_rows``.  The median is over rows that aren't blank; rows and
    columns of candidates and regions count from 1.  Candidates and regions are
    of a sheet's tables, not of its rows.
    """
    n = F.size(F.filter("cells", lambda c: F.trim(c) != ""))
    filled = F.when(n > 0, n)
    sizes = grid.groupBy("source_id").agg(
        F.count("*").alias("row_count"), F.max(F.size("cells")).cast("long").alias("column_count"), F.count_if(n > 0).alias("non_empty_rows"), F.count_if(n == 0).alias("blank_rows"),
        F.coalesce(F.max(filled), F.lit(0)).alias("max_non_empty"), F.coalesce(F.percentile(filled, F.lit(0.5)), F.lit(0.0)).alias("median_non_empty"),
    )
    boxes = regions(grid)
    heads = header_candidates(described(grid, ("anchor", "ahead", "stronger")), boxes)
    hints = structure_hints(heads, ["source_id"]).select("source_id", "header_row", "data_row")
    listed = heads.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("row", "non_empty", "stronger", "cells"))).alias("header_candidates"))
    spans = boxes.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct(*((F.col(c) + 1).alias(c) for c in ("row_start", "row_end", "column_start", "column_end"))))).alias("regions"))
    first = grid.where(F.col("row_id") < samples).groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "cells"))), lambda x: x["cells"]).alias("sample_rows"))
    out = sizes
    for part in (hints, listed, spans, first):
        out = out.join(part, "source_id", "left")
    return out


def inspected(grid: DataFrame, *, start_row: int = 1, limit: int = 5, start_column: int = 1, end_column: int | None = None) -> DataFrame:
    """``profiled`` sheets with a window of their cells: ``rows``, and the place it has, from 1.

    Rows and columns below 1 count as 1, and a window has one row and column at
    least; ``end_row`` and ``end_column`` are those that the window has, one
    before the start where it is empty.
    """
    top, height, left = max(1, start_row), max(1, limit), max(1, start_column)
    width = F.size("cells") if end_column is None else F.lit(max(left, end_column))
    own = grid.where(F.col("row_id").between(top - 1, top + height - 2)).select("source_id", "row_id", F.slice("cells", F.lit(left), F.greatest(F.lit(0), width - left + 1)).alias("cells"))
    seen = own.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "cells"))), lambda x: x["cells"]).alias("rows"))
    joined = profiled(grid).join(seen, "source_id", "left").withColumn("rows", F.coalesce("rows", F.array().cast("array<array<string>>")))
    wide = F.coalesce(F.array_max(F.transform("rows", lambda r: F.size(r))), F.lit(0))
    return joined.withColumns({"start_row": F.lit(top), "end_row": F.lit(top - 1) + F.size("rows"), "start_column": F.lit(left), "end_column": F.lit(left - 1) + wide})
