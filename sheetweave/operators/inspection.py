"""Page profiles, verdicts on detected tables, their grouping across pages, key labels and formula overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import clean_table_cell, let
from .reshape import islands
from .scan import running_sum

# Slack of a straight line, initials of the thirds of a page, short header words that are no fragment, and what makes text large.
STRAIGHT = 1.5
DOWN, ACROSS = "tmb", "lcr"
SHORT_HEADERS = ("id", "ip", "no", "qty", "key")
LARGE_TIMES, LARGE_LEAST = 1.6, 16
#: Rows of a sheet in a strip of the overlay's join.
STRIP = 1024


def band(value: Column, extent: Column) -> Column:
    """The third of the page, 0 to 2, that a coordinate lies in; 0 where the page has no extent."""
    return F.when(extent <= 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(2), (value / F.when(extent > 0, extent) * 3).cast("int"))))


def rule_profile(items: DataFrame, by: list[str]) -> DataFrame:
    """``horizontal, vertical, other, y_bands, x_bands`` of each page's drawn ``items(kind, x0, y0, x1, y1, width, height)``.

    A box (``re``) counts as two lines of either direction; bands are the initials of the thirds that rules lie in.
    """
    dx, dy = F.abs(F.col("x0") - F.col("x1")), F.abs(F.col("y0") - F.col("y1"))
    line, box = F.col("kind") == "l", F.col("kind") == "re"
    down = line & (dx <= STRAIGHT) & (dy > STRAIGHT)
    across = line & (dy <= STRAIGHT) & (dx > STRAIGHT)
    none = F.array().cast("array<int>")

    def thirds(a: str, b: str, extent: str, straight: Column) -> Column:
        size = F.col(extent)
        return F.when(straight, F.array(band((F.col(a) + F.col(b)) / 2, size))).when(box, F.array(band(F.col(a), size), band(F.col(b), size))).otherwise(none)

    marked = items.select(*by, across.alias("_a"), down.alias("_d"), box.alias("_b"), thirds("y0", "y1", "height", across).alias("_y"), thirds("x0", "x1", "width", down).alias("_x"))

    def held(bands: str, initials: str) -> Column:
        found = F.concat_ws("", *(F.when(F.bool_or(F.array_contains(bands, i)), x) for i, x in enumerate(initials)))
        return F.when(found == "", "none").otherwise(found)

    def lines(own: str) -> Column:
        return F.sum(F.when(F.col("_b"), 2).when(F.col(own), 1).otherwise(0))

    return marked.groupBy(*by).agg(lines("_a").alias("horizontal"), lines("_d").alias("vertical"), F.count_if(~(F.col("_a") | F.col("_d") | F.col("_b"))).alias("other"), held("_y", DOWN).alias("y_bands"), held("_x", ACROSS).alias("x_bands"))


def font_profile(spans: DataFrame, by: list[str], size: str) -> DataFrame:
    """``spans, max_size, median_size, large_spans`` of each page; of an even number of sizes the upper middle one is the median."""
    sizes = spans.groupBy(*by, F.col(size).alias("_s")).agg(F.count("*").alias("_n"))
    upto = W.partitionBy(*by).orderBy("_s").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = sizes.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(W.partitionBy(*by)))
    placed = placed.withColumn("_median", F.min(F.when(F.col("_upto") > F.floor(F.col("_all") / 2), F.col("_s"))).over(W.partitionBy(*by)))
    large = (F.col("_s") >= F.col("_median") * LARGE_TIMES) & (F.col("_s") >= LARGE_LEAST)
    return placed.groupBy(*by).agg(F.max("_all").alias("spans"), F.max("_s").alias("max_size"), F.max("_median").alias("median_size"), F.sum(F.when(large, F.col("_n")).otherwise(0)).alias("large_spans"))


def page_hints(chars: Column, horizontal: Column, vertical: Column, large_spans: Column) -> Column:
    """What a page's profile says about how to read it."""
    return F.array_compact(F.array(F.when(chars == 0, "no_extractable_text"), F.when((horizontal >= 3) & (vertical >= 3), "visible_rule_grid"), F.when(large_spans > 0, "large_text_regions")))


def judged_tables(rows: DataFrame, by: list[str], order: str, cells: str, header: str) -> DataFrame:
    """``quality, warnings, kind`` of each detected table, by its rows' cells and the header that each row carries along.

    A table is plausible with two rows, columns and filled first cells and few
    short header fragments.  It is a grid if it is plausible with a whole header,
    a list of fields if all rows have two cells and some both filled.
    """
    c, h = F.col(cells), F.col(header)
    filled = F.size(F.filter(c, lambda x: x != ""))
    first = W.partitionBy(*by).orderBy(order)
    per_row = rows.select(*by, c.alias("_c"), h.alias("_h"), filled.alias("_f"), (F.row_number().over(first) == 1).alias("_first"))
    repeats = (F.size("_h") > 0) & (F.slice("_c", 1, F.greatest(F.size("_h"), F.lit(1))) == F.col("_h"))
    data = ~(F.col("_first") & repeats)
    found = per_row.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.max(F.size("_c")).alias("w"),
        F.sum("_f").alias("filled"),
        F.max(F.when(F.col("_first"), F.col("_f"))).alias("first_filled"),
        F.max(F.when(F.col("_first"), F.col("_h"))).alias("h"),
        F.max(F.when(F.col("_first"), F.when(F.size("_h") > 0, F.col("_h")).otherwise(F.col("_c")))).alias("heads"),
        F.coalesce(F.bool_and(F.when(data, F.size("_c") >= 2)), F.lit(True)).alias("pairs"),
        F.count_if(data & F.coalesce((F.get("_c", 0) != "") & (F.get("_c", 1) != ""), F.lit(False))).alias("fields"),
    )
    short = F.size(F.filter("heads", lambda x: (x != "") & (F.length(x) <= 3) & ~F.lower(x).isin(*SHORT_HEADERS)))
    plausible = (F.col("n") >= 2) & (F.col("w") >= 2) & (F.col("first_filled") >= 2) & (short < F.greatest(F.lit(2), F.floor(F.size("heads") / 2)))
    warnings = F.array_compact(F.array(F.when(F.col("n") < 2, "too_few_rows"), F.when(F.col("w") < 2, "too_few_columns"), F.when(short > 0, "short_header_fragments"), F.when(F.col("filled") < F.col("n") * F.greatest(F.col("w"), F.lit(1)) * 0.25, "sparse_cells")))
    whole = (F.size("h") > 0) & F.forall("h", lambda x: x != "")
    kind = F.when((F.col("filled") == 0) | (F.col("w") <= 1), "false_positive").when(whole & plausible, "grid_table").when((F.col("w") == 2) & F.col("pairs") & (F.col("fields") > 0), "field_value_table").otherwise("uncertain")
    return found.select(*by, F.when(plausible, "plausible").otherwise("suspicious").alias("quality"), warnings.alias("warnings"), kind.alias("kind"))


def across_pages(grids: DataFrame, by: list[str], order: list[str], name: str = "group_no") -> DataFrame:
    """Number the groups of grids that go on from page to page.

    ``grids`` has ``page, columns, y0, y1, height``.  A grid goes on from the one
    before if that is on the page before, has the same columns and ends in the
    lowest quarter of its page, and this one begins in the highest.
    """
    before = {c: F.lag(c).over(W.partitionBy(*by).orderBy(*order)) for c in ("page", "columns", "y1", "height")}
    goes_on = (F.col("columns") == before["columns"]) & (F.col("page") == before["page"] + 1) & (before["height"] > 0) & (F.col("height") > 0) & (before["y1"] >= before["height"] * 0.75) & (F.col("y0") <= F.col("height") * 0.25)
    marked = grids.withColumn("_starts", ~F.coalesce(goes_on, F.lit(False)))
    return islands(marked, by, order, F.col("_starts"), name).drop("_starts")


def fold_unnamed(cells: Column, header: Column) -> Column:
    """Cells under blank header cells joined to the named column on their left, or to the first; cells beyond the header go."""
    named = F.size(F.filter(header, lambda h: h != ""))
    target = F.transform(header, lambda h, i: F.greatest(F.size(F.filter(F.slice(header, F.lit(1), i + 1), lambda x: x != "")), F.lit(1)))
    own = F.slice(cells, F.lit(1), F.size(header))

    def parts(at: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(named, F.lit(1))), lambda t: F.array_join(F.filter(F.transform(own, lambda c, i: F.when(F.get(at, i) == t, c)), lambda c: c != ""), " "))

    folded = let(target, parts)
    return F.when(named > 0, folded).otherwise(cells)


def joined_fragments(fragments: Column) -> Column:
    """Parts of a wrapped cell, in their order, as one text.

    A part of which the letters and digits stand in the text so far, or the
    other way round, is left out; after a hyphen no space is put.
    """

    def bare(c: Column) -> Column:
        return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")

    def step(s: Column, f: Column) -> Column:
        twice = (f["bare"] != "") & (F.contains(s["bare"], f["bare"]) | F.contains(f["bare"], s["bare"]))
        hyphen = F.endswith(s["text"], F.lit("-"))
        longer = F.struct(F.when(hyphen, F.concat(s["text"], F.ltrim(f["text"]))).otherwise(F.concat_ws(" ", s["text"], f["text"])).alias("text"), F.concat(s["bare"], f["bare"]).alias("bare"))
        return F.when((f["text"] == "") | ((s["text"] != "") & twice), s).when(s["text"] == "", f).otherwise(longer)

    parts = F.transform(fragments, lambda c: F.struct(c.alias("text"), bare(c).alias("bare")))
    return F.aggregate(parts, F.struct(F.lit("").alias("text"), F.lit("").alias("bare")), step, lambda s: s["text"])


def merged_rows(rows: DataFrame, by: list[str], order: str, cells: str) -> DataFrame:
    """``by, order, cells, merged``: rows with a blank first cell go into the row before, cell by cell.

    Cells are cleaned first, and rows without text go.  The first row of a table
    stays, whatever its first cell.  ``merged`` counts the rows that went in;
    a row is as wide as its widest part.  The order column has to be a number.
    """
    clean = rows.select(*by, order, F.transform(F.coalesce(cells, F.array().cast("array<string>")), clean_table_cell).alias("cells")).where(F.exists("cells", lambda c: c != ""))
    numbered = running_sum(clean, by, order, (F.col("cells")[0] != "").cast("int"), "_row")
    parts = F.array_sort(F.collect_list(F.struct(order, "cells")))
    whole = numbered.groupBy(*by, "_row").agg(F.min(order).alias(order), parts.alias("_parts"), F.max(F.size("cells")).alias("_width"))
    folded = F.transform(F.sequence(F.lit(1), F.col("_width")), lambda i: joined_fragments(F.transform("_parts", lambda p: F.coalesce(F.get(p["cells"], i - 1), F.lit("")))))
    return whole.select(*by, order, folded.alias("cells"), (F.size("_parts") - 1).alias("merged"))


def _words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda t: (t != "") & (t != "_"))


def repaired_name(c: Column) -> Column:
    """A name whose underscores were set apart, in one word again."""
    parts = F.filter(F.transform(_words(c), lambda t: F.regexp_replace(t, "^_+|_+$", "")), lambda t: t != "")
    return F.when(F.size(_words(c)) == 0, c).otherwise(F.array_join(parts, "_"))


def repaired_path(c: Column) -> Column:
    """The same for each part of a value that looks like a path or a variable; other values stay."""
    return F.when(F.contains(c, F.lit("$")) | F.contains(c, F.lit("/")), F.array_join(F.transform(F.split(c, "/"), lambda p: F.array_join(_words(p), "_")), "/")).otherwise(c)


def extraction_status(sources: DataFrame, tables: DataFrame, key: str) -> DataFrame:
    """``key, status, warnings`` of each source by its extracted ``tables(key, position, detected, columns, warnings)``.

    A source without tables is ``empty``; one with warnings of a detected table,
    or with one whose columns have no names of their own, is ``low_confidence``.
    """
    generic = F.forall("columns", lambda c: c.rlike("^column_[0-9]+$"))
    told = F.array_sort(F.collect_list(F.when(F.col("detected"), F.struct("position", "warnings"))))
    found = tables.groupBy(key).agg(F.bool_or(F.col("detected") & generic).alias("_generic"), F.flatten(F.transform(told, lambda t: t["warnings"])).alias("_told"))
    own = F.concat(F.when(F.col("_generic"), F.array(F.lit("generic_detected_columns"))).otherwise(F.array().cast("array<string>")), F.filter("_told", lambda w: w != ""))
    rows = sources.select(key).distinct().join(found, key, "left").withColumn("_own", own)
    low = F.size("_own") > 0
    warnings = F.when(F.col("_told").isNull(), F.array(F.lit("no_tables_extracted"))).when(low, F.array_distinct(F.concat(F.array(F.lit("low_confidence_detected_tables")), F.col("_own")))).otherwise(F.array().cast("array<string>"))
    return rows.select(key, F.when(F.col("_told").isNull(), "empty").when(low, "low_confidence").otherwise("ok").alias("status"), warnings.alias("warnings"))


def key_labels(rows: DataFrame, by: list[str], order: str, label: str, ends: Column, parents: Column) -> DataFrame:
    """``by, label, first``: labels that are keys, with the first row they stand in.

    Rows where ``ends`` holds cut the rows into segments.  In one with parents,
    keys are the labels under a parent that an end or another parent closes; in
    one without, all labels but the first, if an end closes it.
    """
    own, flag = W.partitionBy(*by), F.coalesce(ends, F.lit(False))
    cut = rows.select(*by, order, F.trim(F.coalesce(F.col(label), F.lit(""))).alias("label"), flag.alias("_end"), F.coalesce(parents, F.lit(False)).alias("_parent"))
    cut = cut.withColumn("_segment", F.coalesce(F.sum(F.col("_end").cast("int")).over(own.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    segment = W.partitionBy(*by, "_segment")
    upto = segment.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    labelled = ~F.col("_end") & (F.col("label") != "")
    heads = (labelled & F.col("_parent")).cast("int")
    marked = cut.select("*", F.sum(heads).over(upto).alias("_no"), F.sum(heads).over(segment).alias("_of"), F.max("_end").over(segment).alias("_closed"), F.sum(labelled.cast("int")).over(upto).alias("_nth"))
    under = (F.col("_no") > 0) & ~F.col("_parent") & (F.col("_closed") | (F.col("_no") < F.col("_of")))
    kept = marked.where(labelled & F.when(F.col("_of") > 0, under).otherwise(F.col("_closed") & (F.col("_nth") > 1)))
    return kept.groupBy(*by, "label").agg(F.min(order).alias("first"))


def formula_overlay(formulas: DataFrame, tables: DataFrame) -> DataFrame:
    """``sheet, row, column`` of each formula inside a table, and where in the table that is.

    ``tables`` has ``sheet, name, row_start, row_end, column_start, column_end,
    header_row, columns, db_columns``.  They are joined by the strips of rows
    that a table touches, so a cell meets only the tables beside it.
    """
    strips = tables.withColumn("_strip", F.explode(F.sequence(F.floor(F.col("row_start") / STRIP), F.floor(F.col("row_end") / STRIP))))
    cells = formulas.select("sheet", "row", "column", F.floor(F.col("row") / STRIP).alias("_strip"))
    inside = cells.join(strips, ["sheet", "_strip"]).where("row between row_start and row_end and column between column_start and column_end")
    at = (F.col("column") - F.col("column_start")).cast("int")
    return inside.select(
        "sheet", "row", "column", "name",
        F.when(F.col("row") == F.col("header_row"), "header").otherwise("data").alias("role"),
        (F.col("row") - F.col("header_row")).alias("table_row"),
        (at + 1).alias("table_column"),
        F.coalesce(F.get("columns", at), F.lit("")).alias("column_name"),
        F.coalesce(F.get("db_columns", at), F.lit("")).alias("db_column"),
    )


def structure_hints(headers: DataFrame, by: list[str]) -> DataFrame:
    """``header_row, data_row, candidates`` of each sheet from ``headers(row, non_empty, stronger)``.

    The fullest candidate without a stronger one ahead, of equals the topmost; of all candidates where each has one ahead.
    """
    best = F.max_by("row", F.struct((~F.col("stronger")).cast("int"), "non_empty", -F.col("row")))
    return headers.groupBy(*by).agg(best.alias("header_row"), (best + 1).alias("data_row"), F.count("*").alias("candidates"))
