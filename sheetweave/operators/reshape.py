"""Row streams into tables: continuation rows, carried context, split parts, label/value pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(rows: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number the runs that begin where ``starts`` holds."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(name, F.sum(starts.cast("bigint")).over(w))


def merge_continuations(rows: DataFrame, by: list[str], order: str, first: str, text: str, sep: str = " ") -> DataFrame:
    """A row whose ``first`` cell is blank belongs to the row before; its text is appended."""
    marked = islands(rows, by, [order], F.coalesce(F.trim(F.col(first)) != "", F.lit(False)))
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return marked.groupBy(*by, "island").agg(F.min(order).alias(order), F.count("*").alias("n_rows"), F.array_join(F.transform(parts, lambda s: s[text]), sep).alias(text))


def carry_context(rows: DataFrame, by: list[str], order: list[str], sets: Column, name: str) -> DataFrame:
    """The last value that ``sets`` gave, up to and including this row."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(name, F.last(sets, ignorenulls=True).over(w))


def split_parts(rows: DataFrame, by: list[str], order: list[str], ends: Column, name: str = "part") -> DataFrame:
    """Part numbers from 1; a row where ``ends`` holds is the last of its part."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(ends.cast("bigint")).over(w), F.lit(0)) + 1)


def merge_chunks(chunks: DataFrame, by: list[str], order: list[str], breaks: Column) -> DataFrame:
    """Adjacent chunks join into one table unless ``breaks``, which may use ``lag`` over the same window, holds."""
    flagged = chunks.withColumn("_break", F.coalesce(breaks, F.lit(True)))
    return islands(flagged, by, order, F.col("_break"), "table_no").drop("_break")


def transpose_labels(rows: DataFrame, by: list[str], label: str, value: str, labels: list[str]) -> DataFrame:
    """One row for each group, with a column for each label; the least value where a label repeats."""
    return rows.groupBy(*by).pivot(label, labels).agg(F.min(value))


#: Bands up to which they are broadcast.
BANDS = 10_000


def place_in_bands(words: DataFrame, bands: DataFrame, x: str, width: float = 16.0) -> DataFrame:
    """Words joined to each band [low, high) that holds their x.

    A configured, small table of bands is broadcast; a larger one is joined by
    the strips of ``width`` that a band touches, so no word meets every band.
    """
    inside = (F.col(x) >= F.col("low")) & (F.col(x) < F.col("high"))
    if bands.count() <= BANDS:
        return words.join(F.broadcast(bands), inside)
    strips = bands.where("high > low").withColumn("_strip", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    return words.withColumn("_strip", F.floor(F.col(x) / width)).join(strips, "_strip").where(inside).drop("_strip")


def skipped(cells: Column, lines: list[str], prefixes: list[str]) -> Column:
    """Whether any cell is one of ``lines`` or starts with one of ``prefixes``."""
    return F.exists(cells, lambda c: c.isin(*lines) | F.coalesce(*(F.when(F.startswith(c, F.lit(p)), True) for p in prefixes), F.lit(False)) if prefixes else c.isin(*lines))


def fit_width(cells: Column, width: int) -> Column:
    """Cells in ``width`` columns: missing ones are empty, those too many are joined into the last."""
    padded = F.concat(F.slice(cells, 1, width - 1), F.array(F.trim(F.array_join(F.filter(F.slice(cells, F.lit(width), F.greatest(F.size(cells), F.lit(0))), lambda c: c != ""), " "))))
    short = F.concat(cells, F.array_repeat(F.lit(""), F.lit(width) - F.size(cells)))
    return F.when(F.size(cells) > width, padded).when(F.size(cells) < width, short).otherwise(cells)


def forced_records(rows: DataFrame, by: list[str], order: str, cells: str, columns: list[str], least: int = 1) -> DataFrame:
    """``by``, ``order`` and ``cells``: records in given columns.

    Empty rows and repeats of the header go.  A row with its first cell only is
    the continuation of the record before, or the first record.  Rows with fewer
    than ``least`` filled cells go.
    """
    fitted = rows.select(*by, order, fit_width(F.col(cells), len(columns)).alias("cells")).withColumn("n", F.size(F.filter("cells", lambda c: c != "")))
    header = F.forall(F.arrays_zip(F.col("cells").alias("c"), F.array(*(F.lit(x) for x in columns)).alias("h")), lambda p: F.lower(F.trim(p["c"])) == F.lower(p["h"]))
    kept = fitted.where((F.col("n") > 0) & ~header).withColumn("alone", (F.col("n") == 1) & (F.col("cells")[0] != "")).where((F.col("n") >= least) | F.col("alone"))
    before = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    marked = islands(kept.withColumn("starts", ~F.col("alone") | (F.count("*").over(before) == 0)), by, [order], F.col("starts"))
    whole = F.array_sort(F.collect_list(F.struct(order, F.col("cells")[0].alias("first"))))
    merged = marked.groupBy(*by, "island").agg(F.min(order).alias(order), F.min_by("cells", order).alias("head"), whole.alias("parts"))
    return merged.select(*by, order, F.concat(F.array(F.array_join(F.transform("parts", lambda p: p["first"]), " ")), F.slice("head", F.lit(2), F.size("head"))).alias("cells"))


def anchored_rows(lines: DataFrame, by: list[str], y: str, anchors: list[str], wrapped: str, slop: float) -> DataFrame:
    """Lines whose ``anchors`` are all filled, with the ``wrapped`` text of their band.

    A band goes from ``slop`` above its line to ``slop`` above the next anchor's,
    the last one to the end of the page.  A line above the first band belongs to
    none.
    """
    own = W.partitionBy(*by).orderBy(y)
    is_anchor = F.expr(" and ".join(f"coalesce({a}, '') != ''" for a in anchors))
    heads = lines.where(is_anchor).withColumn("_low", F.col(y) - slop).withColumn("_high", F.coalesce(F.lead(y).over(own) - slop, F.lit(float("inf"))))
    # Each line's band is that of the last one that starts at or above it.
    marks = heads.select(*by, F.col("_low").alias("_y"), F.col(y).alias("_anchor"), F.lit(0).alias("_o"), F.lit(None).cast("string").alias("_text"))
    texts = lines.where(F.coalesce(F.col(wrapped), F.lit("")) != "").select(*by, F.col(y).alias("_y"), F.lit(None).cast(lines.schema[y].dataType).alias("_anchor"), F.lit(1).alias("_o"), F.col(wrapped).alias("_text"))
    run = W.partitionBy(*by).orderBy("_y", "_o").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = marks.unionByName(texts).withColumn("_anchor", F.last("_anchor", ignorenulls=True).over(run)).where("_text is not null and _anchor is not null")
    joined = placed.groupBy(*by, F.col("_anchor").alias(y)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_y", "_text"))), lambda s: s["_text"]), " ").alias("_joined"))
    return heads.drop("_low", "_high").join(joined, [*by, y], "left").withColumn(wrapped, F.trim(F.coalesce("_joined", F.lit("")))).drop("_joined")


def repeated_labels(rows: DataFrame, label: str, least: int = 2) -> list[str]:
    """The labels that stand at least ``least`` times, in the order of their text: the columns of a transposed table, 1,000 at most."""
    found = [r[0] for r in rows.groupBy(label).count().where(F.col("count") >= least).orderBy(label).select(label).limit(1001).collect()]
    if len(found) > 1000:
        raise ValueError("more than 1,000 labels would become columns")
    return found


def breaks_after(gap: str, most: str, by: list[str], order: list[str]) -> Column:
    """Whether the step in ``gap`` from the row before is longer than an interval."""
    before = F.lag(gap).over(W.partitionBy(*by).orderBy(*order))
    return (F.col(gap) - before) > F.expr(f"interval {most}")
