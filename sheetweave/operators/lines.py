"""Words on pages into lines: by the lines that the page tells, and by their height."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .walk import LONG, Walk, groups, walked_in_order

# How far words of a row may be apart in height, rows of a page, and words of a row that are kept.
TOLERANCE, MOST_ROWS, MOST_WORDS = 3.5, 90, 36
PLACES = ("x0", "y0", "x1", "y1")


def line_records(words: DataFrame, by: list[str], page: str, *, skip_lines: tuple[str, ...] = (), skip_prefixes: tuple[str, ...] = (), stop_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """``by, page, text, x0, y0, line_no`` of the lines of ``words(block, line, word, x0, y0, text)``.

    Words of a line are joined from left to right, those at one place in the
    order of ``word``.  Blank lines and the page's own number go, as do lines
    that are told to be skipped.  On each page the first line that starts with a
    stop prefix ends the page.  ``line_no`` counts from the top, then the left.
    """
    key = [*by, page]
    listed = F.array_sort(F.collect_list(F.struct("x0", "word", "text")))
    lines = words.groupBy(*key, "block", "line").agg(F.trim(F.array_join(F.transform(listed, lambda w: w["text"]), " ")).alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.min("word").alias("_first"))
    lines = lines.where((F.col("text") != "") & (F.col("text") != F.col(page).cast("string")))

    def begins(prefixes: tuple[str, ...]):
        return F.coalesce(*(F.when(F.startswith("text", F.lit(p)), True) for p in prefixes), F.lit(False))

    if stop_prefixes:
        at = F.struct("y0", "x0", "_first")
        ends = lines.where(begins(stop_prefixes)).groupBy(*key).agg(F.min(at).alias("_end"))
        lines = lines.join(ends, key, "left").where(F.col("_end").isNull() | (at < F.col("_end"))).drop("_end")
    lines = lines.where(~(F.col("text").isin(*skip_lines) | begins(skip_prefixes)))
    order = W.partitionBy(*key).orderBy("y0", "x0", "_first")
    return lines.withColumn("line_no", F.row_number().over(order)).select(*key, "text", "x0", "y0", "line_no")


def stepped(y: list[float], state: tuple[float, int], tolerance: float = TOLERANCE) -> tuple[list[int], tuple[float, int]]:
    """The row that each word is in, from the height of the open row and its number, and both after the last word."""
    top, row = state
    out = []
    for v in y:
        if v > top + tolerance:
            top, row = v, row + 1
        out.append(row)
    return out, (top, row)


def summed_up(y: list[float], tolerance: float = TOLERANCE) -> tuple[list[float], list[float], list[int]]:
    """Words as a function: those lower than all before, each with the state that follows if it is the first to start a row.

    Words are ordered by band, so an open row is at most a tolerance lower than
    the first word, and a word three lower starts a row in any case.
    """
    n = len(y)
    ends = [(0.0, 0)] * n
    below: list[float] = []  # words to the right that are lower than all between, the nearest last, by falling height
    at: list[int] = []
    for i in range(n - 1, -1, -1):
        k = bisect_left(below, -(y[i] + tolerance)) - 1
        ends[i] = (ends[at[k]][0], ends[at[k]][1] + 1) if k >= 0 else (y[i], 1)
        while below and below[-1] >= -y[i]:
            below.pop()
            at.pop()
        below.append(-y[i])
        at.append(i)
    lower: list[int] = []
    for i, v in enumerate(y):
        if not lower or v > y[lower[-1]]:
            lower.append(i)
            if v > y[0] + 3 * tolerance:
                break
    return [y[i] for i in lower], [ends[i][0] for i in lower], [ends[i][1] for i in lower]


def applied(state: tuple[float, int], lower: list[float], top: list[float], rows: list[int], tolerance: float = TOLERANCE) -> tuple[float, int]:
    k = bisect_right(lower, state[0] + tolerance)
    return state if k == len(lower) else (top[k], state[1] + rows[k])


def _pieces(by: list[str], most_rows: int, most_words: int):
    """Parts of rows in a batch: bounds, the number of words and the first of them; of rows beyond the most only the last of each page."""

    def emit(batch: pa.RecordBatch, row: list[int], number: int) -> pa.RecordBatch:
        rows = np.array(row)
        first = np.zeros(len(rows), bool)
        last = np.zeros(len(rows), bool)
        for _, a, b in groups(batch, by):
            first[a] = last[b - 1] = True
        first[1:] |= rows[1:] != rows[:-1]
        start = np.flatnonzero(first)
        stop = np.append(start[1:], len(rows))
        x0, y0, x1, y1 = (batch.column(c).to_numpy() for c in PLACES)
        lows, highs = ([f.reduceat(c, start) for c in cs] for f, cs in ((np.minimum, (x0, y0)), (np.maximum, (x1, y1))))
        kept = np.flatnonzero((rows[start] <= most_rows) | last[stop - 1])
        start, stop = start[kept], stop[kept]
        size = np.where(rows[start] <= most_rows, np.minimum(stop - start, most_words), 0)
        ends = np.concatenate([[0], np.cumsum(size)])
        own = pa.array(np.arange(ends[-1]) - np.repeat(ends[:-1] - start, size))
        words = pa.StructArray.from_arrays([batch.column("x0").take(own), batch.column("text").take(own)], names=["x0", "text"])
        at = pa.array(start)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(at) for c in by), pa.array(rows[start].astype(np.int64)), pa.array(np.full(len(start), number, np.int64)), batch.column("y0").take(at), *(pa.array(c[kept]) for c in (*lows, *highs)), pa.array(stop - start), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words)],
            names=[*by, "row_id", "_piece", "y", "bbox_x0", "bbox_y0", "bbox_x1", "bbox_y1", "_n", "_words"],
        )

    return emit


def visual_rows(words: DataFrame, by: list[str], *, tolerance: float = TOLERANCE, most_rows: int = MOST_ROWS, most_words: int = MOST_WORDS, long: int = LONG) -> DataFrame:
    """Rows of each page of ``words(word, x0, y0, x1, y1, text)``, found by the words' height.

    Words are read by bands of ``tolerance`` height and from the left; one that
    is within the tolerance of the row's first word belongs to the row, else it
    starts the next.  Words are shuffled once, by page; a page of more than
    ``long`` words is walked in parts (``walk``).  What is shuffled after that is
    parts of the rows that are given, with no more than ``most_words`` words.

    Gives ``row_id, y, bbox_x0, bbox_y0, bbox_x1, bbox_y1, text,
    truncated_words`` of the first ``most_rows`` rows of a page, the text of the
    first ``most_words`` words of each, and of the page ``row_count`` and
    ``truncated``.  ``by`` mustn't be null; words without a place are left out.
    """
    rows = words.select(*by, "word", *(F.col(c).cast("double").alias(c) for c in PLACES), F.col("text").cast("string").alias("text")).where(" and ".join(f"{c} is not null and not isnan({c})" for c in PLACES))
    rows = rows.withColumn("_band", F.bround(F.col("y0") / tolerance).cast("long"))
    numbers = ("array<double>", pa.list_(pa.float64()))
    walk = Walk((float("-inf"), 0), partial(stepped, tolerance=tolerance), partial(summed_up, tolerance=tolerance), partial(applied, tolerance=tolerance), [("lower", *numbers), ("top", *numbers), ("rows", "array<long>", pa.list_(pa.int64()))])
    kinds = dict(rows.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in by) + "row_id long, _piece long, y double, bbox_x0 double, bbox_y0 double, bbox_x1 double, bbox_y1 double, _n long, _words array<struct<x0: double, text: string>>"
    pieces = walked_in_order(rows, by, ["_band", "x0", "word"], "y0", walk, _pieces(by, most_rows, most_words), schema, long=long)
    listed = F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_piece", "_words"))), lambda p: p["_words"])), 1, most_words)
    across = F.array_sort(F.transform(listed, lambda w, i: F.struct(F.bround(w["x0"], 1).alias("x"), i.alias("i"), w["text"].alias("text"))))
    found = pieces.repartition(*by).groupBy(*by, "row_id").agg(
        F.min_by("y", "_piece").alias("y"), F.min("bbox_x0").alias("bbox_x0"), F.min("bbox_y0").alias("bbox_y0"), F.max("bbox_x1").alias("bbox_x1"), F.max("bbox_y1").alias("bbox_y1"),
        F.array_join(F.transform(across, lambda w: F.coalesce(w["text"], F.lit(""))), " ").alias("text"),
        (F.sum("_n") > most_words).alias("truncated_words"),
    )
    found = found.withColumn("row_count", F.max("row_id").over(W.partitionBy(*by))).withColumn("truncated", F.col("row_count") > most_rows)
    tenths = [F.bround(c, 1).alias(c) for c in ("y", "bbox_x0", "bbox_y0", "bbox_x1", "bbox_y1")]
    return found.where(F.col("row_id") <= most_rows).select(*by, F.col("row_id").cast("int").alias("row_id"), *tenths, "text", "truncated_words", "row_count", "truncated")
