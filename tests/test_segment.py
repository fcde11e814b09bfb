from __future__ import annotations

import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from sheetweave.operators import layout
from sheetweave.operators import segment as segment_
from sheetweave.operators.segment import segment

HEAD = ["name", "region of sale", "amount"]


def body(n, k=3):
    return [[f"item {i}", str(i), str(10 * i), str(i)][:k] for i in range(1, n + 1)]


def blocks(spark, rows):
    grid = spark.createDataFrame([("s", i, r) for i, r in enumerate(rows)], "source_id string, row_id bigint, cells array<string>")
    return sorted((r["kind"], r["row_start"], r["row_end"], r["column_start"], r["column_end"], tuple(r["columns"] or ())) for r in segment(grid).collect())


CASES = {
    "clean": ([["product name", "region of sale", "amount in total"], *body(5)], [("table", 0, 5, 0, 2, ("product name", "region of sale", "amount in total"))]),
    "metadata then table": (
        [["report title", "", ""], ["made on", "2024", ""], ["", "", ""], ["product name", "region of sale", "amount in total"], *body(6)],
        [("metadata", 0, 1, None, None, ()), ("table", 3, 9, 0, 2, ("product name", "region of sale", "amount in total"))],
    ),
    "footer outside the anchor": (
        [["", "", ""], ["product name", "region of sale", "amount in total"], *body(4), ["", "Rounding error", "1"]],
        [("metadata", 6, 6, None, None, ()), ("table", 1, 5, 0, 2, ("product name", "region of sale", "amount in total"))],
    ),
    "side by side": (
        [["", "", "", "", ""], ["product name", "amount sold", "", "city of store", "visitors there"], ["a", "1", "", "x", "2"], ["b", "2", "", "y", "3"], ["c", "3", "", "", ""]],
        [("table", 1, 3, 3, 4, ("city of store", "visitors there")), ("table", 1, 4, 0, 1, ("product name", "amount sold"))],
    ),
    "stacked": (
        [["product name", "region of sale", "amount in total"], *body(3), ["", "", ""], ["customer name", "country of origin", "orders in total"], *body(3)],
        [("table", 0, 3, 0, 2, ("product name", "region of sale", "amount in total")), ("table", 5, 8, 0, 2, ("customer name", "country of origin", "orders in total"))],
    ),
    "ragged row ends it": (
        [["product name", "region of sale", "amount in total"], *body(5), ["x", "1", "2", "3"], *body(1)],
        [("metadata", 6, 7, None, None, ()), ("table", 0, 5, 0, 2, ("product name", "region of sale", "amount in total"))],
    ),
    # The widest of the first five rows sets the width, so none of the others fits.
    "ragged row among the first": ([["product name", "region of sale", "amount in total"], *body(3), ["x", "1", "2", "3"]], [("metadata", 0, 4, None, None, ())]),
    "blank header cells": ([["", "product name", "", "amount in total"], *body(3, 4)], [("table", 0, 3, 0, 3, ("row_label", "product name", "column_3", "amount in total"))]),
    "one row": ([["only", "one"]], [("metadata", 0, 0, None, None, ())]),
    "blank": ([["", ""]], []),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_blocks(spark, name):
    rows, want = CASES[name]
    assert blocks(spark, rows) == want


# Header candidates against a plain version


def filled(row):
    return [i for i, c in enumerate(row) if c.strip()]


def like_header(row):
    own = [c.strip() for c in row if c.strip()]
    numbers = sum(c.replace(".", "", 1).isdigit() for c in own)
    return len(own) >= 2 and sum(any(x.isalpha() for x in c) for c in own) >= max(2, len(own) - 1) and numbers <= 1


def can_head(rows, i):
    below = []
    for r in rows[i + 1 : i + 4]:
        if not filled(r):
            break
        below.append(r)
    if not like_header(rows[i]) or not below:
        return False
    width = max(len(r) for r in [rows[i], *below])
    return sum(len(r) == width and len(filled(r)) >= 2 for r in below) >= (2 if len(filled(rows[i])) <= 3 else 1)


def stronger_soon(rows, i, gain, prefix, last):
    short = sum(0 < len(c.strip()) <= 10 for c in rows[i])
    is_prefix = len(filled(rows[i])) >= 2 and short >= max(2, round(len(filled(rows[i])) * 0.75))
    for j in range(i + 1, min(last, i + 6, len(rows) - 1) + 1):
        if can_head(rows, j) and ((prefix and is_prefix) or len(filled(rows[j])) >= len(filled(rows[i])) + gain or sum(not a.strip() and bool(b.strip()) for a, b in zip(rows[i], rows[j], strict=False)) >= 2):
            return True
    return False


def candidates(rows):
    out = {}
    for top, bottom, _, _ in layout.boxes(layout.occupancy(rows)):
        able = [i for i in range(max(0, top - 1), bottom + 1) if can_head(rows, i)]
        stable = [i for i in able if not stronger_soon(rows, i, 2, False, bottom)]
        if able:
            i = (stable or able)[0]
            out[i + 1] = (len(filled(rows[i])), stronger_soon(rows, i, 4, True, len(rows)), rows[i])
    return out


def test_header_candidates_and_profiles(spark):
    r = random.Random(6)
    grids = {f"g{n}": [[r.choice(["", "", "name", "longer heading", "x y", "12", "3.5", "Total"]) for _ in range(r.choice([3, 4, 4, 6]))] if r.random() < 0.85 else ["", ""] for _ in range(r.randrange(1, 25))] for n in range(25)}
    grids["blank"] = [["", ""], []]
    df = spark.createDataFrame([(g, i, c) for g, rows in grids.items() for i, c in enumerate(rows)], "source_id string, row_id bigint, cells array<string>").repartition(3)
    got = {x["source_id"]: x for x in segment_.inspected(df, start_row=2, limit=3, start_column=2).collect()}
    for g, rows in grids.items():
        want, x = candidates(rows), got[g]
        found = {c["row"]: (c["non_empty"], c["stronger"], c["cells"]) for c in x["header_candidates"] or []}
        assert found == want, g
        sizes = [len(filled(c)) for c in rows if filled(c)]
        assert (x["row_count"], x["column_count"], x["non_empty_rows"], x["blank_rows"], x["max_non_empty"], x["median_non_empty"]) == (len(rows), max(map(len, rows)), len(sizes), len(rows) - len(sizes), max(sizes, default=0), statistics.median(sizes) if sizes else 0)
        assert [tuple(b) for b in x["regions"] or []] == [tuple(v + 1 for v in b) for b in layout.boxes(layout.occupancy(rows))]
        best = min(want, key=lambda i: (want[i][1], -want[i][0], i), default=None)
        assert (x["header_row"], x["data_row"]) == (best, best and best + 1)
        assert x["sample_rows"] == rows[:5] and x["rows"] == [c[1:] for c in rows[1:4]]
        assert (x["end_row"], x["end_column"]) == (1 + len(rows[1:4]), 1 + max((len(c[1:]) for c in rows[1:4]), default=0))


def test_long_sheets_take_time_in_proportion(spark):
    def seconds(n):
        grid = spark.range(n).select(F.lit("s").alias("source_id"), F.col("id").alias("row_id"), F.array(F.lit("item"), F.col("id").cast("string"), F.lit("1")).alias("cells"))
        began = time.perf_counter()
        assert segment_.described(grid).where("until is null").count() == n
        return time.perf_counter() - began

    seconds(2000)
    assert seconds(80_000) < 10 * seconds(20_000)


@pytest.mark.parametrize("strip", [2, 5, 4096])
def test_regions_in_strips(spark, strip):
    """Regions and holes that cross strips are those of the whole sheet; null keys, null cells and sheets without cells too."""
    r = random.Random(3)
    shapes = [(r.choice([1, 3, 6, 8]), r.randrange(1, 25), r.choice([0.3, 0.6, 0.8, 0.9])) for _ in range(25)]
    grids = {f"g{n}": [["x" if r.random() < full else r.choice(["", " ", "\t"]) for _ in range(width - (r.random() < 0.2))] for _ in range(height)] for n, (width, height, full) in enumerate(shapes)}
    ring = [["x" if i in (1, 11) or j in (0, 4) else "" for j in range(5)] for i in range(12)]
    grids |= {None: ring, "open": [*ring[:6], ["x", "", "", "", ""], *ring[7:]], "none": [[], []]}
    df = spark.createDataFrame([(g, i, c or None) for g, rows in grids.items() for i, c in enumerate(rows)], "source_id string, row_id bigint, cells array<string>").repartition(3)
    got = {g: [] for g in grids}
    for x in layout.regions(df, strip).collect():
        got[x["source_id"]].append(tuple(x)[1:])
    assert {g: sorted(b) for g, b in got.items()} == {g: layout.boxes(layout.occupancy(rows)) for g, rows in grids.items()}
    assert layout.regions(df.where("false"), strip).collect() == []


def test_blocks_across_strips(spark, monkeypatch):
    """A sheet cut every few rows gives the blocks of the whole one."""
    long = [["report title", "", ""], ["", "", ""], ["product name", "region of sale", "amount in total"], *body(17), ["", "", ""], ["note", "", ""], ["more", "", ""], ["and more", "", ""], ["", "", ""], ["customer name", "country of origin", "orders in total"], *body(9)]
    whole = blocks(spark, long)
    monkeypatch.setattr(segment_, "STRIP", 3)
    assert blocks(spark, long) == whole
    assert [b[:3] for b in whole] == [("metadata", 0, 0), ("metadata", 21, 23), ("table", 2, 19), ("table", 25, 34)]
