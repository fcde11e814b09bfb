from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sheetweave.operators import extract, loading
from sheetweave.plans.store import Store

GRID = "source_path string, source_sheet_name string, row_id bigint, cells array<string>"
HEAD = ["product name", "region of sale", "amount in total"]


def body(n):
    return [[f"item {i}", f"place {i}", str(10 * i)] for i in range(1, n + 1)]


def grid(spark, sheets):
    return spark.createDataFrame([(p, s, i, c) for (p, s), rows in sheets.items() for i, c in enumerate(rows)], GRID)


def test_extract(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    blank = ["", "", ""]
    two = [["report", "", ""], blank, HEAD, *body(3), blank, ["customer name", "country of origin", "orders in total"], *body(4), blank, ["", "Grand Total", "9"], ["note", "", ""], blank, *[["", "Total", "1"]] * 21]
    sheets = grid(spark, {("in/Book.xlsx", "first"): two, ("in/Book.xlsx", "second"): [HEAD, *body(3)], ("in/Book.xlsx", None): [["only a note"], None]})
    done = extract.extract(store, sheets, source_format="xlsx")
    told = {(r["source_sheet_name"], r["source_table_name"]): r for r in done.tables.collect()}
    assert {k: (r["row_start"], r["row_end"], r["header_row"], r["row_count"], r["load_status"]) for k, r in told.items()} == {
        ("first", "table_1"): (3, 6, 3, 3, "loaded"),
        ("first", "table_2"): (8, 12, 8, 4, "loaded"),
        ("second", "table_1"): (1, 4, 1, 3, "reused"),
    }
    names = {k: r["table_name"] for k, r in told.items()}
    assert names["first", "table_1"] == names["second", "table_1"] and sorted(set(names.values())) == ["book", "book_2"]
    got = loading.content_rows(store, names["first", "table_2"]).orderBy("row_id")
    assert got.columns[1:] == ["customer name", "country of origin", "orders in total"] and [list(r)[1:] for r in got.collect()] == body(4)
    assert {(r["source_sheet_name"], r["status"], r["recovered_table_count"]) for r in done.sheets.collect()} == {("first", "loaded", 2), ("second", "loaded", 1), ("", "empty", 0)}
    # The first 20 rows of a block are looked at.
    assert sorted(r["row"] for r in done.excluded.collect()) == [14, *range(17, 37)]
    formulas = spark.createDataFrame([("in/Book.xlsx", "first", 9, 3, "=1"), ("in/Book.xlsx", "first", 8, 1, "=2"), ("in/Book.xlsx", None, 9, 3, "=3")], "source_path string, source_sheet_name string, row long, column long, formula string")
    refs = {r["formula"]: [(x["name"], x["role"], x["column_name"]) for x in r["table_refs"]] for r in extract.formulas_with_tables(formulas, done.tables).collect()}
    assert refs == {"=1": [(names["first", "table_2"], "data", "orders in total")], "=2": [(names["first", "table_2"], "header", "customer name")], "=3": []}
    assert [r["formula"] for r in extract.formulas_in_window(formulas, 8, 8, 1, 2).collect()] == ["=2"]
    again = extract.extract(store, sheets, source_format="xlsx").tables
    assert {r["load_status"] for r in again.collect()} == {"reused"} and store.table("contents").count() == 2


def test_extract_without_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    none = extract.extract(store, spark.createDataFrame([], GRID))
    assert none.sheets.collect() == none.tables.collect() == none.excluded.collect() == []
    with pytest.raises(ValueError):
        extract.extract(store, grid(spark, {(None, ""): [HEAD]}))


def test_reviewed_tables(spark, tmp_path):
    tables = [
        {"name": "one", "path": "/elsewhere/a.csv", "source_pages": [1, 2], "split_value": None, "unknown": 1},
        {"name": "two", "path": "work/tables/b.csv", "document_order": 7},
        {"path": "a.csv", "name": "repeated"},
        {"name": "three"},
    ]
    listed = [("d/work/tables_manifest.json", "d.pdf", i, json.dumps(t)) for i, t in enumerate(tables)]
    listed.insert(1, ("d/work/tables_manifest.json", "d.pdf", 9, '"no object"'))
    listed += [("d/work/tables_manifest.json", "d.pdf", 10, "no json"), ("d/work/tables_manifest.json", "d.pdf", 11, None)]
    entries = spark.createDataFrame(listed, "manifest_path string, document string, position int, entry string")
    paths = spark.createDataFrame([("d/work/tables/a.csv",), ("d/work/tables/b.csv",), ("d/work/other/b.csv",), ("d/work/tables/c.csv",), ("b.csv",)], "source_path string")
    told = {r["source_path"]: json.loads(r["metadata"]) for r in extract.reviewed(paths, entries).collect()}
    base = {"source_kind": "pdf_table_csv", "tables_manifest_path": "d/work/tables_manifest.json", "pdf_source_path": "d.pdf", "pdf_table_count": 4}
    assert told == {
        "d/work/tables/a.csv": base | {"previous_pdf_table_name": "", "next_pdf_table_name": "two", "pdf_table_name": "one", "pdf_table_source_pages": [1, 2], "pdf_table_split_value": None, "pdf_table_document_order": 1},
        "d/work/tables/b.csv": base | {"previous_pdf_table_name": "one", "next_pdf_table_name": "repeated", "pdf_table_name": "two", "pdf_table_document_order": 7},
    }
    store = Store(spark, str(tmp_path))
    sheets = grid(spark, {("d/work/tables/b.csv", None): [[" name ", "", "n"], ["x"], ["y", "1", "2", "3"], None]})
    done = extract.extract(store, sheets, entries=entries)
    row = done.tables.first()
    assert (row["columns"], row["row_start"], row["row_end"], row["row_count"], row["column_end"]) == (["name", "column_2", "n"], 1, 4, 3, 3)
    assert [list(r)[1:] for r in loading.content_rows(store, row["table_name"]).orderBy("row_id").collect()] == [["x", "", ""], ["y", "1", "2"], ["", "", ""]]
    assert store.table("sources").where(F.get_json_object("source_metadata_json", "$.pdf_table_document_order") == "7").count() == 1
