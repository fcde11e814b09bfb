"""XLSX workbooks as grids: cached values, merged ranges filled, formulas with their references."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# The name spaces of the file format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELL = re.compile(r"\$?([A-Z]{1,3})\$?([0-9]+)")
#: A reference with an optional sheet, as a cell or a range.
REFERENCE = re.compile(r"(?:(?P<sheet>'(?:[^']|'')+'|[A-Za-z_][A-Za-z0-9_.]*)!)?(?P<first>\$?[A-Z]{1,3}\$?[0-9]+)(?::(?P<last>\$?[A-Z]{1,3}\$?[0-9]+))?(?![A-Za-z0-9_(])")


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def position(ref: str) -> tuple[int, int]:
    """Row and column of A1, both from 1."""
    m = CELL.fullmatch(ref)
    if not m:
        raise ValueError(f"not a cell: {ref}")
    return int(m[2]), column_number(m[1])


def references(formula: str) -> list[dict]:
    """Cells and ranges that a formula names, outside of its strings."""
    bare = re.sub(r'"(?:[^"]|"")*"', '""', formula)
    out = []
    for m in REFERENCE.finditer(bare):
        sheet = m["sheet"]
        if sheet and sheet[0] == "'":
            sheet = sheet[1:-1].replace("''", "'")
        (r, c), (s, d) = position(m["first"]), position(m["last"] or m["first"])
        out.append({"sheet": sheet, "row_start": min(r, s), "row_end": max(r, s), "column_start": min(c, d), "column_end": max(c, d)})
    return out


class Workbook:
    """Reads the parts of one workbook's archive."""

    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        rels = ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        target = {r.get("Id"): posixpath.normpath(posixpath.join("xl", r.get("Target"))) if not r.get("Target").startswith("/") else r.get("Target")[1:] for r in rels}
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        self.sheets = {s.get("name"): target[s.get(_REL)] for s in book.iter(f"{_MAIN}sheet")}
        self.shared = []
        if "xl/sharedStrings.xml" in self.zip.namelist():
            for item in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml")):
                self.shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))

    def _value(self, cell: ElementTree.Element) -> str:
        kind = cell.get("t")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
        v = cell.findtext(f"{_MAIN}v")
        if v is None:
            return ""
        if kind == "s":
            return self.shared[int(v)]
        if kind == "b":
            return "True" if v == "1" else "False"
        return v

    def rows(self, sheet: str) -> tuple[list[list[str]], list[dict]]:
        """The sheet's cells as text and its formulas."""
        root = ElementTree.fromstring(self.zip.read(self.sheets[sheet]))
        cells: dict[tuple[int, int], str] = {}
        formulas = []
        for cell in root.iter(f"{_MAIN}c"):
            at = position(cell.get("r"))
            cells[at] = self._value(cell)
            f = cell.findtext(f"{_MAIN}f")
            if f:
                formulas.append({"coordinate": cell.get("r"), "formula": f"={f}", "cached": cells[at], "references": references(f)})
        for merged in root.iter(f"{_MAIN}mergeCell"):
            first, _, last = merged.get("ref").partition(":")
            (r, c), (s, d) = position(first), position(last or first)
            for i in range(r, s + 1):
                for j in range(c, d + 1):
                    cells[i, j] = cells.get((r, c), "")
        height = max((r for r, _ in cells), default=0)
        width = max((c for _, c in cells), default=0)
        return [[cells.get((i, j), "") for j in range(1, width + 1)] for i in range(1, height + 1)], formulas


def _grids(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for page in pages:
        for path, content in zip(page["path"], page["content"], strict=True):
            book = Workbook(bytes(content))
            for sheet in book.sheets:
                rows, _ = book.rows(sheet)
                yield pd.DataFrame({"source_id": path, "sheet": sheet, "row_id": range(len(rows)), "cells": rows})


def _formulas(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for page in pages:
        for path, content in zip(page["path"], page["content"], strict=True):
            book = Workbook(bytes(content))
            for sheet in book.sheets:
                yield pd.DataFrame([{"source_id": path, "sheet": sheet, **f} for f in book.rows(sheet)[1]], columns=["source_id", "sheet", "coordinate", "formula", "cached", "references"])


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Every row of every sheet of the XLSX files under ``path``; a file is read in one task."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_grids, "source_id string, sheet string, row_id bigint, cells array<string>")


def read_formulas(spark: SparkSession, path: str) -> DataFrame:
    """Every formula with its cached value and references."""
    kinds = "source_id string, sheet string, coordinate string, formula string, cached string, references array<struct<sheet:string,row_start:int,row_end:int,column_start:int,column_end:int>>"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_formulas, kinds)
