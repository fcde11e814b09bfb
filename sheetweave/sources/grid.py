"""Grids: ragged text cells in their row order, from CSV bytes or from text columns."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "source_id string, row_id bigint, cells array<string>"
# Encodings in the order of trial, and the delimiters that are sniffed.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
DELIMITERS = ",;\t|"
HEAD_BYTES, SNIFF_CHARS = 65_536, 10_000


def encoding_of(head: bytes) -> str:
    """The first encoding that decodes the head, but for a character cut off at its end."""
    for name in ENCODINGS:
        try:
            head.decode(name)
            return name
        except UnicodeDecodeError as e:
            if name.startswith("utf-8") and len(head) == HEAD_BYTES and e.start >= len(head) - 3:
                return name
    return ENCODINGS[-1]


def dialect_of(sample: str) -> type[csv.Dialect] | csv.Dialect:
    try:
        found = csv.Sniffer().sniff(sample[:SNIFF_CHARS], DELIMITERS)
    except csv.Error:
        return csv.excel
    return csv.excel if found.delimiter in "\r\n" else found


def _parse(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for page in pages:
        for path, content in zip(page["path"], page["content"], strict=True):
            data = bytes(content)
            text = data.decode(encoding_of(data[:HEAD_BYTES]), "replace")
            rows = list(csv.reader(io.StringIO(text, newline=""), dialect_of(text[:SNIFF_CHARS])))
            for lo in range(0, len(rows), 10_000):
                part = rows[lo : lo + 10_000]
                yield pd.DataFrame({"source_id": path, "row_id": range(lo, lo + len(part)), "cells": part})


def read_csv_grids(spark: SparkSession, path: str) -> DataFrame:
    """Every row of every CSV file under ``path`` as text, one file to a task; ragged rows are kept."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_parse, SCHEMA)


def as_grid(table: DataFrame, order: str, source_id: str) -> DataFrame:
    """A table as a grid of its cells; ``order`` numbers the rows."""
    return table.select(F.lit(source_id).alias("source_id"), F.col(order).cast("bigint").alias("row_id"), F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in table.columns)).alias("cells"))


def window(grid: DataFrame, start: int, limit: int, first: int = 1, last: int | None = None) -> DataFrame:
    """Rows ``start`` (from 1) on and columns ``first`` to ``last``."""
    n = F.size("cells") - first + 1 if last is None else F.lit(last - first + 1)
    return grid.where(F.col("row_id").between(start - 1, start + limit - 2)).withColumn("cells", F.slice("cells", F.lit(first), F.greatest(n, F.lit(0))))
