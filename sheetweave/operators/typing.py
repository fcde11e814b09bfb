"""Type inference over text tables, typed projections and content fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import blank, is_date, is_datetime, is_integer, is_real, typed


def infer_types(table: DataFrame) -> DataFrame:
    """``column_name, column_type`` for each column of a text table, from one pass over all rows.

    A type fits if every cell that isn't blank passes its test; a column of
    blanks is TEXT.  INTEGER comes before REAL, DATETIME, DATE and TEXT.
    """
    tests = {
        "INTEGER": is_integer,
        "REAL": lambda c: is_integer(c) | is_real(c),
        "DATETIME": is_datetime,
        "DATE": is_date,
    }
    columns = [f"`{c}`" for c in table.columns]
    fits = [F.every(F.when(blank(F.col(c)), F.lit(None)).otherwise(F.coalesce(test(F.col(c)), F.lit(False)))).alias(f"{i}_{kind}") for i, c in enumerate(columns) for kind, test in tests.items()]
    one = table.agg(*fits)
    rows = [F.struct(F.lit(name).alias("column_name"), F.coalesce(*(F.when(F.col(f"{i}_{kind}"), kind) for kind in tests), F.lit("TEXT")).alias("column_type")) for i, name in enumerate(table.columns)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def typed_view(table: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """The table with every column in its type: one of ``kinds``, where they are known, or else the inferred one."""
    if kinds is None:
        kinds = {r["column_name"]: r["column_type"] for r in infer_types(table).collect()}
    return table.select(*(typed(F.col(f"`{c}`"), kinds[c]).alias(c) for c in table.columns))


def unique_names(names: list[str]) -> list[str]:
    """Blank names become ``column_N``, repeats get ``_2``, ``_3``; upper and lower case count as equal."""
    out: list[str] = []
    seen: set[str] = set()
    for i, name in enumerate(names, 1):
        base = name.strip() or f"column_{i}"
        new, n = base, 2
        while new.lower() in seen:
            new, n = f"{base}_{n}", n + 1
        seen.add(new.lower())
        out.append(new)
    return out


def row_fingerprint(table: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the SHA-256 of each row's cells joined by 0x1f."""
    return table.select(*keys, F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in table.columns)), 256).alias("fingerprint"))


def table_fingerprint(table: DataFrame, order: list[str]) -> DataFrame:
    """One row: the SHA-256 of the header and all rows in order.  For tables that fit one task; see ``tree_fingerprint``."""
    row = F.concat_ws("\x1f", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in table.columns))
    header = "\x1f".join(table.columns)
    listed = F.array_sort(F.collect_list(F.struct(*order, row.alias("_row"))))
    return table.agg(F.sha2(F.concat(F.lit(header + "\x1e"), F.array_join(F.transform(listed, lambda s: s["_row"]), "\x1e")), 256).alias("fingerprint"), F.count("*").alias("row_count"))


def tree_fingerprint(table: DataFrame) -> DataFrame:
    """One row: an order-free fingerprint of any number of rows, by partial sums of row hashes."""
    h = [F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in table.columns)).cast("decimal(38,0)") for seed in (1, 2)]
    return table.agg(F.sha2(F.concat_ws(":", *(F.sum(x).cast("string") for x in h), F.count("*").cast("string")), 256).alias("fingerprint"), F.count("*").alias("row_count"))


def first_of_each(table: DataFrame, by: list[str], order: str) -> DataFrame:
    """Content-addressed reuse: the first row of equal content and how many share it."""
    return table.groupBy(*by).agg(F.min(order).alias(order), F.count("*").alias("copies"))
