"""From sheets to loaded tables in one operation: blocks are found, their rows cut out, loaded and told about."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.store import Store
from ..session import checkpointed
from .inspection import formula_overlay
from .layout import footers
from .loading import TABLE, db_columns, load_tables
from .segment import in_reach, segment

# Rows of a metadata block that are looked at, where a document's reviewed tables and their list lie, and what is told of an entry.
METADATA_ROWS, TABLES, MANIFEST = 20, "/work/tables/", "tables_manifest.json"
ENTRY_KEYS = ("document_order", "name", "page_tag", "source_page", "source_pages", "source_tables", "source_bboxes", "split_value", "split_values", "merge_evidence", "table_end_reasons")
_BREAK = "\x1f"
_PLACE = ["row_start", "row_end", "column_start", "column_end"]


@dataclass
class Extraction:
    """``sheets``: status and sizes of each; ``tables``: where each lies and what became of it; ``excluded``: footer rows that no table has."""

    sheets: DataFrame
    tables: DataFrame
    excluded: DataFrame


def provenance(entries: DataFrame) -> DataFrame:
    """``tables_dir, file_name, metadata`` of ``entries(manifest_path, document, position, entry)``, JSON texts of a manifest's tables in their order.

    ``metadata`` is a JSON text that names the document, the manifest, its
    number of tables, those before and after and what the entry tells of itself.
    Of entries with the same file name the first counts; those that aren't
    objects, or name no file, stand for no table, and the former don't count.
    """
    own = entries.withColumn("_e", F.try_parse_json("entry")).where("schema_of_variant(_e) like 'OBJECT%'")
    order = W.partitionBy("manifest_path").orderBy("position")

    def name(at: Column) -> Column:
        return F.coalesce(at, F.lit(""))

    told = own.withColumn("_name", F.get_json_object("entry", "$.name"))
    told = told.select(
        "manifest_path", "position", "entry", F.coalesce("document", F.lit("")).alias("pdf_source_path"), F.count("*").over(W.partitionBy("manifest_path")).alias("pdf_table_count"), F.row_number().over(order).alias("_n"),
        name(F.lag("_name").over(order)).alias("previous_pdf_table_name"), name(F.lead("_name").over(order)).alias("next_pdf_table_name"), F.substring_index(F.get_json_object("entry", "$.path"), "/", -1).alias("file_name"),
    )
    base = F.to_json(F.struct(F.lit("pdf_table_csv").alias("source_kind"), F.col("manifest_path").alias("tables_manifest_path"), "pdf_source_path", "pdf_table_count", "previous_pdf_table_name", "next_pdf_table_name"))
    fields = F.from_json("entry", "map<string,variant>")
    kept = F.map_filter(fields, lambda k, _: k.isin(*ENTRY_KEYS))
    number = F.when(~F.map_contains_key(fields, F.lit("document_order")), F.concat(F.lit(',"pdf_table_document_order":'), F.col("_n").cast("string"))).otherwise("")
    extra = F.to_json(F.transform_keys(kept, lambda k, _: F.concat(F.lit("pdf_table_"), k)), {"ignoreNullFields": "false"})
    whole = F.concat(F.regexp_replace(base, r"\}$", ""), number, F.when(F.length(extra) > 2, F.concat(F.lit(","), F.substr(extra, F.lit(2)))).otherwise("}"))
    placed = told.where("file_name != ''").select(F.concat(F.regexp_replace("manifest_path", "[^/]*$", ""), F.lit("tables")).alias("tables_dir"), "file_name", "_n", whole.alias("metadata"))
    return placed.groupBy("tables_dir", "file_name").agg(F.min_by("metadata", "_n").alias("metadata"))


def reviewed(paths: DataFrame, entries: DataFrame) -> DataFrame:
    """``source_path, metadata`` of the ``paths(source_path)`` that lie in a folder of reviewed tables and stand in its manifest."""
    split = F.substring_index("source_path", "/", -1)
    own = paths.select("source_path").distinct().withColumn("file_name", split).withColumn("tables_dir", F.expr("left(source_path, length(source_path) - length(file_name) - 1)"))
    inside = own.where(F.contains("source_path", F.lit(TABLES)) & F.endswith("tables_dir", F.lit(TABLES.rstrip("/"))))
    return inside.join(provenance(entries), ["tables_dir", "file_name"]).select("source_path", "metadata")


def _reviewed_blocks(grid: DataFrame) -> DataFrame:
    """The whole sheet as one table under its first row."""
    head = grid.where("row_id = 0").select("source_id", F.transform("cells", lambda c, i: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c)).otherwise(F.concat(F.lit("column_"), (i + 1).cast("string")))).alias("columns"))
    ends = grid.groupBy("source_id").agg(F.max("row_id").alias("row_end"))
    return head.join(ends, "source_id").select("source_id", F.lit("table").alias("kind"), F.lit(0).cast("long").alias("row_start"), "row_end", F.lit(0).alias("column_start"), (F.size("columns") - 1).alias("column_end"), "columns")


def table_rows(tables: DataFrame, grid: DataFrame) -> DataFrame:
    """``TABLE, row_id, cells`` of ``tables`` (from 0, header first): as many cells as it has columns, missing ones empty."""
    body = grid.select(F.col("source_id").alias("_s"), F.col("row_id").alias("r"), F.col("cells").alias("_cells"))
    spans = tables.select("source_id", *TABLE, "row_start", "row_end", "column_start", F.size("columns").alias("_w"))
    met = in_reach(spans, F.col("row_start") + 1, F.col("row_end"), body)
    cut = F.expr("transform(slice(_cells, column_start + 1, _w), c -> coalesce(c, ''))")
    return met.withColumn("_cut", F.coalesce(cut, F.array().cast("array<string>"))).select(*TABLE, (F.col("r") - F.col("row_start") - 1).cast("long").alias("row_id"), F.concat("_cut", F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.col("_w") - F.size("_cut")))).alias("cells"))


def extract(store: Store, grids: DataFrame, *, source_format: str = "csv", entries: DataFrame | None = None, taken: DataFrame | None = None) -> Extraction:
    """Recover the tables of ``grids(source_path, source_sheet_name, row_id, cells)`` and load them.

    Sheets of any number of files are segmented at once; tables are named
    ``table_1`` and so on from the top, from the left.  A sheet of a document's
    reviewed tables, told by ``entries`` of manifests, is one table under its
    first row.  A sheet without a table is ``empty``.  Excluded rows lie after
    their sheet's last table, within the first ``METADATA_ROWS`` of a block, and
    say total or the like.  Places count from 1.  Sheets without a path are an error.
    """
    sheet = F.coalesce("source_sheet_name", F.lit(""))
    if not grids.where("coalesce(trim(source_path), '') = ''").isEmpty():
        raise ValueError("a sheet needs a path")
    grid = grids.select(F.concat("source_path", F.lit(_BREAK), sheet).alias("source_id"), F.col("row_id").cast("long").alias("row_id"), F.transform("cells", lambda c: F.coalesce(c, F.lit(""))).alias("cells"))
    grid = grid.withColumn("cells", F.coalesce("cells", F.array().cast("array<string>")))
    path, name = (F.element_at(F.split("source_id", _BREAK), i) for i in (1, 2))
    plain, known = grid, None
    if entries is not None:
        known = checkpointed(reviewed(grids, entries))
        keyed = grid.withColumn("source_path", path)
        plain = keyed.join(known, "source_path", "left_anti").select(*grid.columns)
        told = _reviewed_blocks(keyed.join(known, "source_path", "left_semi").select(*grid.columns))
    blocks = segment(plain)
    blocks = checkpointed(blocks if known is None else blocks.unionByName(told))
    order = W.partitionBy("source_id").orderBy("row_start", "column_start", "row_end")
    tables = blocks.where("kind = 'table'").withColumn("source_table_name", F.concat(F.lit("table_"), F.row_number().over(order).cast("string")))
    tables = tables.drop("kind").withColumn("source_path", path).withColumn("source_sheet_name", name)
    tables = tables.withColumn("source_metadata_json", F.lit("{}")) if known is None else tables.join(known.withColumnRenamed("metadata", "source_metadata_json"), "source_path", "left").withColumn("source_metadata_json", F.coalesce("source_metadata_json", F.lit("{}")))
    tables = checkpointed(tables)
    asked = tables.select(*TABLE, F.lit(source_format).alias("source_format"), "columns", "source_metadata_json")
    loaded = checkpointed(load_tables(store, asked, table_rows(tables, grid), taken=taken))
    from_one = [(F.col(c) + 1).cast("long").alias(c) for c in _PLACE]
    placed = tables.select(*TABLE, *from_one, (F.col("row_start") + 1).alias("header_row"), "columns", db_columns(F.col("columns")).alias("db_columns"), "source_metadata_json").join(loaded, TABLE)
    sizes = grid.groupBy("source_id").agg(F.count("*").alias("row_count"), F.max(F.size("cells")).cast("long").alias("column_count"))
    ends = tables.groupBy("source_id").agg(F.count("*").alias("recovered_table_count"), F.max("row_end").alias("_end"))
    status = F.when(F.col("recovered_table_count").isNull(), "empty").otherwise("loaded")
    sheets = sizes.join(ends, "source_id", "left").select(path.alias("source_path"), name.alias("source_sheet_name"), F.lit(source_format).alias("source_format"), status.alias("status"), "row_count", "column_count", F.coalesce("recovered_table_count", F.lit(0)).cast("long").alias("recovered_table_count"))
    notes = blocks.where("kind = 'metadata'").join(ends, "source_id").where("row_start > _end").select("source_id", "row_start", "row_end")
    rows = footers(grid).select(F.col("source_id").alias("_s"), F.col("row_id").alias("r"), "cells")
    hits = in_reach(notes, F.col("row_start"), F.least("row_end", F.col("row_start") + METADATA_ROWS - 1), rows)
    excluded = hits.select(path.alias("source_path"), name.alias("source_sheet_name"), (F.col("r") + 1).alias("row"), F.col("cells").alias("values"), F.lit("footer_like_label").alias("reason"))
    return Extraction(sheets, placed, excluded)


def formulas_with_tables(formulas: DataFrame, tables: DataFrame) -> DataFrame:
    """``formulas(source_path, source_sheet_name, row, column, ...)`` with ``table_refs``: the tables of an extraction that hold them, and where."""
    key = F.concat("source_path", F.lit(_BREAK), F.coalesce("source_sheet_name", F.lit("")))
    own = formulas.withColumn("sheet", key)
    spans = tables.select(key.alias("sheet"), F.col("table_name").alias("name"), "row_start", "row_end", "column_start", "column_end", "header_row", "columns", "db_columns")
    met = formula_overlay(own.select("sheet", "row", "column").distinct(), spans)
    refs = met.groupBy("sheet", "row", "column").agg(F.array_sort(F.collect_list(F.struct("name", "role", "table_row", "table_column", "column_name", "db_column"))).alias("table_refs"))
    return own.join(refs, ["sheet", "row", "column"], "left").drop("sheet").withColumn("table_refs", F.coalesce("table_refs", F.expr("cast(array() as array<struct<name:string,role:string,table_row:bigint,table_column:int,column_name:string,db_column:string>>)")))


def formulas_in_window(formulas: DataFrame, row_start: int, row_end: int, column_start: int, column_end: int) -> DataFrame:
    return formulas.where(F.col("row").between(row_start, row_end) & F.col("column").between(column_start, column_end))
