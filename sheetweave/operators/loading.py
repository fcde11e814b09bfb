"""Loading of recovered tables: fingerprints, names, one write of the contents, one published change; replacement by manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.store import Store
from ..session import checkpointed
from .catalog import source_edges, without
from .typing import typed_view

TABLE = ["source_path", "source_sheet_name", "source_table_name"]
#: Rows of a table that are hashed together.
STRIP = 4096


def content_fingerprints(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """``TABLE, fingerprint, row_count`` of ``tables(TABLE, columns)`` with ``rows(TABLE, row_id, cells)``.

    A tree of SHA-256: of each row's cells, of strips of rows in their order, and
    of the header and the strips.  Equal tables in equal order have equal
    fingerprints, however long they are, and no table is one task.  Null cells
    are empty.
    """
    cell = F.transform("cells", lambda c: F.concat(F.coalesce(c, F.lit("")), F.lit("\x1f")))
    hashed = rows.select(*TABLE, F.col("row_id"), F.floor(F.col("row_id") / STRIP).alias("_strip"), F.sha2(F.array_join(cell, ""), 256).alias("_h"))

    def joined(order: str, value: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "\x1e")

    strips = hashed.groupBy(*TABLE, "_strip").agg(F.sha2(joined("row_id", "_h"), 256).alias("_s"), F.count("*").alias("_n"))
    whole = strips.groupBy(*TABLE).agg(joined("_strip", "_s").alias("_all"), F.sum("_n").alias("row_count"))
    header = F.array_join(F.transform("columns", lambda c: F.concat(F.coalesce(c, F.lit("")), F.lit("\x1f"))), "")
    found = tables.drop("fingerprint", "row_count").join(whole, TABLE, "left")
    return found.withColumn("fingerprint", F.sha2(F.concat_ws("\x1a", header, F.coalesce("_all", F.lit(""))), 256)).withColumn("row_count", F.coalesce("row_count", F.lit(0))).drop("_all")


def source_stem(path: Column) -> Column:
    """A file's name in lower case, without its extension, other characters than letters, digits and brackets as single underscores."""
    name = F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)
    stem = F.when(F.instr(F.substr(name, F.lit(2)), ".") > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(stem), r"[^a-z0-9()]+", "_"), "_+", "_"), "^_+|_+$", "")
    return F.when(clean == "", "source").otherwise(clean)


def allocated_names(wanted: DataFrame, used: DataFrame) -> DataFrame:
    """``wanted(place, base)`` with a free ``name`` each: the base, or ``base_2``, ``base_3`` and so on.

    A name is free if neither it nor ``<name>_typed`` is among ``used(name)`` or
    given to an earlier place.  All places ask at once: the r-th one of a base
    takes the r-th gap in the base's taken numbers.  Where a name that one base
    makes is another base's, places before the first clash are settled, the rest
    asks again.  ``place`` is distinct.
    """
    todo, taken, settled = checkpointed(wanted.select("place", "base")), used.select("name").distinct(), None
    while True:
        bare = taken.select(F.explode(F.array_distinct(F.array("name", F.regexp_replace("name", "_typed$", "")))).alias("v"))
        number = F.regexp_extract("v", "_([1-9][0-9]{0,8})$", 1)
        numbered = bare.where((number != "") & (number != "1")).select(F.regexp_replace("v", "_[0-9]+$", "").alias("base"), number.cast("int").alias("k"))
        numbers = bare.select(F.col("v").alias("base"), F.lit(1).alias("k")).unionByName(numbered).distinct()
        # Free numbers below the j-th taken one: the number less j.  The r-th free one is r and the taken ones with fewer than r below.
        below = numbers.withColumn("_at", F.col("k") - F.row_number().over(W.partitionBy("base").orderBy("k"))).select("base", "_at", F.lit(None).cast("long").alias("place"), F.lit(1).alias("_taken"))
        asks = todo.withColumn("_at", F.row_number().over(W.partitionBy("base").orderBy("place"))).select("base", "_at", F.col("place").cast("long").alias("place"), F.lit(0).alias("_taken"))
        order = W.partitionBy("base").orderBy("_at", "_taken").rowsBetween(W.unboundedPreceding, W.currentRow)
        offered = below.join(todo.select("base").distinct(), "base", "left_semi").unionByName(asks).withColumn("k", F.col("_at") + F.sum("_taken").over(order)).where("_taken = 0")
        named = checkpointed(offered.select("place", "base", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("k").cast("string"))).alias("name")))
        claims = named.select("place", F.explode(F.array(F.col("name"), F.concat("name", F.lit("_typed")))).alias("claim"))
        clash = claims.groupBy("claim").agg(F.sort_array(F.collect_set("place")).alias("p")).where(F.size("p") > 1).agg(F.min(F.col("p")[1])).first()[0]
        done = named if clash is None else named.where(F.col("place") < clash)
        settled = done if settled is None else settled.unionByName(done)
        if clash is None:
            return settled
        settled = checkpointed(settled)
        todo = checkpointed(todo.where(F.col("place") >= clash))
        taken = checkpointed(taken.unionByName(done.select(F.explode(F.array(F.col("name"), F.concat("name", F.lit("_typed")))).alias("name"))).distinct())


def db_columns(columns: Column) -> Column:
    """Column names that are distinct: blank ones by position, repeated ones numbered from 2."""
    named = F.transform(columns, lambda c, i: F.when(F.coalesce(c, F.lit("")) == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(c))
    return F.transform(named, lambda c, i: F.when(F.size(F.filter(F.slice(named, F.lit(1), i), lambda x: x == c)) == 0, c).otherwise(F.concat_ws("_", c, (F.size(F.filter(F.slice(named, F.lit(1), i), lambda x: x == c)) + 1).cast("string"))))


def load_tables(store: Store, tables: DataFrame, rows: DataFrame, *, taken: DataFrame | None = None) -> DataFrame:
    """Load ``tables(TABLE, source_format, columns[, source_metadata_json])`` with ``rows(TABLE, row_id, cells)``; gives what became of each.

    Content that the catalog has, by its fingerprint, is reused; of several
    tables with the same new content the first by ``TABLE`` is loaded.  New
    contents get names that are free in the catalog and in ``taken(name)``, and
    their rows go out in one write, a folder a fingerprint.  Contents, sources,
    edges and files then change in one published version, so loading the same
    tables again loads nothing, and a load that breaks off leaves the catalog as
    it was.  Tables without a path or a name are an error.
    """
    base = store.version()
    contents, sources = store.table("contents", base), store.table("sources", base)
    bare = tables.where(" or ".join(f"coalesce(trim({c}), '') = ''" for c in ("source_path", "source_table_name", "source_format"))).select("source_path", "source_table_name").first()
    if bare is not None:
        raise ValueError(f"a table needs a path, a format and a name: {bare.asDict()}")
    if "source_metadata_json" not in tables.columns:
        tables = tables.withColumn("source_metadata_json", F.lit("{}"))
    asked = tables.select(F.col("source_path"), F.coalesce("source_sheet_name", F.lit("")).alias("source_sheet_name"), "source_table_name", "source_format", "columns", "source_metadata_json")
    own = rows.select("source_path", F.coalesce("source_sheet_name", F.lit("")).alias("source_sheet_name"), "source_table_name", "row_id", "cells")
    printed = checkpointed(content_fingerprints(asked, own))
    first = printed.groupBy("fingerprint").agg(F.min(F.struct(*TABLE)).alias("_first"))
    fresh = printed.join(first, "fingerprint").where(F.struct(*TABLE) == F.col("_first")).drop("_first").join(contents, "fingerprint", "left_anti")
    used = contents.select(F.explode(F.array("table_name", F.concat("table_name", F.lit("_typed")))).alias("name")).unionByName(store.table("views", base).select(F.col("view_name").alias("name")))
    if taken is not None:
        used = used.unionByName(taken.select("name"))
    placed = checkpointed(fresh.withColumn("place", F.row_number().over(W.orderBy(*TABLE)).cast("long")).withColumn("base", source_stem(F.col("source_path"))))  # a row a table, not of its rows
    named = allocated_names(placed, used).select("place", F.col("name").alias("table_name"))
    folder = f"contents/{uuid.uuid4().hex}"
    loaded = checkpointed(placed.join(named, "place").withColumn("db_columns", db_columns(F.col("columns"))).withColumn("folder", F.lit(folder)))
    if not loaded.isEmpty():
        own.join(loaded.select(*TABLE, "fingerprint"), TABLE).select("fingerprint", "row_id", "cells").repartition("fingerprint", F.floor(F.col("row_id") / (STRIP * 64))).write.partitionBy("fingerprint").parquet(f"{store.path}/{folder}")
    whole = contents.unionByName(loaded.select(*contents.columns))
    told = printed.select(*sources.columns).unionByName(sources).dropDuplicates([*TABLE, "fingerprint"])
    by_name = printed.join(whole.select("fingerprint", "table_name"), "fingerprint")
    edges = store.table("edges", base).unionByName(source_edges(by_name)).distinct()
    files = store.table("files", base).unionByName(printed.select(F.col("source_path").alias("path"), F.lit("source").alias("kind"))).distinct()
    store.publish(base, contents=whole, sources=told, edges=edges, files=files)
    status = F.when(F.col("_new").isNotNull(), "loaded").otherwise("reused")
    marks = loaded.select(*TABLE, F.lit(True).alias("_new"))
    return by_name.join(marks, TABLE, "left").select(*TABLE, "fingerprint", "table_name", F.concat("table_name", F.lit("_typed")).alias("typed_view_name"), "row_count", status.alias("load_status"))


def content_rows(store: Store, table_name: str) -> DataFrame:
    """A content table by its name, all cells text; missing cells are empty."""
    held = store.table("contents").where(F.col("table_name") == table_name).first()
    if held is None:
        raise KeyError(table_name)
    folder = f"{store.path}/{held['folder']}/fingerprint={held['fingerprint']}"
    rows = store.spark.read.schema("row_id long, cells array<string>").parquet(folder) if held["row_count"] else store.spark.createDataFrame([], "row_id long, cells array<string>")
    return rows.select("row_id", *(F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(held["db_columns"])))


def typed_rows(store: Store, table_name: str) -> DataFrame:
    """The typed view of a content table."""
    return typed_view(content_rows(store, table_name).drop("row_id"))


def belongs(path: Column, metadata: Column, document: str, tables_dir: str, manifest: str) -> Column:
    """Whether a source row came from a document: its path lies in the document's folder of tables, or its metadata names the document or the manifest."""
    told = [F.coalesce(F.get_json_object(metadata, f"$.{k}") == v, F.lit(False)) for k, v in (("pdf_source_path", document), ("tables_manifest_path", manifest))]
    return F.coalesce(F.startswith(path, F.lit(tables_dir.rstrip("/") + "/")), F.lit(False)) | told[0] | told[1]


def replaced(sources: DataFrame, contents: DataFrame, edges: DataFrame, files: DataFrame, stale: Column, document: str) -> dict[str, DataFrame]:
    """The four catalog tables once the sources where ``stale`` holds are gone, by mark and sweep.

    Contents that only stale sources have go, with their typed views.  Edges go
    that touch the fingerprint of a stale source, the name of a table or view
    that went, or a path of a stale source; so do the files of those paths.  If
    any source is stale, the document's own path counts as one of theirs.
    """
    marked = sources.withColumn("_stale", F.coalesce(stale, F.lit(False)))
    kept, gone = marked.where(~F.col("_stale")).drop("_stale"), marked.where("_stale")
    prints = gone.select("fingerprint").distinct()
    swept = contents.join(prints, "fingerprint", "left_semi").join(kept, "fingerprint", "left_anti")
    paths = gone.select("source_path").unionByName(gone.select(F.lit(document).alias("source_path"))).distinct()
    names = swept.select(F.explode(F.array("table_name", F.concat("table_name", F.lit("_typed")))).alias("id"))
    ids = prints.select(F.lit("content").alias("kind"), F.col("fingerprint").alias("id")).unionByName(names.select(F.lit("artifact").alias("kind"), "id")).unionByName(paths.select(F.lit("file").alias("kind"), F.col("source_path").alias("id")))
    return {"sources": kept, "contents": contents.join(swept.select("fingerprint"), "fingerprint", "left_anti"), "edges": without(edges, ids), "files": files.join(paths.withColumnRenamed("source_path", "path"), "path", "left_anti")}


def replace_document(store: Store, document: str, tables_dir: str, manifest: str) -> dict[str, int]:
    """Take a document's earlier tables out of the catalog in one published change; counts of sources and contents that went."""
    base = store.version()
    names = ("sources", "contents", "edges", "files")
    was = {n: store.table(n, base) for n in names}
    stale = belongs(F.col("source_path"), F.col("source_metadata_json"), document, tables_dir, manifest)
    now = replaced(*(was[n] for n in names), stale, document)
    now = {n: checkpointed(df) for n, df in now.items()}
    count = {n: was[n].count() - now[n].count() for n in ("sources", "contents")}
    if count["sources"]:
        store.publish(base, **now)
    return {"replaced_source_count": count["sources"], "replaced_table_count": count["contents"]}


def manifest_order(entries: DataFrame) -> DataFrame:
    """``entries(position, document_order, ...)`` with ``load_order``: by document order where that is a whole number, else by position from 1."""
    told = F.coalesce(F.trim("document_order").try_cast("int"), F.col("position"))
    return entries.withColumn("load_order", F.row_number().over(W.orderBy(told, "position")))  # a row a table of one manifest


def ingest_manifest(store: Store, document: str, tables_dir: str, manifest: str, tables: DataFrame, rows: DataFrame) -> DataFrame:
    """Replace a document's tables by the current ones of its manifest; what became of each table.

    ``tables`` are as for ``load_tables``.  The metadata names the document and the manifest, so that the next replacement finds them.
    """
    replace_document(store, document, tables_dir, manifest)
    told = F.to_json(F.struct(F.lit(document).alias("pdf_source_path"), F.lit(manifest).alias("tables_manifest_path")))
    return load_tables(store, tables.withColumn("source_metadata_json", told), rows)
