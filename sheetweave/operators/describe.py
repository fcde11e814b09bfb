"""Artifacts of a store: what there is, what one holds and where it comes from, and one search over all of it."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.store import Store
from .catalog import touching
from .lineage import MAPPING, source_mappings
from .loading import content_rows, typed_rows
from .search import about, matches, metadata_matches, preview, ranked, search_lines

# Points of a matching cell and of a matching line of a file, a raw table's bias, and characters of a value that are shown.
CELL, LINE, RAW, SHOWN = 45, 35, -2, 300
_ROWS = "row_id long, cells array<string>, fingerprint string"


def artifacts(store: Store) -> DataFrame:
    """``name, type, kind, columns, row_count, create_sql`` of content tables, their typed views and saved views."""
    held = store.table("contents")
    none = F.lit(None).cast("string")
    raw = held.select(F.col("table_name").alias("name"), F.lit("table").alias("type"), F.lit("raw_content_table").alias("kind"), F.col("db_columns").alias("columns"), "row_count", none.alias("create_sql"))
    typed = held.select(F.concat("table_name", F.lit("_typed")).alias("name"), F.lit("view").alias("type"), F.lit("typed_content_view").alias("kind"), F.col("db_columns").alias("columns"), "row_count", none.alias("create_sql"))
    saved = store.table("views").select(F.col("view_name").alias("name"), F.lit("view").alias("type"), F.lit("view_or_table").alias("kind"), F.lit(None).cast("array<string>").alias("columns"), F.lit(None).cast("long").alias("row_count"), F.col("sql").alias("create_sql"))
    return raw.unionByName(typed).unionByName(saved)


def mappings(store: Store) -> DataFrame:
    """``name``, source mapping and ``inherited`` of all artifacts."""
    references = store.table("views").select(F.col("view_name").alias("child"), F.explode("dependencies").alias("parent"))
    return source_mappings(artifacts(store), store.table("contents"), store.table("sources"), references)


def described(store: Store, name: str, *, sample_rows: int = 10, hint_columns: int = 3, hints: int = 5) -> dict[str, Any]:
    """One artifact: kind, columns with types, row count, first rows, values of its first text columns, sources, edges and files.

    Only counts, samples and catalog rows about this artifact come to the
    driver.  A saved view must be registered in the session.
    """
    found = artifacts(store).where(F.col("name") == name).first()
    if found is None:
        return {"status": "error", "error_type": "missing_sql_artifact", "message": f"there is no {name}", "name": name}
    if found["kind"] == "raw_content_table":
        rows = content_rows(store, name).orderBy("row_id").drop("row_id")
    else:
        rows = typed_rows(store, name.removesuffix("_typed")) if found["kind"] == "typed_content_view" else store.spark.table(f"`{name}`")
    texts = [c for c, t in rows.dtypes if t == "string"][:hint_columns]
    values = {c: [r[0] for r in rows.where(F.trim(F.col(f"`{c}`")) != "").select(F.col(f"`{c}`")).distinct().orderBy(f"`{c}`").limit(hints).collect()] for c in texts}
    told = mappings(store).where(F.col("name") == name).select(*MAPPING).orderBy(*MAPPING).collect()
    paths = sorted({r["source_path"] for r in told})
    own = store.spark.createDataFrame([("artifact", name), *(("file", p) for p in paths)], "kind string, id string")
    edges = touching(store.table("edges"), own).orderBy("from_id", "relation", "to_id").collect()
    near = {e[c] for e in edges for k, c in (("from_kind", "from_id"), ("to_kind", "to_id")) if e[k] == "file"} | set(paths)
    return {
        "status": "ok", "name": name, "type": found["type"], "kind": found["kind"], "columns": [{"name": c, "type": t} for c, t in rows.dtypes], "row_count": rows.count() if found["row_count"] is None else found["row_count"],
        "sample_rows": [r.asDict() for r in rows.limit(max(0, sample_rows)).collect()], "value_hints": {c: v for c, v in values.items() if v}, "source_mappings": [r.asDict() for r in told], "source_paths": paths,
        "relations": [e.asDict() for e in edges], "files": [r.asDict() for r in store.table("files").where(F.col("path").isin(*near) if near else F.lit(False)).orderBy("path").collect()],
    }


def _cells(store: Store) -> DataFrame:
    """``id, line, column, value`` of every cell of every published content table, in one scan."""
    held = store.table("contents").select(F.col("table_name").alias("id"), "fingerprint", "folder", "db_columns").where("row_count > 0")
    empty = "id string, line long, column string, value string"
    if held.isEmpty():
        return store.spark.createDataFrame([], empty)
    rows = store.spark.read.schema(_ROWS).parquet(f"{store.path}/contents/*").withColumn("folder", F.concat(F.lit("contents/"), F.regexp_extract("_metadata.file_path", "/contents/([^/]+)/", 1)))
    cut = rows.join(held, ["fingerprint", "folder"]).select("id", (F.col("row_id") + 1).alias("line"), F.posexplode("cells").alias("_i", "value"), "db_columns")
    return cut.where(F.col("_i") < F.size("db_columns")).select("id", "line", F.get("db_columns", F.col("_i")).alias("column"), "value")


def found(store: Store, query: str, *, scope: str = "all", artifact: str | None = None, files: DataFrame | None = None, most: int = 20, **how) -> DataFrame:
    """``type, id, line, field, value, rank``: the ``most`` best matches in metadata, cells and lines of ``files(path, type, refs, text)``.

    ``scope`` is ``metadata``, ``rows``, ``files`` or ``all``.  With ``artifact``
    only matches of that artifact count, and lines of files whose path or text
    holds its name or that refer to it.  Cells are those of content tables; a
    typed view shows the same ones.  An empty query is an error.
    """
    text, parts = query.strip(), []
    if not text:
        raise ValueError("the query is empty")
    if scope not in ("all", "metadata", "rows", "files"):
        raise ValueError("scope is one of all, metadata, rows, files")
    how.setdefault("case_sensitive", text != text.lower())
    columns = ["type", "id", "line", "field", "value", "rank"]
    if scope in ("all", "metadata"):
        every = artifacts(store)
        paths = mappings(store).groupBy("name").agg(F.array_sort(F.collect_set("source_path")).alias("paths"))

        def field(kind: str, value) -> Column:
            return F.struct(F.lit(kind).alias("field"), value.alias("value"))

        def each(column: str, kind: str) -> Column:
            none = F.array().cast("array<struct<field:string,value:string>>")
            return F.coalesce(F.transform(column, lambda v: field(kind, v)), none)

        listed = F.concat(F.array(field("name", F.col("name")), field("type", F.concat(F.lit("sqlite_"), "type")), field("kind", F.col("kind"))), each("columns", "column"), each("paths", "source_path"), F.array(field("create_sql", F.col("create_sql"))))
        fields = every.join(paths, "name", "left").select(F.col("name").alias("id"), F.concat(F.lit("sqlite_"), "type").alias("type"), "kind", F.posexplode(listed).alias("position", "f")).select("id", "type", "kind", "position", "f.*")
        hits = metadata_matches(fields if artifact is None else fields.where(F.col("id") == artifact), text, **how)
        parts.append(hits.withColumn("line", F.lit(None).cast("long")).select(*columns))
    if scope in ("all", "rows"):
        cells = _cells(store) if artifact is None else _cells(store).where(F.col("id") == artifact)
        hits = cells.where(matches(F.col("value"), text, **how))
        parts.append(hits.select(F.lit("sqlite_table").alias("type"), "id", "line", F.col("column").alias("field"), preview(F.col("value"), SHOWN).alias("value"), F.lit(CELL + RAW).cast("long").alias("rank")))
    if scope in ("all", "files") and files is not None:
        own = files if artifact is None else about(files.withColumn("id", F.col("path")), artifact).drop("id")
        lines = search_lines(own.withColumn("_key", F.struct("path", "type")), "_key", "text", text, **how)
        parts.append(lines.select(F.col("_key.type").alias("type"), F.col("_key.path").alias("id"), F.col("line_no").alias("line"), F.lit("line").alias("field"), preview(F.col("line"), SHOWN).alias("value"), F.lit(LINE).cast("long").alias("rank")))
    if not parts:
        return store.spark.createDataFrame([], "type string, id string, line long, field string, value string, rank long")
    results = parts[0]
    for part in parts[1:]:
        results = results.unionByName(part)
    return ranked(results, max(1, most))
