"""Saved views: named queries in a store, with their references as lineage."""

from __future__ import annotations

import hashlib
import re
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .guard import NotReadOnly, checked_query, referenced_names
from .store import Store

# The form of a view's name, and beginnings that are reserved.
NAME = r"[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*"
RESERVED = ("sqlite_", "_tabular_")


def _refused(kind: str, message: str, name: str | None = None) -> dict[str, Any]:
    return {"status": "error", "error_type": kind, "message": message, "view_name": name}


def in_order(dependencies: dict[str, list[str]]) -> list[str]:
    """Views with those they read before them; names outside aren't listed.  A circle is an error that names its views."""
    out: list[str] = []
    waiting = {v: {d for d in ds if d in dependencies} for v, ds in dependencies.items()}
    while waiting:
        ready = sorted(v for v, ds in waiting.items() if not ds)
        if not ready:
            raise ValueError(", ".join(sorted(waiting)))
        out += ready
        waiting = {v: ds - set(ready) for v, ds in waiting.items() if ds}
    return out


class Views:
    """Views of one store.  They are registered as temporary views of the session, below them what ``tables`` names."""

    def __init__(self, store: Store, tables: list[str]):
        self.store, self.spark, self.tables = store, store.spark, list(tables)

    def _saved(self) -> dict[str, Any]:
        return {r["view_name"]: r for r in self.store.table("views").collect()}

    def register(self) -> list[str]:
        """Make all saved views readable in this session, each after those it reads."""
        saved = self._saved()
        order = in_order({v: r["dependencies"] for v, r in saved.items()})
        for name in order:
            checked_query(self.spark, saved[name]["sql"], explain=False, private=False).createOrReplaceTempView(f"`{name}`")
        return order

    def save(self, sql: str, view_name: str, *, sql_file_path: str | None = None, replace: bool = False) -> dict[str, Any]:
        """Save a query under a name, or say why not; nothing changes then.

        A name that a table has can't be taken, a view's only with ``replace``.
        A view that would read itself, at however many removes, is refused, and
        so is a replacement that a view reading it couldn't be analysed with.
        """
        text, name = sql.strip().rstrip(";").strip(), view_name.strip()
        if not text:
            return _refused("empty_sql", "there is no query", name)
        if not name:
            return _refused("empty_view_name", "there is no name")
        if name.lower().startswith(RESERVED):
            return _refused("reserved_view_name", f"{name} begins with a reserved word", name)
        if not re.fullmatch(NAME, name):
            return _refused("invalid_view_name", "a name is letters and digits, in words joined by hyphens, and begins with a letter", name)
        base, saved = self.store.version(), self._saved()
        if name.lower() in {t.lower() for t in self.tables}:
            return _refused("name_conflict", f"{name} is a table", name)
        same = next((v for v in saved if v.lower() == name.lower()), None)
        if same and not replace:
            return _refused("view_exists", f"{same} is saved already", name)
        name = same or name
        order: list[str] = []
        try:
            reads = referenced_names(self.spark, text, sorted({*self.tables, *saved, name}))
            graph = {v: r["dependencies"] for v, r in saved.items()} | {name: reads}
            order = in_order(graph)
            for v in order:
                query = text if v == name else saved[v]["sql"]
                checked_query(self.spark, query, explain=False, private=False).createOrReplaceTempView(f"`{v}`")
            columns = self.spark.table(f"`{name}`").columns
        except NotReadOnly as e:
            return self._back(_refused("disallowed_sql", str(e), name), order, saved)
        except ValueError as e:
            return _refused("circular_view", f"these would read themselves: {e}", name)
        except (AnalysisException, ParseException) as e:
            return self._back(_refused("sql_execution_error", str(e).splitlines()[0], name), order, saved)
        digest = hashlib.sha256(text.encode()).hexdigest()
        row = self.spark.createDataFrame([(name, text, digest, sql_file_path, reads)], self.store.table("views").schema)
        views = self.store.table("views", base).where(F.col("view_name") != name).unionByName(row)
        edges = self.store.table("edges", base)
        old = (F.col("from_kind") == "artifact") & (F.col("from_id") == name) & (F.col("relation") == "depends_on") | (F.col("relation") == "defines") & (F.col("to_id") == name)
        fresh = [("artifact", name, "depends_on", "artifact", d) for d in reads] + ([("file", sql_file_path, "defines", "artifact", name)] if sql_file_path else [])
        files = self.store.table("files", base)
        changed = {"views": views, "edges": edges.where(~old).unionByName(self.spark.createDataFrame(fresh, edges.schema))}
        if sql_file_path:
            changed["files"] = files.where(F.col("path") != sql_file_path).unionByName(self.spark.createDataFrame([(sql_file_path, "sql")], files.schema))
        self.store.publish(base, **changed)
        return {"status": "ok", "view_name": name, "columns": columns, "dependencies": reads, "sql_hash": digest}

    def _back(self, answer: dict[str, Any], order: list[str], saved: dict[str, Any]) -> dict[str, Any]:
        """The session's views as they were before a refused change."""
        for v in order:
            if v in saved:
                checked_query(self.spark, saved[v]["sql"], explain=False, private=False).createOrReplaceTempView(f"`{v}`")
            else:
                self.spark.catalog.dropTempView(v)
        return answer

    def edges(self) -> DataFrame:
        """``child, parent`` of all views and what they read."""
        return self.store.table("views").select(F.col("view_name").alias("child"), F.explode("dependencies").alias("parent"))
