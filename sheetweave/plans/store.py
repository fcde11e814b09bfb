"""A catalog of tables in a folder, changed by whole versions.

A change writes new snapshots of the tables it touches and then claims the next
version number with a file that must not exist yet.  Readers follow the last
claimed version, so a change is seen as a whole or not at all, and one that ends
midway leaves files that nobody reads.  Catalog tables describe tables; the rows
of content lie beside them, by load and fingerprint.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

# The catalog's tables.
SCHEMAS = {
    "contents": "fingerprint string, table_name string, source_format string, row_count long, columns array<string>, db_columns array<string>, folder string",
    "sources": "source_path string, source_format string, source_sheet_name string, source_table_name string, fingerprint string, source_metadata_json string",
    "edges": "from_kind string, from_id string, relation string, to_kind string, to_id string",
    "files": "path string, kind string",
    "views": "view_name string, sql string, sql_hash string, sql_file_path string, dependencies array<string>",
}


class Conflict(RuntimeError):
    """Another change was published first."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._of = jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[int]:
        folder = self._of(f"{self.path}/_commits")
        if not self._fs.exists(folder):
            return []
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(folder) if x.getPath().getName().isdigit())

    def version(self) -> int:
        return max(self._commits(), default=0)

    def _held(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/_commits/{version}", wholetext=True).first()[0])

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A catalog table as of a version, the last one if none is named."""
        folder = self._held(self.version() if version is None else version).get(name)
        if folder is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{folder}")

    def publish(self, base: int, **tables: DataFrame) -> int:
        """Make ``tables`` the catalog's, all at once; the others stay as in version ``base``, which must still be the last."""
        held = self._held(base)
        for name, df in tables.items():
            folder = f"catalog/{uuid.uuid4().hex}"
            df.select(*(c.split()[0] for c in SCHEMAS[name].split(", "))).write.parquet(f"{self.path}/{folder}")
            held[name] = folder
        self._fs.mkdirs(self._of(f"{self.path}/_commits"))
        draft = self._of(f"{self.path}/_drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(held), "utf-8"))
        out.close()
        target = self._of(f"{self.path}/_commits/{base + 1}")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise Conflict(f"version {base + 1} is already there")
        return base + 1
