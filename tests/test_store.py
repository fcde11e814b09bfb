"""The catalog store: loading with names, replacement by manifests, saved views."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sheetweave.operators import catalog, describe, loading
from sheetweave.plans.store import Conflict, Store
from sheetweave.plans.views import Views, in_order

TABLES = "source_path string, source_sheet_name string, source_table_name string, source_format string, columns array<string>, row_count string"
ROWS = "source_path string, source_sheet_name string, source_table_name string, row_id long, cells array<string>, columns string"


def one_by_one(bases: list[str], used: set[str]) -> list[str]:
    used, out = set(used), []
    for base in bases:
        k = 1
        while (name := base if k == 1 else f"{base}_{k}") in used or f"{name}_typed" in used:
            k += 1
        out.append(name)
        used |= {name, f"{name}_typed"}
    return out


@pytest.mark.parametrize("seed", range(5))
def test_names_are_those_of_one_by_one(spark, seed):
    """Gaps, typed views' names, bases that look like other bases' names, and a base that ends in _typed."""
    r = random.Random(seed)
    bases = [r.choice(["a", "a", "a", "b", "a_2", "a_3", "a_typed", "a_2_typed", "a_1", "a_02", "c_10"]) for _ in range(25)]
    used = set(r.sample(["a", "a_2", "a_4", "a_5_typed", "b_typed", "b_2", "a_2_2", "c_10_3", "a_typed_2", "z"], 5))
    wanted = spark.createDataFrame(list(enumerate(bases)), "place long, base string")
    got = loading.allocated_names(wanted, spark.createDataFrame([(u,) for u in used], "name string")).collect()
    assert [x["name"] for x in sorted(got, key=lambda x: x["place"])] == one_by_one(bases, used)


def test_stems(spark):
    paths = ["/a/Sales 2024.CSV", "Über (1).xlsx", "x/.csv", "noext", "a..b.txt", "C:\\in\\Q1-final.csv", "--.csv", "dir/"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(loading.source_stem(F.col("p"))).collect()
    assert [x[0] for x in got] == ["sales_2024", "ber_(1)", "csv", "noext", "a_b", "c_in_q1_final", "source", "dir"]


def tables(spark, *given):
    """Tables of (path, sheet, name, columns, rows)."""
    t = spark.createDataFrame([(p, s, n, "csv", c, "x") for p, s, n, c, _ in given], TABLES)
    return t, spark.createDataFrame([(p, s, n, i, cells, "x") for p, s, n, _, rows in given for i, cells in enumerate(rows)], ROWS).repartition(3)


def loaded(store, *given):
    return {(x["source_path"], x["source_table_name"]): (x["table_name"], x["load_status"], x["row_count"]) for x in loading.load_tables(store, *tables(store.spark, *given)).collect()}


def test_load_and_reload(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    given = [
        ("in/Data.csv", "", "one", ["n", "", "n"], [["1,000", "a"], ["2", None, "2024-1-5"]]),
        ("in/data.csv", None, "two", ["n", "", "n"], [["1,000", "a"], ["2", None, "2024-1-5"]]),  # equal content
        ("up/data.csv", "s", "three", ["n", "", "n"], [["2", None, "2024-1-5"], ["1,000", "a"]]),  # another order
        ("up/data.csv", "s", "none", ["n"], []),
    ]
    first = loaded(store, *given)
    assert first == {("in/Data.csv", "one"): ("data", "loaded", 2), ("in/data.csv", "two"): ("data", "reused", 2), ("up/data.csv", "none"): ("data_2", "loaded", 0), ("up/data.csv", "three"): ("data_3", "loaded", 2)}
    assert [tuple(r) for r in loading.content_rows(store, "data").orderBy("row_id").drop("row_id").collect()] == [("1,000", "a", ""), ("2", "", "2024-1-5")]
    typed = loading.typed_rows(store, "data")
    assert dict(typed.dtypes)["n"] == "bigint" and sorted(r["n"] for r in typed.collect()) == [2, 1000]
    assert loading.content_rows(store, "data_2").count() == 0
    sizes = {n: store.table(n).count() for n in ("contents", "sources", "edges", "files")}
    assert sizes["contents"] == 3 and sizes["sources"] == 4
    again = loaded(store, *given)
    assert {k: v[0] for k, v in again.items()} == {k: v[0] for k, v in first.items()} and {v[1] for v in again.values()} == {"reused"}
    assert {n: store.table(n).count() for n in sizes} == sizes and store.version() == 2
    assert store.table("contents", 1).count() == 3
    with pytest.raises(ValueError, match="name"):
        loaded(store, ("x.csv", "", " ", ["a"], []))


def test_fingerprints_follow_order_and_cells(spark):
    base = [["a", "b"], ["c", "d"]]
    other = [[["a", "b"], ["c", "d"]], [["c", "d"], ["a", "b"]], [["ab", ""], ["c", "d"]], [["a", "b"]], [["a", "b", ""], ["c", "d"]]]
    t, rows = tables(spark, ("p", "", "base", ["x"], base), *(("p", "", str(i), ["x"], o) for i, o in enumerate(other)), ("p", "", "head", ["y"], base))
    prints = {r["source_table_name"]: r["fingerprint"] for r in loading.content_fingerprints(t, rows).collect()}
    assert prints["base"] == prints["0"] and len(set(prints.values())) == 6


def test_a_change_in_between_is_a_conflict(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    files = spark.createDataFrame([("a", "source")], "path string, kind string")
    store.publish(0, files=files)
    with pytest.raises(Conflict):
        store.publish(0, files=files.where("false"))
    assert store.table("files").count() == 1 and store.table("views").count() == 0


def test_ingest_again_replaces_a_document(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    loaded(store, ("other.csv", "", "kept", ["x"], [["shared"]]))

    def ingest(*given):
        return {x["source_table_name"]: (x["table_name"], x["load_status"]) for x in loading.ingest_manifest(store, "d/a.pdf", "d/a/tables", "d/a/m.json", *tables(spark, *given)).collect()}

    assert ingest(("d/a/tables/t1.csv", "", "t1", ["x"], [["1"]]), ("d/a/tables/t2.csv", "", "t2", ["x"], [["shared"]])) == {"t1": ("t1", "loaded"), "t2": ("other", "reused")}
    assert ingest(("moved/t1.csv", "", "t1", ["x"], [["2"]])) == {"t1": ("t1", "loaded")}
    assert {r["table_name"] for r in store.table("contents").collect()} == {"other", "t1"}
    assert {r["source_path"] for r in store.table("sources").collect()} == {"other.csv", "moved/t1.csv"}
    assert loading.content_rows(store, "t1").first()["x"] == "2"
    assert loading.replace_document(store, "d/a.pdf", "d/a/tables", "d/a/m.json") == {"replaced_source_count": 1, "replaced_table_count": 1}
    assert loading.replace_document(store, "d/a.pdf", "d/a/tables", "d/a/m.json") == {"replaced_source_count": 0, "replaced_table_count": 0}
    left = {(r["from_id"], r["to_id"]) for r in store.table("edges").collect()}
    assert ("other", "other_typed") in left and not any("t1" in a or "t1" in b for a, b in left)


def test_mark_and_sweep_of_edge_rows(spark):
    s = spark.createDataFrame([("d/tables/x", "f1", None), ("d/tablesX", "f1", "no json"), (None, "f2", '{"pdf_source_path": "d.pdf"}'), ("y", "f3", '{"tables_manifest_path": "m"}'), ("z", "f3", None)], "source_path string, fingerprint string, source_metadata_json string")
    c = spark.createDataFrame([("f1", "t1"), ("f2", "t2"), ("f3", "t3"), ("f4", "t4")], "fingerprint string, table_name string")
    e = catalog.source_edges(s.join(c, "fingerprint"))
    f = spark.createDataFrame([("d/tables/x",), ("y",), ("z",), ("d.pdf",)], "path string")
    got = loading.replaced(s, c, e, f, loading.belongs(F.col("source_path"), F.col("source_metadata_json"), "d.pdf", "d/tables/", "m"), "d.pdf")
    assert sorted(r["source_path"] for r in got["sources"].collect()) == ["d/tablesX", "z"]
    assert sorted(r["table_name"] for r in got["contents"].collect()) == ["t1", "t3", "t4"]
    assert [r["path"] for r in got["files"].collect()] == ["z"]
    none = loading.replaced(s.where("false"), c.where("false"), e.where("false"), f.where("false"), F.lit(True), "d.pdf")
    assert all(df.count() == 0 for df in none.values())


def test_manifest_order(spark):
    e = spark.createDataFrame([(1, "3", "a"), (2, None, "b"), (3, "x", "c"), (4, " 1 ", "d"), (5, "3", "e")], "position int, document_order string, name string")
    assert [r["name"] for r in loading.manifest_order(e).orderBy("load_order").collect()] == ["d", "b", "a", "c", "e"]


def test_saved_views(spark, tmp_path):
    spark.range(10).createOrReplaceTempView("numbers")
    store = Store(spark, str(tmp_path / "s"))
    saved = Views(store, ["numbers"])
    assert saved.save("select id from numbers where id > 3;", "big", sql_file_path="q/big.sql") | {"sql_hash": ""} == {"status": "ok", "view_name": "big", "columns": ["id"], "dependencies": ["numbers"], "sql_hash": ""}
    assert saved.save("with b as (select * from big) select id + 1 as more from b", "bigger-still")["dependencies"] == ["big"]
    for sql, name, error in (
        ("", "v", "empty_sql"), (" ; ", "v", "empty_sql"), ("select 1", " ", "empty_view_name"), ("select 1", "1a", "invalid_view_name"), ("select 1", "a_b", "invalid_view_name"), ("select 1", "a--b", "invalid_view_name"), ("select 1", "sqlite_x", "reserved_view_name"),
        ("drop table x", "v", "disallowed_sql"), ("explain select 1", "v", "disallowed_sql"), ("select * from text.`/etc/hostname`", "v", "disallowed_sql"), ("select java_method('x', 'y')", "v", "disallowed_sql"), ("select * from _tabular_sources", "v", "disallowed_sql"),
        ("select 1", "Numbers", "name_conflict"), ("select 1", "big", "view_exists"), ("select nope from numbers", "v", "sql_execution_error"), ("select * from gone", "v", "sql_execution_error"),
    ):
        assert saved.save(sql, name)["error_type"] == error, (sql, name)
    for sql, name, error in (("select * from `bigger-still`", "big", "circular_view"), ("select * from big", "big", "circular_view"), ("select 'x' as other from numbers", "big", "sql_execution_error")):
        assert saved.save(sql, name, replace=True)["error_type"] == error
    assert spark.table("`bigger-still`").count() == 6 and store.version() == 2
    assert saved.save("select id from numbers where id > 7", "BIG", replace=True)["view_name"] == "big"
    assert spark.table("`bigger-still`").count() == 2
    edges = {(r["from_id"], r["relation"], r["to_id"]) for r in store.table("edges").collect()}
    assert edges == {("big", "depends_on", "numbers"), ("bigger-still", "depends_on", "big")}  # the new query of big has no file
    assert {tuple(r) for r in catalog.ancestors(saved.edges()).collect()} == {("big", "numbers"), ("bigger-still", "big"), ("bigger-still", "numbers")}
    spark.catalog.dropTempView("big")
    spark.catalog.dropTempView("bigger-still")
    assert Views(Store(spark, str(tmp_path / "s")), ["numbers"]).register() == ["big", "bigger-still"]
    assert spark.table("`bigger-still`").count() == 2


def test_views_in_order():
    assert in_order({"c": ["a", "b"], "b": ["a", "t"], "a": ["t"]}) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="a, b"):
        in_order({"a": ["b"], "b": ["a"], "c": []})


def test_describe_and_search(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert describe.found(store, "x").collect() == [] and describe.artifacts(store).collect() == []
    loaded(store, ("in/Sales.csv", "", "t", ["city", "n"], [["Oslo", "1"], ["Rome", "2"], ["", "3"]]), ("b/sales.csv", "", "u", ["town"], [["oslo fjord"]]))
    for name in ("sales", "sales_2"):
        loading.typed_rows(store, name).createOrReplaceTempView(f"{name}_typed")
    saved = Views(store, ["sales_typed", "sales_2_typed"])
    assert saved.save("select city from sales_2_typed where n > 1", "big-towns", sql_file_path="q/big.sql")["status"] == "ok"
    got = describe.described(store, "sales_2")
    assert (got["kind"], got["row_count"], got["columns"][0], got["source_paths"]) == ("raw_content_table", 3, {"name": "city", "type": "string"}, ["in/Sales.csv"])
    assert got["sample_rows"][:2] == [{"city": "Oslo", "n": "1"}, {"city": "Rome", "n": "2"}] and got["value_hints"]["city"] == ["Oslo", "Rome"]
    typed = describe.described(store, "sales_2_typed", sample_rows=1)
    assert typed["columns"] == [{"name": "city", "type": "string"}, {"name": "n", "type": "bigint"}] and len(typed["sample_rows"]) == 1
    view = describe.described(store, "big-towns")
    assert (view["kind"], view["row_count"], view["source_paths"]) == ("view_or_table", 2, ["in/Sales.csv"])
    assert {r["relation"] for r in view["relations"]} >= {"depends_on", "defines"} and {"path": "q/big.sql", "kind": "sql"} in view["files"]
    assert describe.described(store, "nope")["error_type"] == "missing_sql_artifact"
    files = spark.createDataFrame([("q/big.sql", "sql_file", ["sales_2_typed"], "select city\n-- Oslo first"), ("out/x.txt", "output_file", [], "no town\noslo")], "path string, type string, refs array<string>, text string")
    hits = [(r["type"], r["id"], r["line"], r["field"], r["rank"]) for r in describe.found(store, "oslo", files=files).collect()]
    assert hits == [("sqlite_table", "sales", 1, "town", 43), ("sqlite_table", "sales_2", 1, "city", 43), ("sql_file", "q/big.sql", 2, "line", 35), ("output_file", "out/x.txt", 2, "line", 35)]
    assert [r["id"] for r in describe.found(store, "Oslo", files=files).collect()] == ["sales_2", "q/big.sql"]
    assert [(r["id"], r["field"]) for r in describe.found(store, "city", scope="metadata", most=2).collect()] == [("sales_2_typed", "column"), ("sales_2", "column")]
    assert [r["id"] for r in describe.found(store, "^os.o$", regex=True, files=files).collect()] == ["sales_2", "out/x.txt"]
    assert [r["id"] for r in describe.found(store, "oslo", artifact="sales_2_typed", files=files).collect()] == ["q/big.sql"]
    for bad in (" ", "x"):
        with pytest.raises(ValueError):
            describe.found(store, bad, scope="no")
