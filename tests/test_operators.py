from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetweave.functions import cells
from sheetweave.operators import catalog, layout, reshape, search, typing
from sheetweave.plans.guard import NotReadOnly, check_read_only, referenced_names, result_names, run_query
from sheetweave.sources import grid


@pytest.mark.parametrize(
    ("values", "kind"),
    [
        (["1,234", "1,2,3", "00123", "+5", ""], "INTEGER"),
        (["1.5", "2"], "REAL"),
        ([".5"], "TEXT"),
        (["5."], "TEXT"),
        (["1e5"], "TEXT"),
        (["$3"], "TEXT"),
        (["12%"], "TEXT"),
        (["12345678901234567890"], "TEXT"),
        (["2024-01-05", "2024/1/5"], "DATE"),
        (["2024-01-05 10:00", "2024-1-5T09:08:07"], "DATETIME"),
        (["2024-01-05", "2024-01-05 10:00"], "TEXT"),
        (["2024-02-30"], "TEXT"),
        (["", None, " "], "TEXT"),
    ],
)
def test_infer_types(spark, values, kind):
    t = spark.createDataFrame([(v,) for v in values], "c string")
    assert [tuple(r) for r in typing.infer_types(t).collect()] == [("c", kind)]


def test_typed_values(spark):
    t = spark.createDataFrame([("1,234", " x ", "2024/1/5"), ("", None, "")], "a string, b string, c string")
    got = typing.typed_view(t).collect()
    assert got[0]["a"] == 1234 and got[0]["b"] == "x" and str(got[0]["c"]) == "2024-01-05"
    assert list(got[1]) == [None, None, None]


def test_unique_names():
    assert typing.unique_names(["a", "a", "a_2", "A", ""]) == ["a", "a_2", "a_2_2", "A_3", "column_5"]


def test_fingerprints_follow_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "k int, v string")
    c = spark.createDataFrame([(1, "y"), (2, "x")], "k int, v string")
    one = [typing.table_fingerprint(t, ["k"]).first()[0] for t in (a, b, c)]
    assert one[0] == one[1] != one[2]
    tree = [typing.tree_fingerprint(t).first()[0] for t in (a, b, c)]
    assert tree[0] == tree[1] != tree[2]


def test_csv_grid_keeps_ragged_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(("name;price\nä;1\n\nb;2;extra\n" + "c;3\n" * 20).encode("cp1252"))
    rows = grid.read_csv_grids(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [list(r["cells"]) for r in rows] == [["name", "price"], ["ä", "1"], [], ["b", "2", "extra"], *[["c", "3"]] * 20]


def test_encoding_isnt_misled_by_a_cut_character():
    head = ("a" * (grid.HEAD_BYTES - 1) + "é").encode()[: grid.HEAD_BYTES]
    assert grid.encoding_of(head) == "utf-8-sig"


def test_regions():
    rows = [["", "", "", "", ""], ["a", "b", "", "x", "y"], ["1", "2", "", "3", "4"], ["", "", "", "5", "6"], ["", "", "", "", ""], ["z", "", "", "", ""]]
    assert layout.boxes(layout.occupancy(rows)) == [(1, 2, 0, 1), (1, 3, 3, 4), (5, 5, 0, 0)]


def test_occupancy_closes_gaps_and_fills_holes():
    rows = [["a"], ["b"], [""], ["c"], [""], [""], ["d"]]
    assert layout.occupancy(rows)[:, 0].astype(int).tolist() == [0, 1, 1, 1, 0, 0, 1]
    ring = [["", "", ""], ["a", "a", "a"], ["a", "", "a"], ["a", "", "a"], ["a", "a", "a"]]
    assert layout.occupancy(ring)[1:].all()
    assert layout.boxes(np.zeros((0, 0), bool)) == []


@pytest.mark.parametrize("sql", ["select 1", "-- note\nselect(1)", "with t as (select 1 as a) select * from t;", "explain select 1"])
def test_guard_lets_queries_pass(spark, sql):
    check_read_only(spark, sql)


@pytest.mark.parametrize("sql", ["drop table x", "create table t as select 1", "insert into t values (1)", "with a as (select 1) insert into t select * from a", "select 1; select 2", "set a=1", ""])
def test_guard_rejects_the_rest(spark, sql):
    with pytest.raises(NotReadOnly):
        check_read_only(spark, sql)


def test_run_query_is_bounded(spark):
    got = run_query(spark, "select id, id from range(5) order by 1", 3)
    assert got["truncated"] and got["row_count"] == 3 and got["columns"] == ["id", "id__2"]
    assert not run_query(spark, "select 1 as a", 1)["truncated"]
    assert run_query(spark, "select nope from range(1)")["status"] == "error"


def test_smart_case(spark):
    t = spark.createDataFrame([("Alpha",), ("alpha",)], "s string")
    assert t.where(search.matches(F.col("s"), "alpha")).count() == 2
    assert t.where(search.matches(F.col("s"), "Alpha")).count() == 1
    assert t.where(search.matches(F.col("s"), "^al", regex=True)).count() == 2


def test_clean_cell(spark):
    got = spark.createDataFrame([("a  b- c \n d",)], "s string").select(cells.clean_cell(F.col("s"))).first()[0]
    assert got == "a b-c d"


@pytest.mark.parametrize(
    "sql",
    [
        "execute immediate 'create table x (a int)'", "begin drop table t; end", "call p()", "analyze table t compute statistics", "msck repair table t", "comment on table t is 'x'", "uncache table t", "show tables", "set a = 1", "use x", "refresh table t", "describe t",
        "select java_method('java.lang.System', 'exit', 0)", "select reflect('java.lang.System', 'exit', 0)", "select 1 + length(try_reflect('java.lang.System', 'x'))", "select * from a where exists (select reflect('x', 'y') from b)", "with t as (select java_method('x', 'y')) select * from t",
        "select * from (select transform(a) using 'cat' as (b) from t)", "explain drop table t", "insert into t select 1", "create table t as select 1", "with a as (select 1) insert into t select * from a", "select 1; select 2", "", "truncate table t", "cache table t",
        "select * from text.`/etc/hostname`", "select * from csv.`/etc`", "select * from a join parquet.`s3://b/c` using (k)", "select (select count(*) from binaryFile.`/etc/hostname`)", "with t as (select * from json.`/x`) select * from t", "select * from spark_catalog.text.`/etc/hostname`",
        "select identifier('java_method')('java.lang.System', 'getProperty', 'user.home')", "select * from identifier('text.`/etc/hostname`')", "select identifier('a') from t", "select 1 where exists (select identifier('reflect')('x', 'y'))",
        "select sum(a) over w from t window w as (partition by java_method('java.lang.System', 'getProperty', 'user.home'))", "select sum(a) over w from t window w as (order by (select reflect('x', 'y')))", "with q as (select sum(a) over w from t window w as (order by try_reflect('x', 'y'))) select * from q",
        "values (1)", "table t", "from t select a", "(select 1)", "-- only a comment", "select * from t lateral view explode(array(java_method('x', 'y'))) e as v", "select transform(array(1), x -> reflect('x', 'y'))", "select * from range(length(java_method('x', 'y')))",
    ],
)
def test_guard_refuses(spark, sql):
    with pytest.raises(NotReadOnly):
        check_read_only(spark, sql)


@pytest.mark.parametrize(
    "sql",
    [
        "select a, count(*) from t join u using (k) where b in (select c from v) group by a having count(*) > 1 order by a limit 3 offset 1;", "with recursive t(n) as (select 1 union all select n + 1 from t where n < 5) select * from t", "select * from values (1, 2), (3, 4)", "explain select 1", "-- why\n/* so */ select 1", "select `text` from `text`", "with w as (select 1 as identifier) select identifier from w",
        "select row_number() over w from t window w as (partition by a order by b)", "select * from t lateral view explode(x) e as y", "select * from range(3)", "select * from t pivot (sum(a) for b in (1, 2))", "select a from t intersect select b from u except select c from v", "select * from t, lateral (select * from u where u.a = t.a)", "select * from t unpivot (v for k in (a, b))",
    ],
)
def test_guard_allows(spark, sql):
    assert not check_read_only(spark, sql).endswith(";")


def test_analysed_plans_are_checked_too(spark):
    from sheetweave.plans import guard

    assert guard.checked_query(spark, "select 1 as a union all select count(*) over w from range(2) window w as (order by id)").count() == 3
    was = guard.CALLS
    guard.CALLS = set()
    try:
        with pytest.raises(NotReadOnly):
            guard.checked_query(spark, "select java_method('java.lang.Math', 'abs', 1)")
    finally:
        guard.CALLS = was
    spark.range(3).createOrReplaceTempView("_tabular_sources")
    assert run_query(spark, "select * from _tabular_sources")["error_type"] == "not_read_only"
    assert run_query(spark, "select * from _tabular_sources", private=True)["row_count"] == 3
    spark.catalog.dropTempView("_tabular_sources")


def test_guard_of_outside_queries(spark):
    with pytest.raises(NotReadOnly):
        check_read_only(spark, "select * from (select 1) a join _tabular_sources b", private=False)
    with pytest.raises(NotReadOnly):
        check_read_only(spark, "explain select 1", explain=False)
    assert referenced_names(spark, "with c as (select * from A where x in (select y from `b`)) select 'd' from c", ["a", "b", "c2", "d"]) == ["a", "b"]


def test_ancestors_of_long_chains_diamonds_and_cycles(spark):
    chain = [(i, i + 1) for i in range(60)]
    diamonds = [(1000 + 2 * i, 1000 + 2 * i + j) for i in range(40) for j in (1, 2)] + [(1001 + 2 * i, 1002 + 2 * i) for i in range(40)]
    got = {tuple(r) for r in catalog.ancestors(spark.createDataFrame(chain + diamonds + [(900, 901), (901, 900), (None, 5)], "child long, parent long")).collect()}
    assert {x for x in got if x[0] < 100} == {(i, j) for i in range(61) for j in range(i + 1, 61)}
    assert {x for x in got if 900 <= x[0] < 1000} == {(900, 901), (901, 900), (900, 900), (901, 901)}
    assert (1000, 1080) in got and len({x for x in got if x[0] == 1000}) == 80


def test_regions_follow_plain_flooding():
    r = np.random.default_rng(3)
    for _ in range(30):
        mask = r.random((r.integers(1, 14), r.integers(1, 14))) < 0.55
        seen, want = np.zeros_like(mask), []
        for start in zip(*np.nonzero(mask), strict=True):
            todo, cells_ = [start], []
            while todo:
                i, j = todo.pop()
                if 0 <= i < mask.shape[0] and 0 <= j < mask.shape[1] and mask[i, j] and not seen[i, j]:
                    seen[i, j] = True
                    cells_.append((i, j))
                    todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
            if cells_:
                a, b = zip(*cells_, strict=True)
                want.append((min(a), max(a), min(b), max(b)))
        assert layout.boxes(mask) == sorted(want)
        rim, grown = np.pad(~mask, 1, constant_values=True), None
        outside = np.zeros_like(rim)
        outside[0, 0] = True
        while grown is None or (grown != outside).any():
            grown = outside.copy()
            for a, b in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
                outside[a] |= grown[b] & rim[a]
                outside[:, a] |= grown[:, b] & rim[:, a]
        assert (layout.fill_holes(mask) == ~outside[1:-1, 1:-1]).all()


def test_large_regions_take_time_in_proportion():
    mask = np.zeros((100_000, 8), bool)
    mask[:, 1:6] = True
    assert layout.boxes(layout.fill_holes(mask)) == [(0, 99_999, 1, 5)]


def test_many_bands_are_joined_by_strips(spark, monkeypatch):
    bands = spark.createDataFrame([(i, i * 3.0, i * 3.0 + 5) for i in range(30)], "name int, low double, high double")
    words = spark.createDataFrame([(x / 2,) for x in range(200)], "x double")
    near = {tuple(r) for r in reshape.place_in_bands(words, bands, "x").select("x", "name").collect()}
    monkeypatch.setattr(reshape, "BANDS", 3)
    assert {tuple(r) for r in reshape.place_in_bands(words, bands, "x", 4.0).select("x", "name").collect()} == near
