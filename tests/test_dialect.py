"""Patterns, JSON trees, frames without peers, matches in a line, neighbours of vectors."""

from __future__ import annotations

import json
import re
import sqlite3
import time

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetweave.functions import cells
from sheetweave.operators import frames, json_walk, search

TEXTS = ["", "a", "ab", "abc", "a.c", "a*c", "a[c", "a]c", "a^c", "a-c", "axc\n", "AbC", "a\\c", "é", "aéc", "a?c", "a&&c", "a~c", "[x]", "a\nc"]
PATTERNS = ["", "*", "a*", "a?c", "a[b]c", "a[^b]c", "a[a-c]c", "a[*]c", "a[]]c", "a[^]]c", "a[[]c", "a[?.]c", "a[&~]c", "a[\\]c", "*c", "?", "a.c", "a(c", "a[b", "[[]x]", "*\n*", "a[-x]c", "é*", "*[é]*", "a[&&b]c"]


def test_glob_is_that_of_sqlite(spark):
    con = sqlite3.connect(":memory:")
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    for p in PATTERNS:
        got = {r[0]: r[1] for r in df.select("t", cells.glob(F.col("t"), p)).collect()}
        assert got.pop(None) is None
        assert got == {t: bool(con.execute("select ? glob ?", [t, p]).fetchone()[0]) for t in TEXTS}, p


def walk(value, full="$", key=None, parent=None, depth=0):
    kind = "null" if value is None else str(value).lower() if isinstance(value, bool) else {dict: "object", list: "array", int: "integer", float: "real", str: "text"}[type(value)]
    yield full, key, parent, depth, kind
    inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in inner:
        step = f"[{k}]" if isinstance(value, list) else f".{k}" if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", k) else f'."{k}"'
        yield from walk(v, full + step, str(k), full, depth + 1)


def test_json_trees(spark):
    texts = ['{"a":{"b":[1,2.5,{"c":null}],"x y":true},"":false}', "[]", "{}", "[[[[1]]]]", "3", '"t"', "null", "not json", None, '{"a":[{"k":1},{"k":"é"}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, j string").withColumn("depth", F.lit("clash"))
    got = {(r["i"], r["fullkey"], r["key"], r["parent"], r["depth"], r["type"]) for r in json_walk.json_tree(df, ["i"], "j").collect()}
    assert got == {(i, *row) for i, t in enumerate(texts) if t not in (None, "not json") for row in walk(json.loads(t))}
    atoms = {(r["i"], r["fullkey"]): r["atom"] for r in json_walk.json_tree(df, ["i"], "j").where("atom is not null").collect()}
    assert atoms[0, "$.a.b[1]"] == "2.5" and atoms[9, "$.a[1].k"] == "é" and atoms[0, '$.a."x y"'] == "true" and (0, "$.a.b[2].c") not in atoms
    each = {(r["i"], r["fullkey"]) for r in json_walk.json_each(df, ["i"], "j").collect()}
    assert each == {(0, "$.a"), (0, '$.""'), (3, "$[0]"), (4, "$"), (5, "$"), (6, "$"), (9, "$.a")}
    assert json_walk.json_tree(df.where("false"), ["i"], "j").collect() == []


@pytest.mark.parametrize("exclude", ["current row", "group", "ties"])
def test_frames_without_peers(spark, exclude):
    con = sqlite3.connect(":memory:")
    rows = [(i, "ab"[i % 2], i * 7 % 5, None if i % 6 == 0 else i) for i in range(30)] + [(99, "z", 1, None), (100, "y", 1, 4)]
    con.execute("create table t (i, g, o, v)")
    con.executemany("insert into t values (?, ?, ?, ?)", rows)
    want = con.execute(f"select i, sum(v) over w, count(v) over w from t window w as (partition by g order by o range between 1 preceding and 2 following exclude {exclude})").fetchall()
    df = spark.createDataFrame(rows, "i int, g string, o int, v int")
    total, n = frames.sum_and_count(F.col("v"), W.partitionBy("g").orderBy("o").rangeBetween(-1, 2), W.partitionBy("g", "o"), exclude)
    assert sorted(tuple(r) for r in df.select("i", total, n).collect()) == sorted(want)


def test_matches_in_a_line(spark):
    lines = ["", None, "none", "an", "banana Ananas", "x" * 70 + "an" * 200 + "tail an"]
    got = {r[0]: [(m["start"], m["end"], m["match"]) for m in r[1]] if r[1] is not None else None for r in spark.createDataFrame([(x,) for x in lines], "t string").select("t", search.submatches(F.col("t"), "an")).collect()}
    assert got == {x: None if x is None else [(m.start(), m.end(), m[0]) for m in re.finditer("(?i)an", x)] for x in lines}


def test_many_matches_take_time_in_proportion(spark):
    def seconds(n):
        df = spark.createDataFrame([("an " * n,)], "t string").select(F.size(search.submatches(F.col("t"), "an")).alias("n"), F.element_at(search.submatches(F.col("t"), "an"), -1)["start"].alias("s"))
        began = time.perf_counter()
        assert tuple(df.first()) == (n, 3 * n - 3)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(64_000) < 30


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 9000])
def test_running_sums(spark, n):
    df = spark.range(1).select(F.transform(F.slice(F.sequence(F.lit(1), F.lit(max(1, n))), 1, F.lit(n)), lambda x: x % 7).alias("v"))
    want, at = [], 0
    for i in range(1, n + 1):
        at += i % 7
        want.append(at)
    assert df.select(search.running(F.col("v"))).first()[0] == want


def test_vectors_without_a_direction(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0])], "id long, v array<double>")
    assert {(r["query_id"], r["id"]) for r in search.nearest(v, v, 2).collect()} == {(1, 2), (2, 1)}
    assert search.nearest(v.where("id > 2"), v, 2).collect() == [] and search.nearest(v, v.where("false"), 2).collect() == []
