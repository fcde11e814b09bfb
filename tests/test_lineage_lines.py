"""Lineage, paths, wrapped rows, indents, word geometry and names, against brute force on small made layouts."""

from __future__ import annotations

import random
import re
import time
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sheetweave.operators import inspection, labels, lineage, lines, repair, scan


def catalog(spark, names, sourced, refs):
    a = spark.createDataFrame([(n, "raw_content_table" if n in sourced else "view_or_table") for n in names], "name string, kind string")
    c = spark.createDataFrame([(f"f{n}", n) for n in sourced], "fingerprint string, table_name string")
    s = spark.createDataFrame([(f"f{n}", p, None, None) for n, ps in sourced.items() for p in ps], "fingerprint string, source_path string, source_sheet_name string, source_table_name string")
    return a, c, s, spark.createDataFrame(refs, "child string, parent string")


def test_sources_stop_at_the_first_sourced_artifact(spark):
    """A diamond, a circle, a view over a sourced view, a reference that leads nowhere and an artifact alone."""
    sourced = {"r1": ["a.csv"], "r2": ["b.csv", "b.csv"], "mid": ["m.csv"]}
    refs = [("top", "l"), ("top", "r"), ("l", "r1"), ("r", "r1"), ("r", "r2"), ("x", "y"), ("y", "x"), ("y", "mid"), ("mid", "r1"), ("o", "gone"), ("top", "top")]
    got = lineage.source_mappings(*catalog(spark, ["top", "l", "r", "x", "y", "o", "r1", "r2", "mid"], sourced, refs)).collect()
    found = defaultdict(set)
    for r in got:
        found[r["name"]].add((r["source_path"], r["inherited"]))
    assert found == {"r1": {("a.csv", False)}, "r2": {("b.csv", False)}, "mid": {("m.csv", False)}, "l": {("a.csv", True)}, "r": {("a.csv", True), ("b.csv", True)}, "top": {("a.csv", True), ("b.csv", True)}, "x": {("m.csv", True)}, "y": {("m.csv", True)}}
    assert len(got) == 10


def test_sources_of_random_catalogs(spark):
    r = random.Random(4)
    names = [f"n{i}" for i in range(40)]
    sourced = {n: [f"{r.randrange(9)}.csv"] for n in names if r.random() < 0.3}
    refs = [(a, r.choice(names)) for a in names for _ in range(2)]
    want = set()
    for n in names:
        seen, todo = set(), [n]
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            if at in sourced:
                want |= {(n, p, at != n) for p in sourced[at]}
            else:
                todo += [p for c, p in refs if c == at]
    assert {(x["name"], x["source_path"], x["inherited"]) for x in lineage.source_mappings(*catalog(spark, names, sourced, refs)).collect()} == want


def test_content_without_a_source_is_an_error(spark):
    with pytest.raises(lineage.CatalogError, match="r1"):
        lineage.source_mappings(*catalog(spark, ["r1"], {"r1": [" "]}, []))
    a, c, s, e = catalog(spark, [], {}, [])
    assert lineage.source_mappings(a, c, s, e).collect() == []


def reason(a: str, b: str) -> str | None:
    x, y = a.strip().replace("\\", "/"), b.strip().replace("\\", "/")
    if not x or not y:
        return None
    if a.strip() == b.strip():
        return "exact"
    if x.endswith(y) or y.endswith(x):
        return "suffix"
    return "filename" if x.rstrip("/").rpartition("/")[2] == y.rstrip("/").rpartition("/")[2] else None


PATHS = ["/d/in/a.csv", "in/a.csv", "a.csv", "xa.csv", "n/a.csv", "C:\\in\\a.csv", " in/a.csv ", "", " ", "b.csv", "/q/b.csv/", "b.csv/", "v", "sv", "é.csv", "/d/é.csv", "in\\a.csv", "a.csv/"]


def test_paths_meet_by_an_index(spark):
    a = spark.createDataFrame([(p,) for p in [*PATHS, None, "a.csv"]], "source_path string")
    b = spark.createDataFrame([(p,) for p in [*PATHS, None]], "asked_path string")
    got = lineage.matching_paths(a, b)
    assert {tuple(r) for r in got.collect()} == {(x, y, reason(x, y)) for x in PATHS for y in PATHS if reason(x, y)}
    assert got.count() == len({tuple(r) for r in got.collect()})
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_artifacts_of_a_path(spark):
    m = spark.createDataFrame([("t", "/d/in/a.csv"), ("t", "/e/a.csv"), ("u", "/e/a.csv"), ("w", "b.csv")], "name string, source_path string")
    got = lineage.artifacts_of(m, spark.createDataFrame([("in/a.csv",), ("/e/a.csv",)], "asked_path string")).collect()
    assert {tuple(r) for r in got} == {("in/a.csv", "t", "/d/in/a.csv", "suffix"), ("in/a.csv", "u", "/e/a.csv", "filename"), ("/e/a.csv", "t", "/e/a.csv", "exact"), ("/e/a.csv", "u", "/e/a.csv", "exact")}


# Wrapped rows


def cleaned(v):
    t = " ".join((v or "").split())
    for a, b in ((r"(?<=\w)-\s+(?=\w)", "-"), (r"(?<=\w)\.\s+(?=<\w)", "."), (r"\(\s+", "("), (r"\s+\)", ")"), (r"\s+([,.;:])", r"\1")):
        t = re.sub(a, b, t)
    return t


def joined(parts):
    out = ""
    for p in parts:
        a, b = ("".join(c.lower() for c in v if c.isalnum()) for v in (out, p))
        if not p or (out and b and (b in a or a in b)):
            continue
        out = p if not out else out + p.lstrip() if out.endswith("-") else f"{out} {p}"
    return out


def wrapped(rows):
    out = []
    for at, cells in rows:
        c = [cleaned(v) for v in cells or []]
        if not any(c):
            continue
        if out and not c[0]:
            out[-1][1].append(c)
        else:
            out.append((at, [c]))
    return [(at, [joined([p[i] if i < len(p) else "" for p in parts]) for i in range(max(map(len, parts)))], len(parts) - 1) for at, parts in out]


def test_wrapped_rows(spark):
    """Overlaps of all lengths, parts within parts, hyphens, marks only, rows of any width, and rows without text."""
    word = "abcdefgh"
    tables = [[(0, ["k", word]), *((i, ["", word[-i:] + word[:k]]) for i in range(1, 9) for k in (i,))]]
    tables += [[(0, ["k", word[:i]]), (1, [None, word]), (2, ["", word[i:], "more"])] for i in range(9)]
    tables += [[(0, ["", "first"]), (1, ["", "second"]), (2, ["  ", None]), (3, None), (4, []), (5, ["z"])], [(0, ["a", "--"]), (1, ["", "x"]), (2, ["", "..."]), (3, ["", "pre-"]), (4, ["", " fix"]), (5, ["", "É é", "( b )", "c , d"])]]
    r = random.Random(2)
    tables += [[(i, [r.choice(["", "", "k"]), *(" ".join(r.choices(["ab", "b-", "B c", "-", "abc", "é"], k=r.randrange(3))) for _ in range(r.randrange(4)))]) for i in range(40)] for _ in range(6)]
    rows = [(t, i, c, "x") for t, own in enumerate(tables) for i, c in own]
    got = inspection.merged_rows(spark.createDataFrame(rows, "t int, i int, c array<string>, cells string").drop("cells").repartition(3), ["t"], "i", "c").collect()
    found = defaultdict(list)
    for x in sorted(got, key=lambda x: (x["t"], x["i"])):
        found[x["t"]].append((x["i"], x["cells"], x["merged"]))
    assert {t: found[t] for t in range(len(tables))} == {t: wrapped(own) for t, own in enumerate(tables)}


# Scans


@pytest.mark.parametrize("width", [1, 3, 4096])
def test_running_values(spark, width):
    r = random.Random(width)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, r.randrange(9)])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(3)
    df = scan.running_sum(df, ["k"], "i", F.col("v"), "s", width)
    df = scan.running_last(df, ["k"], "i", F.col("v"), "before", width)
    got = {x["i"]: (x["s"], x["before"], x["after"]) for x in scan.running_last(df, ["k"], "i", F.col("v"), "after", width, later=True).collect()}
    for k, i, _ in rows:
        own = [(j, v) for q, j, v in rows if q == k and v is not None]
        want = sum(v for j, v in own if j <= i), next((v for j, v in reversed(own) if j <= i), None), next((v for j, v in own if j > i), None)
        assert got[i] == want


# Indented labels


@pytest.mark.parametrize("seed", range(40))
def test_strips_are_functions_of_the_state_before(seed):
    r = random.Random(seed)
    x = [round(r.uniform(0, 30), 1) for _ in range(r.randrange(1, 40))]
    told = labels.summed_up(x)

    def run(state):
        for v in x:
            if state == state and v < state - labels.SLACK:
                state = labels.NONE
            elif state != state or v <= state + labels.SLACK:
                state = v
        return state

    for p in [labels.NONE, -9.0, 99.0, *(v + d for v in x for d in (-3.1, -3.0, -2.9, 0.0, 2.9, 3.0, 3.1))]:
        assert repr(labels.applied(p, *told)) == repr(run(p))


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_indent_roles(spark, width):
    """Equal results for strips of any length; blank labels and missing indents are passed over."""
    r = random.Random(9)
    rows = [(k, i, r.choice(["", None, "a", "b", " c "]), r.choice([None, float("nan"), *(round(r.uniform(0, 20), 1) for _ in range(9))])) for k in ("x", None) for i in range(150)]
    got = labels.indent_roles(spark.createDataFrame(rows, "k string, i int, label string, x double").repartition(4), ["k"], "i", "label", "x", width)
    found = sorted(((x["k"] or "", x["i"], x["label"], x["role"]) for x in got.collect()))
    want = []
    for k in ("x", None):
        own = [(i, t.strip(), x) for q, i, t, x in rows if q == k and (t or "").strip() and x is not None and x == x]
        want += [(k or "", i, t, role) for (i, t, _), role in zip(own, labels.walked([x for _, _, x in own], labels.NONE), strict=True)]
    assert found == sorted(want)
    assert labels.indent_labels(spark.createDataFrame([], "k string, i int, label string, x double"), ["k"], "i", "label", "x").collect() == []


def test_indent_roles_of_sparse_groups(spark):
    """Rows far apart in the order cost no call of their own, and an order needn't be a number."""
    rows = spark.range(60_000).select((F.col("id") % 3000).alias("k"), (F.col("id") * 10_007).alias("i"), F.lit("a").alias("label"), (F.col("id") * 7919 % 31).cast("double").alias("x"))
    began = time.perf_counter()
    got = labels.indent_roles(rows, ["k"], "i", "label", "x").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "role"))).alias("r")).collect()
    assert time.perf_counter() - began < 40
    assert all([x["role"] for x in g["r"]] == labels.walked([float((x["i"] // 10_007) * 7919 % 31) for x in g["r"]], labels.NONE) for g in got) and len(got) == 3000
    named = labels.indent_roles(spark.createDataFrame([("k", n, "a", x) for n, x in [("a", 0.0), ("b", 9.0), ("c", -9.0)]], "k string, i string, label string, x double"), ["k"], "i", "label", "x", 1)
    assert sorted((r["i"], r["role"]) for r in named.collect()) == [("a", "parent"), ("b", "child"), ("c", "footer")]


# Words


def greedy(words, tolerance, most_rows, most_words):
    rows = []
    for w in sorted(words, key=lambda w: (round(w[2] / tolerance), w[1], w[0])):
        if not rows or abs(w[2] - rows[-1][0][2]) > tolerance:
            rows.append([])
        rows[-1].append(w)
    out = []
    for n, own in enumerate(rows[:most_rows], 1):
        kept = sorted(own[:most_words], key=lambda w: round(w[1], 1))
        out.append((n, *(round(v, 1) for v in (own[0][2], min(w[1] for w in own), min(w[2] for w in own), max(w[3] for w in own), max(w[4] for w in own))), " ".join(w[5] for w in kept), len(own) > most_words, len(rows), len(rows) > most_rows))
    return out


@pytest.mark.parametrize("step", [0.5, 2.0, 9.0])
def test_visual_rows(spark, step):
    """Dense pages without a clear gap, sparse ones, equal places, bounds of rows and words, and words without a place."""
    r = random.Random(int(step * 10))
    pages = {p: [(i, float(r.randrange(40)), r.randrange(60) * step / 2, 50.0, 700.0 + r.randrange(3), f"w{i}") for i in range(r.choice([1, 30, 150]))] for p in range(6)}
    rows = [(p, *w, "v") for p, own in pages.items() for w in own] + [(0, 900, None, 1.0, 1.0, 1.0, "no", "v"), (1, 901, float("nan"), 1.0, 1.0, 1.0, "no", "v")]
    df = spark.createDataFrame(rows, "page int, word int, x0 double, y0 double, x1 double, y1 double, text string, row_count string").repartition(3)
    got = lines.visual_rows(df, ["page"], most_rows=12, most_words=5).collect()
    found = defaultdict(list)
    for x in sorted(got, key=lambda x: (x["page"], x["row_id"])):
        found[x["page"]].append(tuple(x)[1:])
    assert {p: found[p] for p in pages} == {p: greedy(own, 3.5, 12, 5) for p, own in pages.items()}


@pytest.mark.parametrize("seed", range(40))
def test_words_are_functions_of_the_row_before(seed):
    r = random.Random(seed)
    y = sorted((r.randrange(80) / 2 for _ in range(r.randrange(1, 40))), key=lambda v: (round(v / 3.5), r.random()))
    told = lines.summed_up(y)
    for p in [float("-inf"), *(v for v in (y[0] + d / 2 for d in range(-30, 8)) if round(v / 3.5) <= round(y[0] / 3.5))]:
        assert lines.applied((p, 4), *told) == lines.stepped(y, (p, 4))[1]


@pytest.mark.parametrize("long", [1, 7, 100, 100_000])
def test_visual_rows_of_long_pages(spark, long):
    """Equal results however long a page may be to be walked at once; a page is shuffled once if it is short, and its rows with it."""
    r = random.Random(long)
    pages = {p: [(i, float(r.randrange(40)), r.randrange(600) * 0.25 * (1 + p), 50.0, 700.0 + r.randrange(3), f"w{i}") for i in range(n)] for p, n in enumerate((1, 30, 150, 900))}
    df = spark.createDataFrame([(p, *w) for p, own in pages.items() for w in own], "page int, word int, x0 double, y0 double, x1 double, y1 double, text string").repartition(3)
    found = defaultdict(list)
    got = lines.visual_rows(df, ["page"], most_rows=12, most_words=5, long=long)
    for x in sorted(got.collect(), key=lambda x: (x["page"], x["row_id"])):
        found[x["page"]].append(tuple(x)[1:])
    assert dict(found) == {p: greedy(own, 3.5, 12, 5) for p, own in pages.items()}
    if long == 100_000:
        assert got._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2


def test_line_records(spark):
    words = [(1, 0, 0, 0, 5.0, 10.0, "b"), (1, 0, 0, 1, 1.0, 11.0, "a"), (1, 0, 1, 2, 1.0, 5.0, "top"), (1, 1, 0, 3, 0.0, 30.0, "1"), (1, 1, 1, 4, 0.0, 31.0, "skip me"), (1, 2, 0, 5, 0.0, 32.0, "Page 9"), (1, 3, 0, 6, 0.0, 40.0, "STOP here"), (1, 4, 0, 7, 0.0, 41.0, "after"), (2, 0, 0, 0, 0.0, 1.0, " "), (2, 0, 1, 1, 0.0, 2.0, "1"), (2, 0, 2, 2, 0.0, 3.0, "STOPPED")]
    df = spark.createDataFrame(words, "page int, block int, line int, word int, x0 double, y0 double, text string")
    got = lines.line_records(df, [], "page", skip_lines=("skip me",), skip_prefixes=("Page",), stop_prefixes=("STOP",)).collect()
    assert sorted(tuple(r) for r in got) == [(1, "a b", 1.0, 10.0, 2), (1, "top", 1.0, 5.0, 1), (2, "1", 0.0, 2.0, 1)]
    assert lines.line_records(df, [], "page").count() == 8


# Names


def alike(a: str, b: str) -> float:
    x, y = (re.sub("[^a-z0-9]+", "", v.lower()) for v in (a, b))
    if not x or not y:
        return 0.0
    if x == y:
        return 100.0
    own, other = (set(re.findall("[a-z0-9]+", v.lower())) for v in (a, b))
    return (40.0 if x in y or y in x else 0.0) + 20.0 * len(own & other) + (20.0 if own & other == own == other else 0.0) + SequenceMatcher(a=x, b=y).ratio() * 20.0


def test_names_are_as_alike_as_the_matcher_says(spark, sf_dir):
    import oracle

    names = [c for t in oracle.TABLES for c in spark.read.parquet(f"{sf_dir}/{t}.parquet").columns] + [r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name").collect()]
    names = sorted({*names, *oracle.TABLES, "", "__", "é", "a", "aa", "abab", "babababa", "x_y", "y x", "orderKey"})
    df = spark.createDataFrame([(a, b) for a in names for b in names[::3]], "a string, b string").repartition(6)
    got = df.select("a", "b", repair.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [x for x in got if abs(x["s"] - alike(x["a"], x["b"])) > 1e-9] == []
