"""Hints for SQL that names tables or columns that don't exist, ranked over a catalog of any size."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import let

#: Candidates in a hint.
MOST = 3
# Points of names that are equal, one within the other, of each shared word, of equal words, and of like spelling.
EQUAL, WITHIN, WORD, WORDS, SPELLING = 100.0, 40.0, 20.0, 20.0, 20.0


def name_words(name: Column) -> Column:
    """The distinct words of a name in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9]+)")))


def _bare(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def _block(a: Column, b: Column) -> Column:
    """``size`` and ``at`` of the longest stretch of ``a`` that ``b`` holds too, of equals the first in ``a``.

    The stretch in hand is made longer while ``b`` holds it, and else begins one
    later: so ``b`` is searched twice for each character of ``a`` at most.
    """

    def step(s: Column, _: Column) -> Column:
        longer = F.substr(a, s["from"], s["size"] + 1)
        held = (s["from"] + s["size"] <= F.length(a)) & F.contains(b, longer)
        return F.struct(F.when(held, s["from"]).otherwise(s["from"] + 1).alias("from"), F.when(held, s["size"] + 1).otherwise(s["size"]).alias("size"), F.when(held, s["from"]).otherwise(s["at"]).alias("at"))

    start = F.struct(F.lit(1).alias("from"), F.lit(0).alias("size"), F.lit(0).alias("at"))
    return F.aggregate(F.sequence(F.lit(1), 2 * F.length(a)), start, step)


def matched_characters(a: Column, b: Column) -> Column:
    """Characters in common blocks of two texts: the longest one, then those of what is left of it in both, and right of it, and so on."""

    def step(s: Column, _: Column) -> Column:
        rest = F.slice(s["todo"], F.lit(2), F.size(s["todo"]))

        def with_block(top: Column, f: Column) -> Column:
            def with_place(j: Column) -> Column:
                left = F.struct(F.substr(top["a"], F.lit(1), f["at"] - 1).alias("a"), F.substr(top["b"], F.lit(1), j - 1).alias("b"))
                right = F.struct(F.substr(top["a"], f["at"] + f["size"]).alias("a"), F.substr(top["b"], j + f["size"]).alias("b"))
                sides = F.filter(F.array(left, right), lambda x: (x["a"] != "") & (x["b"] != ""))
                return F.struct(F.concat(sides, rest).alias("todo"), (s["n"] + f["size"]).alias("n"))

            return F.when(f["size"] > 0, let(F.instr(top["b"], F.substr(top["a"], f["at"], f["size"])), with_place)).otherwise(F.struct(rest.alias("todo"), s["n"].alias("n")))

        return F.when(F.size(s["todo"]) > 0, let(s["todo"][0], lambda top: let(_block(top["a"], top["b"]), lambda f: with_block(top, f)))).otherwise(s)

    whole = F.filter(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda x: (x["a"] != "") & (x["b"] != ""))
    start = F.struct(whole.alias("todo"), F.lit(0).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), 2 * F.least(F.length(a), F.length(b)) + 1), start, step, lambda s: s["n"])


def similarity(wanted: Column, candidate: Column) -> Column:
    """Points for how alike two names are; spelling is the share of characters in common blocks.

    A name without a letter or digit is like no other.  As for names of fewer
    than 200 characters: in longer ones a matcher may pass over frequent characters.
    """
    a, b = _bare(wanted), _bare(candidate)
    own, other = name_words(wanted), name_words(candidate)
    shared = F.size(F.array_intersect(own, other))
    points = F.when(F.contains(a, b) | F.contains(b, a), WITHIN).otherwise(0.0) + shared * WORD + F.when((shared > 0) & (shared == F.size(own)) & (shared == F.size(other)), WORDS).otherwise(0.0)
    ratio = 2.0 * matched_characters(a, b) / (F.length(a) + F.length(b))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, EQUAL).otherwise(points + ratio * SPELLING)


def best(candidates: DataFrame, column: str, wanted: str, n: int = MOST) -> DataFrame:
    """The ``n`` distinct names of ``column`` most like ``wanted``, with their ``score``; ties by name."""
    scored = candidates.select(column).distinct().withColumn("score", similarity(F.lit(wanted), F.col(column)))
    return scored.where("score > 0").orderBy(F.desc("score"), column).limit(n)


def hint(error: AnalysisException, columns: DataFrame, n: int = MOST) -> dict | None:
    """What the error is about, and candidates from ``columns(table_name, column_name)``; None for other errors."""
    about, given = error.getCondition() or "", error.getMessageParameters() or {}

    def last(key: str) -> str:
        return given.get(key, "").strip("`").split("`.`")[-1]

    if about == "TABLE_OR_VIEW_NOT_FOUND":
        name = last("relationName")
        return {"problem": "missing_table", "identifier": name, "candidates": [r["table_name"] for r in best(columns, "table_name", name, n).collect()]}
    if about == "AMBIGUOUS_REFERENCE":
        name = last("name")
        return {"problem": "ambiguous_column", "identifier": name, "candidates": [r[0] for r in columns.where(F.col("column_name") == name).select("table_name").distinct().orderBy("table_name").collect()]}
    if about.startswith("UNRESOLVED_COLUMN"):
        name = last("objectName")
        near = best(columns, "column_name", name, n)
        owned = near.join(columns, "column_name").groupBy("column_name", "score").agg(F.array_sort(F.collect_set("table_name")).alias("tables")).orderBy(F.desc("score"), "column_name")
        return {"problem": "missing_column", "identifier": name, "candidates": [{"column": r["column_name"], "tables": r["tables"]} for r in owned.collect()]}
    return None
