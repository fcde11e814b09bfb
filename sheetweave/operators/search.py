"""Search over text columns, lines, catalog fields and vectors; ranking happens before the limit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import let


def matches(c: Column, query: str, *, regex: bool = False, case_sensitive: bool | None = None) -> Column:
    """Literal or regex match; without a choice, case counts only if the query has a capital."""
    exact = case_sensitive if case_sensitive is not None else query != query.lower()
    if regex:
        return c.rlike(query if exact else f"(?i){query}")
    return F.contains(c, F.lit(query)) if exact else F.contains(F.lower(c), F.lit(query.lower()))


def search_rows(table: DataFrame, key: str, columns: list[str], query: str, **how) -> DataFrame:
    """``key, column_name, value`` for every text cell that matches."""
    cells = table.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns))).alias("c")).select(key, "c.*")
    return cells.where(matches(F.col("value"), query, **how))


def search_lines(texts: DataFrame, key: str, text: str, query: str, **how) -> DataFrame:
    """``key, line_no`` (from 1) and ``line`` for every line that matches."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return lines.where(matches(F.col("line"), query, **how)).select(key, (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def submatches(c: Column, query: str, *, regex: bool = False, case_sensitive: bool | None = None) -> Column:
    """``start, end, match`` of each match in a line, from left to right without overlap; positions from 0, end exclusive."""
    exact = case_sensitive if case_sensitive is not None else query != query.lower()
    pattern = ("" if exact else "(?iu)") + (query if regex else "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E")
    found, gaps = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)

    # Each match and the gap before it have a length; the running sums of those are the ends.
    pairs = F.filter(F.arrays_zip(found.alias("m"), gaps.alias("g")), lambda z: z["m"].isNotNull())

    def placed(z: Column) -> Column:
        ends = running(F.transform(z, lambda x: F.length(x["g"]) + F.length(x["m"])))
        return let(ends, lambda e: F.transform(z, lambda x, i: F.struct((e[i] - F.length(x["m"])).cast("long").alias("start"), e[i].cast("long").alias("end"), x["m"].alias("match"))))

    return F.when(c.isNotNull(), let(pairs, placed))


def running(values: Column, size: int = 64) -> Column:
    """Running sums of an array of integers, by blocks and blocks of blocks, so that no value is copied or added many times over."""

    def direct(v: Column) -> Column:
        return F.transform(v, lambda _, i: F.aggregate(F.slice(v, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x))

    def blocked(inner):
        def sums(v: Column) -> Column:
            cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda b: F.slice(v, b * size + 1, F.lit(size)))

            def joined(blocks: Column) -> Column:
                totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
                return let(let(totals, inner), lambda upto: F.flatten(F.transform(blocks, lambda block, b: F.transform(direct(block), lambda x: x + F.when(b > 0, upto[b - 1]).otherwise(0)))))

            return let(cut, joined)

        return sums

    return F.when(F.size(values) > 0, let(values, blocked(blocked(direct)))).otherwise(F.array().cast("array<int>"))


def about(results: DataFrame, wanted: str) -> DataFrame:
    """Results whose ``id`` or ``text`` contains a filter, or whose ``refs`` (array) hold it."""
    return results.where(F.coalesce(F.contains("id", F.lit(wanted)), F.lit(False)) | F.coalesce(F.contains("text", F.lit(wanted)), F.lit(False)) | F.coalesce(F.array_contains("refs", wanted), F.lit(False)))


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 3)), F.lit("..."))).otherwise(c)


def token_overlap(left: DataFrame, right: DataFrame, tokens: str, score: str = "overlap") -> DataFrame:
    """Pairs that share a token and how many, by an equi-join on tokens: all of them, so for a small ``left`` or rare tokens.

    ``lexical_matches`` finds the pairs above a threshold without joining on common tokens.
    """
    a = left.select(F.col("id").alias("left_id"), F.explode(tokens).alias("t"))
    b = right.select(F.col("id").alias("right_id"), F.explode(tokens).alias("t"))
    return a.join(b, "t").groupBy("left_id", "right_id").agg(F.count("*").alias(score))


def cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


# Weights of the fields that a search looks at, the bias of a kind, and the order of result types.
FIELD_WEIGHTS = {"name": 80, "source_path": 75, "column": 70, "create_sql": 30, "type": 20, "kind": 20}
KIND_BIAS = {"typed_content_view": 5, "view_or_table": 3, "raw_content_table": -2, "internal_catalog": -6}
TYPE_ORDER = ("sqlite_view", "sqlite_table", "sql_file", "output_file", "pdf_file", "artifact_file")


def metadata_matches(fields: DataFrame, query: str, **how) -> DataFrame:
    """``id, type, field, value, rank`` of each artifact's best matching field.

    ``fields`` has ``id, type, kind, position, field, value``; of equal weights
    the first by position counts.
    """
    weight = F.coalesce(*(F.when(F.col("field") == k, v) for k, v in FIELD_WEIGHTS.items()), F.lit(0))
    bias = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in KIND_BIAS.items()), F.lit(0))
    hits = fields.where(matches(F.col("value"), query, **how)).withColumn("rank", weight + bias)
    best = hits.groupBy("id", "type").agg(F.min(F.struct((-F.col("rank")).alias("r"), "position", "field", "value")).alias("m"))
    return best.select("id", "type", F.col("m.field").alias("field"), preview(F.col("m.value"), 300).alias("value"), (-F.col("m.r")).cast("bigint").alias("rank"))


def ranked(results: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of ``results(id, type, line, rank)`` from all scopes: by rank, type, id and line."""
    order = F.coalesce(*(F.when(F.col("type") == t, i) for i, t in enumerate(TYPE_ORDER)), F.lit(99))
    return results.orderBy(F.desc("rank"), order, "id", F.coalesce("line", F.lit(0))).limit(n)


def lexical_matches(queries: DataFrame, texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """``query_id, id, score``: for each query the ``n`` texts that hold the largest share of its tokens, of ``threshold`` at least.

    Both have ``id, tokens`` (distinct).  A text with that share must hold one of
    the query's rarest tokens, as many as may be missing and one more, so only
    those are joined on; a token that stands everywhere is joined on only by a
    query that has nothing rarer.
    """
    spread = texts.select(F.col("id").alias("text_id"), F.explode("tokens").alias("t"))
    common = spread.groupBy("t").agg(F.count("*").alias("f"))
    asked = queries.where(F.size("tokens") > 0).select(F.col("id").alias("query_id"), "tokens", F.explode("tokens").alias("t"))
    rare = asked.join(common, "t", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "t"))).alias("s"))
    needed = F.size("s") - F.ceil(F.size("s") * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    seeds = rare.select("query_id", F.explode(F.slice(F.transform("s", lambda x: x["t"]), F.lit(1), needed)).alias("t"))
    pairs = seeds.join(spread, "t").select("query_id", "text_id").distinct()
    both = pairs.join(queries.select(F.col("id").alias("query_id"), F.col("tokens").alias("q")), "query_id").join(texts.select(F.col("id").alias("text_id"), F.col("tokens").alias("d")), "text_id")
    scored = both.select("query_id", F.col("text_id").alias("id"), (F.size(F.array_intersect("q", "d")) / F.size("q")).alias("score")).where(F.col("score") >= threshold - 1e-12)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")


#: Query vectors that are broadcast at once.
BLOCK = 4096


def nearest(vectors: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """``query_id, id, score``: for each query vector the ``n`` other vectors of greatest cosine, rounded to six digits, ties by id.

    Both have ``id, v``; vectors that are null, empty or all zero, or hold a null
    or NaN, have no direction and are left out.  Queries go to all rows in blocks of at most ``BLOCK``;
    each task keeps the best ``n`` of its rows for every query of the block.
    """
    queries, vectors = (df.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & F.exists("v", lambda x: x != 0)) for df in (queries, vectors))
    asked = queries.select("id", F.col("v").cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() * 5 // (BLOCK * 4)))
    dealt = asked.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        part = [(r["id"], r["v"]) for r in dealt.where(F.col("b") == b).collect()]
        if part:
            best = vectors.select("id", F.col("v").cast("array<double>").alias("v")).mapInPandas(_best(part, n), "query_id long, id long, score double")
            found = best if found is None else found.unionByName(best)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")


def _best(part: list, n: int):
    def run(batches):
        ids = np.array([i for i, _ in part])
        q = np.array([v for _, v in part])
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["v"].to_numpy())
            score = np.round(q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 6)
            own = batch["id"].to_numpy()
            for i in range(len(ids)):
                order = np.lexsort((own, -score[i]))[: n + 1]
                order = order[own[order] != ids[i]][:n]
                held.append(pd.DataFrame({"query_id": ids[i], "id": own[order], "score": score[i][order]}))
            if len(held) > 4 * len(ids):
                held = [_top(held, n)]
        if held:
            yield _top(held, n)

    return run


def _top(held: list, n: int):
    every = pd.concat(held).sort_values(["query_id", "score", "id"], ascending=[True, False, True])
    return every.groupby("query_id").head(n)
