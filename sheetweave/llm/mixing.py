"""Mixing to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic).  Targets are shares of the
tokens to keep, for the categories of each dimension.  A category that holds
fewer tokens than its target is kept whole, and the others share what it leaves
in proportion to their targets.  Each pass scales the cells' probabilities, which
end at 1, so that the expected tokens of every source, then every language, then
every topic are those wanted; passes end when all three fit.  A document is kept
with its cell's probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import stored

DIMENSIONS = ("source", "lang", "topic")
#: Passes at most, and the part of the tokens to keep by which a category may miss its target when they end.
PASSES, TOLERANCE = 12, 0.002
#: Where no targets are given: a category's share is in proportion to its tokens to this power: 1 keeps the mix, 0 makes it even.
TEMPER = 0.5
#: Expected share of tokens that is kept.
KEEP = 0.6
#: Cells or categories up to which they are broadcast; more are joined by a shuffle.
SMALL = 50_000
#: Cells in a partition while they are raked.
PART = 200_000

# One rule for Spark and DuckDB.
TOPIC = """case when text is null then 'none'
     when contains(text, 'icensed under') then 'license'
     when contains(text, '@') then 'contact'
     when contains(text, '|') or contains(text, '###') then 'markup'
     when length(text) < 400 then 'short'
     when length(text) > 6000 then 'long'
     else 'prose' end"""


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) for each id, from its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _few(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast where it is small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def wanted(cells: DataFrame, dimension: str, keep: float, *, temper: float = TEMPER, targets: DataFrame | None = None) -> DataFrame:
    """``category, share, wanted``: each category's target share, and its tokens to keep.

    In order of tokens over share, a category is kept whole as long as that
    ratio is below what the rest can have for each part of a share.  What holds
    for the first that isn't, the greatest such value, holds for the rest.
    """
    own = cells.groupBy(F.col(dimension).alias("category")).agg(F.sum("tokens").cast("double").alias("tokens"))
    if targets is None:
        asked = own.withColumn("share", F.pow("tokens", F.lit(temper)))
    else:
        given = targets.where(F.col("dimension") == dimension).groupBy("category").agg(F.sum("share").cast("double").alias("share"))
        asked = own.join(given, "category").where("share > 0")
    goal = own.agg((F.sum("tokens") * F.lit(float(keep))).alias("goal"))
    shares = asked.join(F.broadcast(asked.agg(F.sum("share").alias("all")))).join(F.broadcast(goal)).selectExpr("category", "tokens", "share / all as share", "goal")
    # One row for each category, few next to the documents, in one order.
    before = "(order by tokens / share, category rows between unbounded preceding and 1 preceding)"
    rated = shares.selectExpr("*", f"(goal - coalesce(sum(tokens) over {before}, 0)) / (1 - coalesce(sum(share) over {before}, 0)) as rate")
    return rated.join(F.broadcast(rated.agg(F.max("rate").alias("best")))).selectExpr("category", "share", "least(tokens, share * best) as wanted")


def rake(cells: DataFrame, *, keep: float = KEEP, temper: float = TEMPER, targets: DataFrame | None = None, passes: int = PASSES, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """``cells`` (dimensions and ``tokens``) with a ``probability``, and how the marginals came out.

    ``targets`` has ``dimension, category, share``; shares are scaled to 1 over
    the categories that have tokens.  A dimension that it doesn't name has the
    tempered shares, a category missing from a dimension that it names none, and
    so probability 0.  The second table has ``dimension, category, share, wanted,
    expected``: the target's share, the tokens to keep and the expected ones.
    """
    some = cells.where("tokens > 0")
    parts = 1 + some.count() // PART
    named = {r["dimension"] for r in targets.select("dimension").distinct().collect()} if targets is not None else set()
    placed = some.withColumn("probability", F.lit(float(keep)))
    for d in DIMENSIONS:
        goals = stored(wanted(some, d, keep, temper=temper, targets=targets if d in named else None).coalesce(parts))
        placed = placed.join(_few(goals.selectExpr(f"category as {d}", f"share as share_{d}", f"wanted as wanted_{d}")), d, "left")
    fitted = stored(placed.coalesce(parts))
    goal = (fitted.agg(F.sum("tokens")).first()[0] or 0) * keep

    def now(d: str) -> Column:
        """The expected tokens of a cell's category.  Cells are few next to the documents, so a window over them is, too."""
        return F.sum(F.col("tokens") * F.col("probability")).over(W.partitionBy(d))

    for _ in range(passes):
        for d in DIMENSIONS:
            factor = F.coalesce(F.col(f"wanted_{d}") / F.nullif(now(d), F.lit(0.0)), F.lit(0.0))
            fitted = fitted.withColumn("probability", F.least(F.lit(1.0), F.col("probability") * factor)).coalesce(parts)
        fitted = stored(fitted)
        gaps = [fitted.groupBy(d).agg(F.abs(F.sum(F.col("tokens") * F.col("probability")) - F.first(f"wanted_{d}")).alias("miss")).agg(F.max("miss")).first()[0] for d in DIMENSIONS]
        if max((g for g in gaps if g is not None), default=0.0) <= tolerance * goal:
            break
    report = [fitted.where(f"wanted_{d} is not null").groupBy(F.lit(d).alias("dimension"), F.col(d).alias("category")).agg(F.first(f"share_{d}").alias("share"), F.first(f"wanted_{d}").alias("wanted"), F.sum(F.col("tokens") * F.col("probability")).alias("expected")) for d in DIMENSIONS]
    full = cells.join(fitted.select(*DIMENSIONS, "probability"), list(DIMENSIONS), "left").withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    return full, report[0].unionByName(report[1]).unionByName(report[2])


def mix(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", topic: str = TOPIC, targets: DataFrame | None = None, passes: int = PASSES, temper: float = TEMPER, keep: float = KEEP) -> DataFrame:
    """Every row of ``docs`` as the struct ``row``, with its cell, ``tokens``, ``weight``, ``probability`` and ``kept``.

    ``targets`` and what follows from it: see ``rake``.  ``weight`` is the
    probability over ``keep``.  Null sources and languages are the category
    ``unknown``.  A document without words has probability 0 where its cell has
    no tokens, else its cell's.  Rows that share an id share their fate within a
    cell.  ``kept`` compares the probability with a number drawn from the id's
    hash, so a rerun keeps the same.
    """
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(doc_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in ("source", "lang")))
    rows = named.withColumn("topic", F.expr(topic)).withColumn("tokens", tokens(F.col("text")))
    cells = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    raked, _ = rake(cells, passes=passes, temper=temper, keep=keep, targets=targets)
    weights = _few(stored(raked.select(*DIMENSIONS, (F.col("probability") / F.lit(float(keep))).alias("weight"), "probability")))
    return rows.join(weights, list(DIMENSIONS)).withColumn("kept", uniform(F.col("id")) < F.col("probability")).select("row", "id", *DIMENSIONS, "tokens", "weight", "probability", "kept")
