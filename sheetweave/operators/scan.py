"""Running values over ordered groups of any length.

A group is cut into strips of its order column, which has to be a number.
Strips are worked on apart; one row of each strip tells what it hands on, and
only those rows are walked group by group, so that a long group isn't one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values of the order column in a strip.
STRIP = 4096


def in_strips(rows: DataFrame, order: str, width: float = STRIP) -> DataFrame:
    return rows.withColumn("_strip", F.floor(F.col(order) / width).cast("long"))


def rejoined(rows: DataFrame, told: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of the one row of ``told`` that has the same keys, null keys too."""
    renamed = told.select(*(F.col(k).alias(f"_of_{k}") for k in keys), *(c for c in told.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(renamed, same, "left").drop(*(f"_of_{k}" for k in keys))


def running_sum(rows: DataFrame, by: list[str], order: str, value: Column, name: str, width: float = STRIP) -> DataFrame:
    """The sum of ``value`` up to and including each row; null counts as 0."""
    cut = in_strips(rows.withColumn("_value", F.coalesce(value.cast("bigint"), F.lit(0))), order, width)
    inside = W.partitionBy(*by, "_strip").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy(*by).orderBy("_strip").rowsBetween(W.unboundedPreceding, -1)
    told = cut.groupBy(*by, "_strip").agg(F.sum("_value").alias("_own")).withColumn("_before", F.coalesce(F.sum("_own").over(earlier), F.lit(0))).drop("_own")
    local = cut.withColumn("_local", F.sum("_value").over(inside))
    return rejoined(local, told, [*by, "_strip"]).withColumn(name, F.col("_local") + F.col("_before")).drop("_local", "_before", "_value", "_strip")


def running_last(rows: DataFrame, by: list[str], order: str, value: Column, name: str, width: float = STRIP, *, later: bool = False) -> DataFrame:
    """The last value that isn't null up to and including each row, or with ``later`` the first one after it."""
    cut = in_strips(rows.withColumn("_value", value), order, width)
    way = F.col(order).desc() if later else F.col(order).asc()
    strip_way = F.col("_strip").desc() if later else F.col("_strip").asc()
    inside = W.partitionBy(*by, "_strip").orderBy(way).rowsBetween(W.unboundedPreceding, -1 if later else 0)
    earlier = W.partitionBy(*by).orderBy(strip_way).rowsBetween(W.unboundedPreceding, -1)
    pick = F.min_by if later else F.max_by
    told = cut.where("_value is not null").groupBy(*by, "_strip").agg(pick("_value", order).alias("_own"))
    every = rejoined(cut.select(*by, "_strip").distinct(), told, [*by, "_strip"])
    told = every.withColumn("_before", F.last("_own", ignorenulls=True).over(earlier)).drop("_own")
    local = cut.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    return rejoined(local, told, [*by, "_strip"]).withColumn(name, F.coalesce("_local", "_before")).drop("_local", "_before", "_value", "_strip")
