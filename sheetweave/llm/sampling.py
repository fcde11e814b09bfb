"""Bounded, repeatable samples for training, and the fold that is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for the quarter of all documents that no model learns from; false where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def bounded(rows: DataFrame, stratum: str, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of each stratum: those whose key has the least hash.

    Hashes above what twice the bound needs are dropped first, so that the
    ranking sees few rows of a large stratum, wherever they are.
    """
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_n"))
    spread = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    near = rows.withColumn("_u", spread).join(sizes, stratum).where(F.col("_u") * F.col("_n") <= 2 * most + 100)
    order = W.partitionBy(stratum).orderBy("_u", key)
    return near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_u", "_n", "_r")
