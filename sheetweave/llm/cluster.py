"""Lineage cuts and connected components on Spark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the folder that the session names.

    Where no folder is named, a local session, as in tests, gets a temporary one;
    on a cluster, where executors don't share it, that is an error.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sheetweave-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder.

    Unlike a checkpoint it carries no inferred constraints along, which a loop
    of joins would multiply.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Edges of a task between two steps.
EDGES = 100_000
#: Bytes up to which a table is sent to every executor.
BROADCAST = 64 << 20


def sent(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, marked to be broadcast if its rows, which are counted, take no more than ``BROADCAST`` bytes."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST else df


def width(spark: SparkSession) -> int:
    """Shuffle partitions of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is its smallest node.

    Alternates large-star and small-star steps.  Each star takes its centre from
    a partially aggregated minimum that is joined back, so that a node with very
    many neighbours isn't gathered in one task.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct().coalesce(parts)

    def small(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        kept = e.join(low, "a")
        moved = kept.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct().coalesce(parts)

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    was = state(edges)
    while was[0]:
        parts = 1 + was[0] // EDGES  # few edges aren't dealt out to many small files
        edges = cut(small(large(edges.coalesce(parts))))
        now = state(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
