"""Best-fit packing of documents into sequences of fixed length, with conflicts.

Documents longer than a sequence are cut into pieces.  Pieces are dealt by hash
into shards of about ``SHARD`` pieces and packed shard by shard in descending
length: bins are ordered by their free tokens, the search starts at the tightest
bin that has room and goes on to its successors until one has no conflict.  A bin
carries bitmaps of the sources and of the duplicate clusters in it: it takes at
most ``per_source`` pieces of a source and one of a cluster.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut, width

CAPACITY, PER_SOURCE, SHARD = 2048, 2, 4096


class Bins:
    """Open bins of one shard."""

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []  # free tokens, bin
        self.sources: list[list[int]] = []  # of each bin: bitmap of sources held once or more, twice or more, ...
        self.clusters: list[int] = []
        self.bit: dict[tuple[str, object], int] = {}

    def place(self, size: int, source: object, cluster: object) -> tuple[int, int]:
        """The bin that takes the piece and its free tokens before."""
        s = 1 << self.bit.setdefault(("s", source), len(self.bit))
        c = 1 << self.bit.setdefault(("c", cluster), len(self.bit))
        i = bisect_left(self.order, (size, -1))
        while i < len(self.order):
            free, bin_ = self.order[i]
            if not self.sources[bin_][-1] & s and not self.clusters[bin_] & c:
                del self.order[i]
                break
            i += 1
        else:
            free, bin_ = self.capacity, len(self.clusters)
            self.sources.append([0] * self.per_source)
            self.clusters.append(0)
        for level, held in enumerate(self.sources[bin_]):
            if not held & s:
                self.sources[bin_][level] = held | s
                break
        self.clusters[bin_] |= c
        if free > size:
            insort(self.order, (free - size, bin_))
        return bin_, free


def _pack(capacity: int, per_source: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int64()), ("bin_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bins = None, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("shard", "doc_id", "piece", "start_token", "n_tokens", "source", "cluster")]
            rows = []
            for of, doc, piece, start, n, source, cluster in zip(*cols, strict=True):
                if of != shard:
                    shard, bins = of, Bins(capacity, per_source)
                number, free = bins.place(n, source, cluster)
                rows.append((doc, piece, start, n, of * (1 << 31) + number, capacity - free))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def pack(docs: DataFrame, *, doc_col: str = "doc_id", tokens_col: str = "tokens", source_col: str = "source", cluster_col: str = "cluster", capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD) -> DataFrame:
    """``doc_id, piece, start_token, n_tokens, bin_id, offset`` for each piece of each row.

    ``start_token`` is where the piece starts in its document, ``offset`` where
    it stands in its bin.  A document without tokens has one row with null
    ``bin_id``.  Null sources are one source; a null cluster is no other's.
    Repeated rows are packed each.  Whole pieces of a long document fill a bin
    of their own; its last piece is packed like any other.
    """
    spark = docs.sparkSession
    n = F.coalesce(F.col(tokens_col), F.lit(0)).cast("long")
    rows = docs.select(F.col(doc_col).cast("long").alias("doc_id"), n.alias("tokens"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(cluster_col).cast("string"), F.concat(F.lit("#"), F.col(doc_col).cast("string")), F.lit("#")).alias("cluster"))
    rows = cut(rows)
    pieces = rows.where("tokens > 0").withColumn("piece", F.explode(F.expr(f"sequence(0, cast((tokens - 1) div {capacity} as int))")))
    pieces = pieces.withColumn("start_token", F.col("piece").cast("long") * capacity).withColumn("n_tokens", F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("start_token")))
    shards = max(1, -(-pieces.count() // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards)))
    dealt = dealt.repartition(max(1, min(shards, width(spark))), "shard").sortWithinPartitions("shard", F.desc("n_tokens"), "doc_id", "piece")
    packed = dealt.select("shard", "doc_id", "piece", "start_token", "n_tokens", "source", "cluster").mapInArrow(_pack(capacity, per_source), "doc_id long, piece int, start_token long, n_tokens long, bin_id long, offset long")
    bare = rows.where("tokens = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start_token"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("offset"))
    return packed.unionByName(bare)
