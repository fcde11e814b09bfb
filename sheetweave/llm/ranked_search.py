"""Ranked lexical search by MaxScore over an index in shards.

``build`` writes the index: each task turns its documents, in their order, into
shards of about ``SHARD`` bytes of text.  A shard holds, for every term of its
documents, the documents and how often they hold it; terms are 64-bit hashes.
Nothing is shuffled but the counts of the terms that are asked for.

``search`` gives each shard all queries, in blocks that are sent to the
executors in groups of at most ``BROADCAST`` bytes, one group after the other.
Within a shard a query's terms are ordered by the most that they can add to a
score there.  Lists are essential, and add their documents, as long as the terms
from there on could lift an unseen document to the best ``k``; the remaining
lists are probed for the documents that are left, and a document is left only
while the terms to come can lift it to the threshold.  The threshold only
rises, and goes along from shard to shard in a task.  A task returns k rows a
query at most.

A text that is null or has no term is indexed without terms and never found.
Queries are the distinct pairs of id and text, null ids too; a text without
terms finds nothing.  Rows that repeat a document are documents each, and rank
one after the other; ids order equal scores, a null id last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import stored
from .tokens import chunks, word_hashes

#: Bytes of text of a shard, bytes of queries sent at once, queries of a block.
SHARD, BROADCAST, PER_BLOCK = 16 << 20, 32 << 20, 256
#: Scale of a score's parts, and the weights of term frequency and of length.
SCALE, TF, LENGTH, BASE, SLOPE = 1_000_000_000, 1000, 12, 100, 25

_PARTS = np.ones(256, bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _PARTS[_a : _b + 1] = False
_INDEX = {"ids": "array<bigint>", "n_spoken": "bigint", "n_terms": "bigint", "sizes": "binary", "terms": "binary", "starts": "binary", "docs": "binary", "counts": "binary"}


def counted(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Rows lo to hi, terms of each with the row they are in and how often, terms of each row with repeats, and bytes."""
    for lo, hi, data, at in chunks(column):
        words, of = word_hashes(data, at, _PARTS)
        row = np.repeat(np.arange(hi - lo), np.diff(of))
        order = np.lexsort((words, row))
        words, row = words[order], row[order]
        first = np.ones(len(words), bool)
        first[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(first)
        yield lo, hi, words[begin], row[begin], np.diff(np.append(begin, len(words))), np.diff(of), len(data)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list] = [[] for _ in range(5)]
    n = size = 0

    def shard() -> pa.RecordBatch:
        ids = pa.concat_arrays(held[0])
        words, docs, counts, sizes = (np.concatenate(x) for x in held[1:])
        order = np.argsort(words, kind="stable")
        words = words[order]
        begin = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
        parts = (sizes.astype(np.int64), words[begin], np.append(begin, len(words)).astype(np.int64), docs[order].astype(np.int32), counts[order].astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=list(_INDEX))

    for batch in batches:
        for lo, hi, words, row, counts, sizes, n_bytes in counted(batch.column("text")):
            for x, y in zip(held, (batch.column("id").slice(lo, hi - lo), words, row + n, counts, sizes), strict=True):
                x.append(y)
            n += hi - lo
            size += n_bytes
            if size >= SHARD:
                yield shard()
                held, n, size = [[] for _ in range(5)], 0, 0
    if n:
        yield shard()


def build(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all rows of ``docs``, as a stored table."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(_index, ", ".join(f"{n} {t}" for n, t in _INDEX.items())))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each query and how often it holds them."""
    for batch in batches:
        for lo, _, words, row, counts, _, _ in counted(batch.column("text")):
            at = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(at), batch.column("key").take(at), pa.array(words.view(np.int64)), pa.array(counts)], names=["item_id", "key", "term", "n"])


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield pa.RecordBatch.from_pydict({"term": np.frombuffer(batch.column("terms")[i].as_buffer(), np.int64), "df": np.diff(np.frombuffer(batch.column("starts")[i].as_buffer(), np.int64))})


def best(lists: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents, and their scores, among which are all of the best ``k`` that score ``floor`` at least.

    Each list has the documents of a term in ascending order, what it adds to
    their scores, and the most that it adds.
    """
    lists = sorted(lists, key=lambda x: -x[2])
    rest = np.append(np.cumsum([x[2] for x in lists][::-1])[::-1], 0)  # what the lists from i on can add
    score = np.zeros(n_docs, np.int64)
    least = floor

    def risen(of: np.ndarray) -> int:
        return max(least, int(np.partition(of, len(of) - k)[len(of) - k])) if len(of) >= k else least

    i = 0
    while i < len(lists) and rest[i] >= least:
        score[lists[i][0]] += lists[i][1]
        i += 1
        least = risen(score)
    left = np.flatnonzero(score)
    while i < len(lists):
        left = left[score[left] + rest[i] >= least]
        docs, adds, _ = lists[i]
        at = np.searchsorted(docs, left)
        hit = at < len(docs)
        hit[hit] = docs[at[hit]] == left[hit]
        score[left[hit]] += adds[at[hit]]
        i += 1
        least = risen(score[left])
    left = left[score[left] >= max(least, 1)]
    return left, score[left]


def _first(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` by falling score, then rising id, unknown ids last."""
    order = np.lexsort((ids, ~known, -scores))[:k]
    return scores[order], ids[order], known[order]


def _seek(k: int, n_spoken: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, terms, starts, docs, counts = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("sizes", np.int64), ("terms", np.uint64), ("starts", np.int64), ("docs", np.int32), ("counts", np.int32)))
                column = batch.column("ids")[i].values
                known = column.is_valid().to_numpy(zero_copy_only=False)
                ids = column.fill_null(0).to_numpy()
                length = BASE - SLOPE + SLOPE * sizes * n_spoken // max(n_terms, 1)
                lists: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
                for item in batch.column("items")[i].as_py():
                    asked = np.array([x["term"] for x in item["terms"]], np.int64).view(np.uint64)
                    at = np.searchsorted(terms, asked)
                    mine = []
                    for p, term, x in zip(at, asked, item["terms"], strict=True):
                        if p == len(terms) or terms[p] != term or not x["weight"]:
                            continue
                        if p not in lists:
                            own = slice(starts[p], starts[p + 1])
                            tf = counts[own].astype(np.int64)
                            part = SCALE * tf // (TF * tf + LENGTH * length[docs[own]])
                            lists[p] = docs[own], part, int(part.max())
                        mine.append((lists[p][0], lists[p][1] * x["weight"], lists[p][2] * x["weight"]))
                    key = item["item_id"], item["key"]
                    had = found.get(key)
                    left, scores = best(mine, len(sizes), k, int(had[0][-1]) if had and len(had[0]) == k else 0)
                    if len(left):
                        got = scores, ids[left], known[left]
                        found[key] = _first(*(np.concatenate(x) for x in zip(had, got, strict=True)) if had else got, k)
        for (item_id, key), (scores, ids, known) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([item_id] * len(ids), pa.int64()), pa.array([key] * len(ids), pa.string()), pa.array(ids, mask=~known), pa.array(scores)], names=["item_id", "key", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: of each row of ``items(item_id, text)`` the ``k`` best documents."""
    spark = index.sparkSession
    result = "item_id long, key string, doc_id long, score long"
    total = index.agg(F.sum("n_spoken"), F.sum("n_terms")).first()
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.sha2("text", 256).alias("key"), "text").dropDuplicates(["item_id", "key"])
    asked = stored(asked.mapInArrow(_asked, "item_id long, key string, term long, n long"))
    wanted = asked.select("term").distinct()
    small = wanted.count() * 16 <= BROADCAST
    held = index.select("terms", "starts").mapInArrow(_dictionary, "term long, df long")
    df = held.join(F.broadcast(wanted) if small else wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(total[0]) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    terms = asked.join(df, "term").select("item_id", "key", F.struct("term", (weight * F.col("n")).alias("weight")).alias("t"))
    blocks = -(-asked.select("item_id", "key").distinct().count() // PER_BLOCK)
    item = terms.groupBy("item_id", "key").agg(F.collect_list("t").alias("terms"))  # as long as the query's own text
    dealt = item.withColumn("block", F.pmod(F.xxhash64("item_id", "key"), F.lit(max(1, blocks)))).groupBy("block").agg(F.collect_list(F.struct("item_id", "key", "terms")).alias("items"), F.sum(F.size("terms") * 16 + 80).alias("size"))
    dealt = stored(dealt)
    groups = max(1, -(-(dealt.agg(F.sum("size")).first()[0] or 0) // BROADCAST))
    found = None
    for g in range(groups):
        part = dealt.where(F.pmod(F.xxhash64("block"), F.lit(groups)) == g).select("items")
        pairs = index.select("ids", "sizes", "terms", "starts", "docs", "counts").crossJoin(F.broadcast(part))  # blocks of stated queries, of a checked size
        got = pairs.mapInArrow(_seek(k, total[0] or 0, total[1] or 0), result)
        got = stored(got) if groups > 1 else got
        found = got if found is None else found.unionByName(got)
    order = W.partitionBy("item_id", "key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
