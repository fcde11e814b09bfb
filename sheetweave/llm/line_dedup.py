"""Removal of repeated runs of lines by a suffix array over line ids.

A text is the sequence of its lines that have a word.  Lines that occur once
can't be part of a repeat and drop out; the stretches between them are the texts
of the array.

1. Suffixes are ranked by their first line, then by prefix doubling: the rank by
   2s lines is that of the pair of ranks by s lines at a suffix and s lines on.
   Doubling goes on until every suffix is told from all others or its stretch
   ends, so the order is that of whole suffixes, whatever the length of a run.
   Pairs are numbered in range-partitioned order, and a rank is extended by its
   pair's number, so those that are settled needn't be ranked again.
2. Longest common prefixes of neighbours: ranks tell them up to a power of two,
   lines beyond it are compared only where the neighbours' lines before differ,
   as any other prefix is the one a line earlier without its first line.
3. Slices of the array are walked for each suffix's longest prefix that also
   starts earlier, in order of document and line.  An interval may cross any
   number of slices: what it shares with them is told by their profiles, the
   first suffix within each common prefix from the border on.
4. The first occurrence of a run stays, later ones go.  A run counts from
   ``MIN_WORDS`` words on and reaches as far as its last window of so many
   words; runs that overlap join into maximal ones.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import cut, shared_folder, stored, width

#: Words of a run that is removed, at least.
MIN_WORDS = 4
#: Rows that are sent to every executor, those of a task between two steps, and those of a slice of the array.
SENT, TASK, SLICE = 50_000, 50_000, 100_000
_ID = -(1 << 63)
_FAR = (1 << 31) - 1
_AT = ["id", "hash", "seq"]


def _lines(min_words: int):
    kinds = {"id": pa.int64(), "hash": pa.int64(), "seq": pa.int32(), "line_a": pa.int64(), "line_b": pa.int64(), "before": pa.int64(), "need": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for doc, mark, text in zip(batch.column("id").to_pylist(), batch.column("hash").to_pylist(), batch.column("text"), strict=True):
                kept = [(x, n) for x in text.as_py().encode().split(b"\n") if (n := len(x.split()))]
                upto = np.cumsum([0, *(n for _, n in kept)])
                need = np.searchsorted(upto, upto[:-1] + min_words) - np.arange(len(kept))
                digests = b"".join(hashlib.blake2b(line, digest_size=16).digest() for line, _ in kept)
                ids = np.frombuffer(digests, "<i8").reshape(-1, 2)
                for x, y in zip(out, ([doc] * len(kept), [mark] * len(kept), range(len(kept)), ids[:, 0].tolist(), ids[:, 1].tolist(), [None, *ids[:-1, 0].tolist()][: len(kept)], need.tolist()), strict=True):
                    x += y
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds.values(), strict=True)], names=list(kinds))
                    out = [[] for _ in kinds]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds.values(), strict=True)], names=list(kinds))

    return run


def _neighbours(ends: dict[int, tuple]):
    """Each suffix with the one before it in the array, and what ranks tell of their common prefix."""
    kinds = {"at": pa.int64(), "id": pa.int64(), "hash": pa.int64(), "seq": pa.int32(), "need": pa.int32(), "other_id": pa.int64(), "other_hash": pa.int64(), "other_seq": pa.int32(), "low": pa.int32(), "high": pa.int32(), "lcp": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, True
        for batch in batches:
            out: list[tuple] = []
            for part, at, doc, mark, seq, need, before, stretch, rank in zip(*(batch.column(c).to_pylist() for c in ("part", "at", *_AT, "need", "before", "stretch", "rank")), strict=True):
                if first:
                    last, first = ends.get(part), False
                own = (doc, mark, seq, before, stretch, rank)
                low, high, lcp, other = 0, 0, 0, last or (None,) * 6
                if last and rank == last[5]:
                    lcp = stretch
                elif last and rank[:8] == last[5][:8]:
                    shared = 8
                    while rank[shared : shared + 8] == last[5][shared : shared + 8]:
                        shared += 8
                    low = 1 << (shared // 8 - 1)
                    high = min(2 * low - 1, stretch, last[4])
                    # Else the lines before the two are the same: a common prefix that starts earlier goes on.
                    lcp = low if low >= high else None
                    if lcp is None and before is not None and before == last[3]:
                        low = 0
                out.append((at, doc, mark, seq, need, *other[:3], low, high, lcp))
                last = own
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))

    return run


def _shown(reached: Iterator[tuple[int, tuple]]) -> list[tuple[int, tuple]]:
    """A profile, from (lines in common with the border, suffix) in the order of their distance.

    It holds the first suffix with so many lines in common: fewer lines and
    earlier suffixes from one entry to the next.
    """
    out: list[tuple[int, tuple]] = []
    for lines, own in reached:
        if not lines:
            break
        if not out or own < out[-1][1]:
            if out and out[-1][0] == lines:
                out.pop()
            out.append((lines, own))
    return out


def _joined(own: list[tuple], beyond: list[tuple], least: int) -> list[tuple]:
    """A slice's profile and that of its other border, which has ``least`` lines in common with all of the slice."""
    return _shown(iter([*own, *((min(n, least), x) for n, x in beyond)]))


def profiles(suffixes: list[tuple], lcp: list[int]) -> tuple[list[tuple], list[tuple], int]:
    """What a slice shows to the one after it and to the one before it, and the lines that all of it has in common with the one before."""
    back = itertools.accumulate([_FAR, *lcp[:0:-1]], min)
    return _shown(zip(back, reversed(suffixes), strict=True)), _shown(zip(itertools.accumulate(lcp, min), suffixes, strict=True)), min(lcp)


def _nearest(suffixes: list[tuple], lcp: list[int], profile: list[tuple]) -> list[int]:
    """Lines that each suffix has in common with the nearest earlier one among those before it in the array."""
    firsts = [x for _, x in profile][::-1]
    stack: list[tuple] = []
    out = []
    for own, shared in zip(suffixes, lcp, strict=True):
        while stack and stack[-1][0] > own:
            shared = min(shared, stack.pop()[1])
        if stack:
            out.append(shared)
        else:
            n = bisect.bisect_left(firsts, own)
            out.append(min(shared, profile[len(profile) - n][0]) if n else 0)
        stack.append((own, shared))
    return out


def longest_earlier(suffixes: list[tuple], lcp: list[int], before: list[tuple] = (), after: list[tuple] = ()) -> list[int]:
    """Lines of the longest prefix of each suffix of a slice that also starts at an earlier one, in the slice or beyond."""
    back = _nearest(suffixes[::-1], [_FAR, *lcp[:0:-1]], list(after))[::-1]
    return [max(x, y) for x, y in zip(_nearest(suffixes, lcp, list(before)), back, strict=True)]


def _slice(batches: Iterator[pa.RecordBatch]) -> tuple[int, list[tuple], list[int], list[int]]:
    part, suffixes, lcp, need = -1, [], [], []
    for batch in batches:
        if batch.num_rows:
            part = batch.column("part")[0].as_py()
            suffixes += zip(*(batch.column(c).to_pylist() for c in _AT), strict=True)
            lcp += batch.column("lcp").to_pylist()
            need += batch.column("need").to_pylist()
    return part, suffixes, lcp, need


_PROFILE = pa.list_(pa.struct([("lines", pa.int32()), ("id", pa.int64()), ("hash", pa.int64()), ("seq", pa.int32())]))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, suffixes, lcp, _ = _slice(batches)
    if suffixes:
        after, before, least = profiles(suffixes, lcp)
        shown = [pa.array([[dict(zip(("lines", *_AT), (n, *x), strict=True)) for n, x in p]], _PROFILE) for p in (after, before)]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *shown, pa.array([least], pa.int32())], names=["part", "after", "before", "least"])


def _earlier(borders: dict[int, tuple[list, list]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, suffixes, lcp, need = _slice(batches)
        found = [(*x, x[2] + n) for x, n, least in zip(suffixes, longest_earlier(suffixes, lcp, *borders.get(part, ([], []))), need, strict=True) if n >= least]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=[*_AT, "stop"])

    return run


def _rebuild(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone, runs = [], [], [], []
            for text, cuts in zip(batch.column("text"), batch.column("cuts").to_pylist(), strict=True):
                whole = text.as_py()
                lines = whole.split("\n")
                words = [(i, n) for i, x in enumerate(lines) if (n := len(x.encode().split()))]
                upto = np.cumsum([0, *(n for _, n in words)])
                drop = np.zeros(len(words) + 1, np.int64)
                for c in cuts or ():
                    window = np.searchsorted(upto, upto[c["stop"]] - min_words, "right") - 1  # the run's last
                    drop[c["seq"]] += 1
                    drop[np.searchsorted(upto, upto[window] + min_words)] -= 1
                out = np.cumsum(drop)[:-1] > 0
                lost = {i for (i, _), x in zip(words, out, strict=True) if x}
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in lost) if lost else whole)
                counts.append(len(words))
                gone.append(len(lost))
                runs.append(int((np.diff(np.concatenate([[0], out.astype(np.int8)])) == 1).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64())], names=["row", "kept_text", "n_lines", "n_removed", "n_runs"])

    return run


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SENT else df


def _numbered(pairs: DataFrame, n: int) -> DataFrame:
    """Distinct (x, y) with ``number``, eight bytes that follow their order."""
    ordered = pairs.repartitionByRange(_tasks(pairs.sparkSession, n), "x", "y").sortWithinPartitions("x", "y")
    return stored(ordered.withColumn("number", F.expr("unhex(lpad(hex(monotonically_increasing_id() + 1), 16, '0'))")))


def _tasks(spark: SparkSession, n: int) -> int:
    return min(width(spark), 1 + n // TASK)


def suffix_ranks(lines: DataFrame) -> tuple[DataFrame, int]:
    """``id, hash, seq, need, before, stretch, rank`` of all lines that occur more than once, and their number.

    ``rank`` orders the suffixes by their lines up to the end of their stretch
    of repeated lines, which has ``stretch`` lines; equal ranks are equal suffixes.
    """
    spark = lines.sparkSession
    folder = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    kept = [*_AT, "need", "before", "stretch", "rank", "live", "ended", "round"]

    def saved(ranked: DataFrame, span: int) -> DataFrame:
        """Suffixes ranked by ``span`` lines; those that share a rank and go on are live, those that end are before them."""
        marked = ranked.withColumns({"live": F.expr(f"n > 1 and stretch > {span}"), "ended": F.expr(f"n > 1 and stretch <= {span}"), "round": F.lit(span)})
        marked = marked.withColumn("rank", F.expr("if(ended, concat(rank, X'0000000000000000'), rank)")).select(*kept)
        marked.write.parquet(f"{folder}/{span}")
        paths.append(f"{folder}/{span}")
        return spark.read.schema(marked.schema).parquet(*paths)

    first = lines.withColumnsRenamed({"line_a": "x", "line_b": "y"})
    twice = first.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1")
    repeated = first.join(_numbered(twice, TASK * width(spark)), ["x", "y"]).withColumnRenamed("number", "rank")
    repeated = repeated.select(*_AT, "need", "before", "rank", "n").repartition("id", "hash").dropDuplicates(_AT)
    gaps = repeated.withColumn("gap", F.col("seq") - F.row_number().over(Window.partitionBy("id", "hash").orderBy("seq")))
    stretches = gaps.withColumn("stretch", (F.max("seq").over(Window.partitionBy("id", "hash", "gap")) - F.col("seq") + 1).cast("int"))
    paths: list[str] = []
    span = 1
    ranks = saved(stretches, span)
    total = ranks.count()
    while left := ranks.where(f"live and round = {span}").count():
        live = ranks.where(f"live and round = {span}").select(*_AT, "need", "before", "stretch", F.col("rank").alias("x"), (F.col("seq") + span).alias("to"))
        # By ``span`` lines, those that end here share a rank with those that go on.
        own = F.expr(f"if(ended and round = {span}, substring(rank, 1, length(rank) - 8), rank)")
        later = ranks.where(f"not live or round = {span}").select("id", "hash", F.col("seq").alias("to"), own.alias("y"))
        pairs = stored(_few(live, left).join(later, ["id", "hash", "to"]).drop("to").coalesce(_tasks(spark, left) if left <= SENT else width(spark)))
        counted = _numbered(pairs.groupBy("x", "y").agg(F.count("*").alias("n")), left)
        span *= 2
        ranks = saved(pairs.join(_few(counted, left), ["x", "y"]).withColumn("rank", F.concat("x", "number")).coalesce(_tasks(spark, left)), span)
    return ranks.where("not live").drop("live", "ended", "round"), total


def suffix_array(ranks: DataFrame, slices: int) -> DataFrame:
    """``at, id, hash, seq, need, lcp`` of all suffixes: their order, and the lines in common with the one before."""
    ordered = ranks.repartitionByRange(slices, "rank", *_AT).sortWithinPartitions("rank", *_AT)
    ordered = cut(ordered.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), *_AT, "need", "before", "stretch", "rank"))
    last = ordered.groupBy("part").agg(F.max_by(F.struct(*_AT, "before", "stretch", "rank"), "at").alias("end")).orderBy("part").collect()
    ends = {b["part"]: (*a["end"][:5], bytes(a["end"]["rank"])) for a, b in zip(last, last[1:], strict=False)}
    pairs = stored(ordered.mapInArrow(_neighbours(ends), "at long, id long, hash long, seq int, need int, other_id long, other_hash long, other_seq int, low int, high int, lcp int"))
    # Lines beyond a power of two, and not beyond a stretch.
    unknown = pairs.where("lcp is null and low > 0")
    beyond = unknown.agg(F.coalesce(F.sum("high") - F.sum("low"), F.lit(0))).first()[0]
    words = ordered.select("id", "hash", "seq", F.expr("substring(rank, 1, 8)").alias("word"))
    asked = unknown.select("at", "id", "hash", F.col("seq").alias("start"), "other_id", "other_hash", "other_seq", F.explode(F.expr("sequence(low, high - 1)")).alias("i")).withColumn("seq", F.expr("start + i"))
    one = _few(asked, beyond).join(words, _AT).select("at", "i", F.col("other_id").alias("id"), F.col("other_hash").alias("hash"), F.expr("other_seq + i").alias("seq"), F.col("word").alias("own"))
    differ = _few(one, beyond).join(words, _AT).where("own != word").groupBy("at").agg(F.min("i").alias("differ"))
    told = pairs.join(_few(differ, beyond), "at", "left").withColumn("lcp", F.expr("if(lcp is null and low > 0, coalesce(differ, high), lcp)"))
    stop = F.max(F.col("seq") + F.col("lcp")).over(Window.partitionBy("id", "hash").orderBy("seq"))
    return told.select("at", *_AT, "need", F.coalesce("lcp", stop - F.col("seq")).cast("int").alias("lcp"))


def earlier_runs(array: DataFrame, slices: int) -> DataFrame:
    """``id, hash, seq, stop``: the longest run from each line on that also starts earlier, where it has the lines it needs."""
    ordered = array.repartitionByRange(slices, "at").sortWithinPartitions("at")
    ordered = cut(ordered.select(F.spark_partition_id().alias("part"), *_AT, "need", "lcp"))
    shown = "array<struct<lines:int,id:long,hash:long,seq:int>>"
    told = ordered.mapInArrow(_summaries, f"part int, after {shown}, before {shown}, least int").orderBy("part").collect()
    borders: dict[int, tuple[list, list]] = {s["part"]: ([], []) for s in told}

    def profile(rows) -> list[tuple]:
        return [(x["lines"], (x["id"], x["hash"], x["seq"])) for x in rows]

    for a, b in zip(told, told[1:], strict=False):
        borders[b["part"]] = (_joined(profile(a["after"]), borders[a["part"]][0], a["least"]), [])
    for a, b in zip(told[-2::-1], told[:0:-1], strict=False):
        borders[a["part"]] = (borders[a["part"]][0], _joined(profile(b["before"]), borders[b["part"]][1], b["least"]))
    return ordered.mapInArrow(_earlier(borders), "id long, hash long, seq int, stop int")


def remove_repeated_lines(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of ``docs`` as the struct ``row``, with ``kept_text, n_lines, n_removed, n_runs``.

    ``n_lines`` counts lines with a word, ``n_runs`` the maximal removed runs.
    Lines without a word stay and don't interrupt a run.  Null texts count as
    empty.  The first of several rows with the same id and text keeps its lines
    in all of them, for they are one document; null ids come first in the order.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.coalesce(F.col(doc_col).cast("long"), F.lit(_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    lines = stored(rows.select("id", "hash", "text").mapInArrow(_lines(min_words), "id long, hash long, seq int, line_a long, line_b long, before long, need int"))
    ranks, total = suffix_ranks(lines)
    slices = max(width(spark), 1 + total // SLICE)
    cuts = earlier_runs(suffix_array(ranks, slices), slices).groupBy("id", "hash").agg(F.collect_list(F.struct("seq", "stop")).alias("cuts"))
    schema = f"row {docs.select(*(F.col(f'`{c}`') for c in rest)).schema.simpleString()}, kept_text string, n_lines long, n_removed long, n_runs long"
    return rows.join(cuts, ["id", "hash"], "left").select("row", "text", "cuts").mapInArrow(_rebuild(min_words), schema)
