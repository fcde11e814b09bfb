"""Near-duplicate groups by an LSH forest over MinHash signatures.

Texts with the same set of shingles are one class.  Each class has a signature
of ``TREES * DEPTH`` minimum hashes; every tree sorts all classes by its own
``DEPTH`` of them.  The sorted orders are range-partitioned, and each task walks
its stretch: classes with a common prefix of ``LEAST`` values form a region, a
region of more than ``CROWD`` classes is split by one more value, and so on, so
that the depth fits how crowded the region is.  Within a region, and between
neighbours in the order where a region is split, candidates are pairs whose
signatures agree enough.  Candidates are confirmed on the full sets.

Two rounds keep dense groups from giving all pairs: the first confirms each
class's best partners, the second takes every remaining candidate between
classes that the first round hasn't joined.  The second doesn't split regions by
depth: one of more than ``CROWD`` classes is cut into blocks, and every pair of
blocks is a task, except where both hold only the component that most of the
region is in.  So all classes of a region meet, however crowded it is.  Classes
with more than ``MANY`` remaining candidates, as in a large group of loose
copies, bring their full sets along in that round, and where two of them meet
they are compared in place: only links leave the task, not pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import components, cut, sent, width
from .tokens import chunks, mix, seeds, shingles

TREES, DEPTH = 10, 12
#: Values that classes of a region share at least: a pair at 0.85 meets in some tree with probability 1 - (1 - 0.85**3)**10 > 0.9999.
LEAST = 3
#: Classes in a region, or in a block of a larger one, that are compared pair by pair.
CROWD = 1024
#: Shingles of the classes in a block, about.
HEAVY = 1 << 21
#: Sampling errors of the signature estimate by which a candidate may lie below the threshold.
SLACK = 4.0
#: Remaining candidates above which a class brings its full set.
MANY = 64

_XOR, _MUL = seeds(TREES * DEPTH, 101), seeds(TREES * DEPTH, 103) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each minimum hash; rows of empty sets are zero."""
    out = np.zeros((len(sets), TREES * DEPTH), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        values = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        for k in range(TREES * DEPTH):
            low = np.minimum.reduceat((values ^ _XOR[k]) * _MUL[k], starts)
            out[full, k] = (mix(low) >> np.uint64(48)).astype(np.uint16)
    return out


def _sketch(shingle_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi, data, at in chunks(texts):
                sets, _ = shingles(data, at, shingle_words)
                marks = signatures(sets)
                yield pa.RecordBatch.from_arrays(
                    [ids[lo:hi].cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([m.tobytes() for m in marks], pa.binary())],
                    schema=schema,
                )

    return run


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class and tree: the tree's label, and a byte of every value."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        marks = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(n, TREES * DEPTH)
        bytes_ = pa.array([m.tobytes() for m in (marks & 255).astype(np.uint8)], pa.binary())
        for t in range(TREES):
            label = marks[:, t * DEPTH : (t + 1) * DEPTH].astype(">u2")
            keys = [bytes([t]) + x.tobytes() for x in label]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[: 1 + 2 * LEAST] for x in keys], pa.binary()), pa.array(keys, pa.binary()), *(batch.column(c) for c in ("doc_id", "component", "size", "shingles")), bytes_],
                names=["region", "label", "doc_id", "component", "size", "shingles", "bytes"],
            )


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The region of each class in each tree."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        marks = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(n, TREES * DEPTH)
        for t in range(TREES):
            prefix = marks[:, t * DEPTH : t * DEPTH + LEAST].astype(">u2")
            yield pa.RecordBatch.from_arrays([pa.array([bytes([t]) + x.tobytes() for x in prefix], pa.binary()), *(batch.column(c) for c in ("component", "size"))], names=["region", "component", "size"])


def _fewest(floor: float) -> int:
    """Bytes of two signatures that agree in a candidate, at least."""
    return int(np.ceil(TREES * DEPTH * (floor * 255 + 1) / 256))


def _meet(percent: int, floor: float, count: bool = False):
    """Candidates and links of whole regions and of pairs of blocks, between components; count: only how many candidates a class has."""
    values = TREES * DEPTH
    least = _fewest(floor)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])

    def in_place(rows, whole, apart, linked):
        """Links between classes that brought their sets, one at most between two components."""
        sides, ids, comps, sizes, sets, _ = rows
        parts = [np.frombuffer(sets[i], np.uint64) for i in whole]
        values, of, many = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(len(whole)), [len(p) for p in parts])[many[of] > 1]
        feature = (np.cumsum(many > 1) - 1)[of][many[of] > 1]
        both = np.zeros((len(whole), len(whole)), np.float32)
        order = np.argsort(feature, kind="stable")
        doc, feature = doc[order], feature[order]
        for lo in range(0, int(feature[-1]) + 1 if len(feature) else 0, 2048):
            a, b = np.searchsorted(feature, [lo, lo + 2048])
            has = np.zeros((len(whole), 2048), np.float32)
            has[doc[a:b], feature[a:b] - lo] = 1
            both += has @ has.T
        n = sizes[whole].astype(np.float32)
        fits = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (comps[whole][:, None] != comps[whole][None, :])
        if apart:
            fits &= sides[whole][:, None] != sides[whole][None, :]
        i, j = np.nonzero(fits)
        _, one = np.unique(np.stack([comps[whole][i], comps[whole][j]], 1), axis=0, return_index=True)
        linked.append((ids[whole][i[one]], ids[whole][j[one]]))

    def group(rows, found, linked):
        sides, ids, comps, sizes, sets, marks = rows
        m = len(ids)
        apart = bool(sides.any())
        left, right = (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)) if apart else (np.arange(m), np.arange(m))
        if not len(left) or not len(right):
            return
        brought = np.array([x is not None for x in sets])
        if brought.sum() > 1:
            in_place(rows, np.flatnonzero(brought), apart, linked)
        many = np.zeros(m, np.int64)
        for lo in range(0, len(left), 64):
            own = left[lo : lo + 64]
            i, j = np.nonzero((comps[own, None] != comps[None, right]) & (100 * np.minimum(sizes[own, None], sizes[None, right]) >= percent * np.maximum(sizes[own, None], sizes[None, right])) & ~(brought[own, None] & brought[None, right]) & (apart | (own[:, None] < right[None, :])))
            i, j = own[i], right[j]
            near = np.concatenate([np.zeros(0, bool), *((marks[i[k : k + 8192]] == marks[j[k : k + 8192]]).sum(1) >= least for k in range(0, len(i), 8192))])
            if count:
                many += np.bincount(i[near], minlength=m) + np.bincount(j[near], minlength=m)
            else:
                found.append((ids[i[near]], ids[j[near]]))
        if count:
            found.append((ids, many))

    def pairs(keys, *rows):
        found: list[tuple[np.ndarray, np.ndarray]] = []
        linked: list[tuple[np.ndarray, np.ndarray]] = []
        at = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if hi - lo > 1:
                group(tuple(x[lo:hi] for x in rows), found, linked)
        if not found and not linked:
            return None
        a, b = (np.concatenate(x) for x in zip(*found, *linked, strict=True))
        sure = np.repeat([False, True], [sum(len(x[0]) for x in found), sum(len(x[0]) for x in linked)])
        if count:
            return pa.RecordBatch.from_arrays([pa.array(a[b > 0]), pa.array(b[b > 0].astype(np.int64)), pa.array(sure[b > 0])], schema=schema)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), sure], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(both[:, 2].astype(bool))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            region = np.frombuffer(b"".join(batch.column("region").to_pylist()), np.uint8).reshape(n, 1 + 2 * LEAST)
            tasks = np.stack([batch.column(c).to_numpy() for c in ("i", "j")], 1).astype(np.int32).view(np.uint8).reshape(n, 8)
            marks = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.uint8).reshape(n, values)
            sets = np.array([x.as_py() for x in batch.column("shingles")] + [None], object)[:-1]
            now = (np.concatenate([region, tasks], 1), *(batch.column(c).to_numpy() for c in ("side", "doc_id", "component", "size")), sets, marks)
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            change = np.flatnonzero((now[0][1:] != now[0][:-1]).any(1))
            last = int(change[-1]) + 1 if len(change) else 0
            held = tuple(x[last:] for x in now)
            if last and (out := pairs(*(x[:last] for x in now))) is not None:
                yield out
        if held is not None and (out := pairs(*held)) is not None:
            yield out

    return run


def _walk(percent: int, floor: float, best: int):
    """Candidates of one sorted stretch: the best partners for each class in each region."""
    values = TREES * DEPTH
    least = _fewest(floor)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    ends = 1 + 2 * LEAST

    def block(rows, found):
        ids, comps, sizes, marks = rows
        m = len(ids)
        for lo in range(0, m, 64):
            own = slice(lo, min(m, lo + 64))
            same = (marks[own, None, :] == marks[None, :, :]).sum(-1, dtype=np.int16)
            less, more = np.minimum(sizes[own, None], sizes[None, :]), np.maximum(sizes[own, None], sizes[None, :])
            same[(comps[own, None] == comps[None, :]) | (100 * less < percent * more)] = -1
            for _ in range(min(best, m - 1)):
                j = same.argmax(1)
                i = np.flatnonzero(same[np.arange(len(j)), j] >= least)
                if not len(i):
                    break
                found.append((ids[lo + i], ids[j[i]]))
                same[i, j[i]] = -1

    def region(keys, rows, depth, found):
        m = len(keys)
        if m < 2:
            return
        if m <= CROWD:
            block(rows, found)
            return
        ids, comps, _, marks = rows
        # Neighbours in the order, whose common prefixes are the longest.
        near = np.flatnonzero(((marks[1:] == marks[:-1]).sum(1) >= least) & (comps[1:] != comps[:-1]))
        found.append((ids[near], ids[near + 1]))
        if depth == DEPTH:
            for lo in range(0, m, CROWD // 2):
                block(tuple(x[lo : lo + CROWD] for x in rows), found)
            return
        stop = 1 + 2 * (depth + 1)
        at = [0, *(np.flatnonzero((keys[1:, :stop] != keys[:-1, :stop]).any(1)) + 1), m]
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            region(keys[lo:hi], tuple(x[lo:hi] for x in rows), depth + 1, found)

    def pairs(keys, *rows):
        found: list[tuple[np.ndarray, np.ndarray]] = []
        at = [0, *(np.flatnonzero((keys[1:, :ends] != keys[:-1, :ends]).any(1)) + 1), len(keys)]
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if hi - lo > 1:
                region(keys[lo:hi], tuple(x[lo:hi] for x in rows), LEAST, found)
        if not found:
            return None
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint8).reshape(n, 1 + 2 * DEPTH)
            marks = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.uint8).reshape(n, values)
            now = (keys, *(batch.column(c).to_numpy() for c in ("doc_id", "component", "size")), marks)
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            change = np.flatnonzero((now[0][1:, :ends] != now[0][:-1, :ends]).any(1))
            last = int(change[-1]) + 1 if len(change) else 0
            held = tuple(x[last:] for x in now)
            if last and (out := pairs(*(x[:last] for x in now))) is not None:
                yield out
        if held is not None and (out := pairs(*held)) is not None:
            yield out

    return run


def _sets(shingle_words: int):
    """The full set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column("text")):
                sets, _ = shingles(data, at, shingle_words)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "shingles"])

    return run


def _confirm(percent: int, shingle_words: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = {}
            keep = np.zeros(batch.num_rows, bool)
            texts = batch.column("text_b")
            for lo, hi, data, at in chunks(batch.column("text_a")):
                left, _ = shingles(data, at, shingle_words)
                for lo2, hi2, data2, at2 in chunks(texts[lo:hi]):
                    right, _ = shingles(data2, at2, shingle_words)
                    for i, y in enumerate(right):
                        x = left[lo2 + i]
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        keep[lo + lo2 + i] = 100 * common >= percent * (len(x) + len(y) - common)
            kept = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept)) for c in ("a", "b")], schema=schema)

    return run


def near_duplicates(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each document.

    Documents whose sets have at least ``percent`` hundredths of their union in
    common are linked; a component is what links reach, named by its smallest
    id.  Null, empty and blank texts have an empty set and stay alone.  Rows
    with the same id share a component.  A row with a null id isn't compared: it
    is returned with a null component and kept.  Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    drawn = cut(texts.mapInArrow(_sketch(shingle_words), "doc_id long, n_shingles long, set_id binary, signature binary"))
    classes = drawn.where("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("signature").alias("signature"))
    classes = cut(classes.select("doc_id", "set_id", "size", "signature"))
    error = (percent / 100 * (1 - percent / 100) / (TREES * DEPTH)) ** 0.5
    floor = percent / 100 - SLACK * error

    region = "region binary, component long, size long"
    every = classes.withColumn("component", F.col("doc_id"))
    crowds = cut(every.select("signature", "component", "size").mapInArrow(_regions, region).groupBy("region").count().where(F.col("count") > CROWD).select("region"))
    quiet = crowds.isEmpty()
    known = crowds if quiet else sent(crowds, 200)

    def planted(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", "component", "size", "shingles", "signature").mapInArrow(_plant, "region binary, label binary, doc_id long, component long, size long, shingles binary, bytes binary")

    def walked(rows: DataFrame) -> DataFrame:
        """Best partners; only crowded regions are split between tasks."""
        marked = planted(rows).drop("shingles").withColumn("crowded", F.lit(False)) if quiet else planted(rows).drop("shingles").join(known.withColumn("crowded", F.lit(True)), "region", "left")
        split = [F.when(F.col("crowded"), F.col(c)) for c in ("label", "doc_id")]
        return marked.repartitionByRange(width(spark), "region", *split).sortWithinPartitions("label", "doc_id").mapInArrow(_walk(percent, floor, 2), "a long, b long")

    def blocks(rows: DataFrame) -> DataFrame:
        """For each crowded region the component that most of it is in, and the blocks of that and of the rest."""
        held = rows.select("signature", "component", "size").mapInArrow(_regions, region).join(known, "region").groupBy("region", "component").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
        top = held.groupBy("region").agg(F.max_by(F.struct("component", "n", "s"), F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"))

        def needed_for(n, s):
            return F.greatest(F.ceil(n / CROWD), F.ceil(s / HEAVY)).cast("int")

        return cut(top.select("region", F.col("top.component").alias("main"), needed_for(F.col("top.n"), F.col("top.s")).alias("solid"), needed_for(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("loose")))

    def met(rows: DataFrame, count: bool = False) -> DataFrame:
        every = planted(rows)
        if quiet:
            tasks = every.select("*", *(F.lit(0).alias(c) for c in ("i", "j", "side")))
        else:
            placed = every.join(shape, "region", "left")
            small = placed.where("loose is null").select(*every.columns, *(F.lit(0).alias(c) for c in ("i", "j", "side")))
            own = F.expr("cast(if(component = main, loose + pmod(xxhash64(doc_id), solid), pmod(xxhash64(doc_id), loose)) as int)")
            large = placed.where("loose > 0").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, if(component = main, loose, loose + solid) - 1)")))
            tasks = small.unionByName(large.select(*every.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side")))
        ordered = tasks.drop("label").repartition(width(spark), "region", "i", "j").sortWithinPartitions("region", "i", "j")
        return ordered.mapInArrow(_meet(percent, floor, count), "a long, b long, sure boolean")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = needed.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        right = needed.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent, shingle_words), "a long, b long"))

    alone = F.lit(None).cast("binary")
    first = cut(walked(every.withColumn("shingles", alone)).distinct())
    wanted = first.select(F.explode(F.array("a", "b")).alias("doc_id"))
    if not quiet:  # the first round doesn't see all pairs of these
        within = every.select("signature", "component", "size").mapInArrow(_regions, region).join(known, "region")
        wanted = wanted.unionByName(within.select(F.col("component").alias("doc_id")))
    wanted = cut(wanted.distinct())
    # Rows that repeat an id and a text are read once; without repeated ids there is nothing to deal out for that.
    again = cut(drawn.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    needed = texts.join(wanted, "doc_id", "left_semi")
    if not again.isEmpty():
        needed = needed.join(again, "doc_id", "left_anti").unionByName(needed.join(again, "doc_id", "left_semi").distinct())
    needed = cut(needed)
    links = confirmed(first)
    joined = components(links).withColumnRenamed("node", "doc_id")
    ranked = cut(classes.join(wanted, "doc_id", "left_semi").join(joined, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    shape = None if quiet else sent(blocks(ranked), 240)
    crowded = met(ranked.withColumn("shingles", alone), count=True).groupBy(F.col("a").alias("doc_id")).agg(F.sum("b").alias("n")).where(F.col("n") > MANY).select("doc_id")
    whole = needed.join(crowded, "doc_id", "left_semi").mapInArrow(_sets(shingle_words), "doc_id long, shingles binary").groupBy("doc_id").agg(F.first("shingles").alias("shingles"))
    found = cut(met(ranked.join(whole, "doc_id", "left")).distinct())
    rest = found.where("not sure").select("a", "b").join(first, ["a", "b"], "left_anti")
    links = links.unionByName(found.where("sure").select("a", "b")).unionByName(confirmed(rest))
    final = components(links)
    of_class = classes.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("set_id", F.coalesce("component", "doc_id").alias("component_id"))
    full = drawn.where("n_shingles > 0 and doc_id is not null").join(of_class, "set_id").select("doc_id", "n_shingles", "component_id")
    bare = drawn.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
