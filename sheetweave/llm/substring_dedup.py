"""Removal of long byte strings that occur more than once in a corpus.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else.  Suffixes are sampled: a suffix is kept if the 16 bytes it starts with have
the least hash in some window of ``LENGTH`` bytes, so every window of that
length, wherever it stands, holds the same sampled suffixes.  Two equal windows
agree on at least half their length either after or before such a place, its
*lead*: the leading bytes of the suffix, or of the reversed prefix.

1. Places whose surroundings of ``LENGTH`` bytes either way are equal form a
   class; a class of two or more places is covered as a whole.
2. Classes whose lead no other class has can't match and are dropped.
3. The others are range-partitioned by their leads with sampled splitters.  In
   each bucket they are sorted, and within a run of equal leads every window
   around the place is compared.  Equal leads never lie on both sides of a
   splitter, so nothing has to be compared across one.  Windows are taken by
   ranges, and a range is halved only for classes that share what all its windows
   hold.  At worst a run's work is its classes times its windows: one of more than
   ``PART`` classes goes to several tasks, each with all classes and a range of
   the windows, and one of more than ``CROWD`` is compared by a shuffle of its
   window hashes, so that it needn't fit in a task.
4. Spans return to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import cut, width
from .tokens import BYTE, Powers, chunks, mix, prefix_hashes, seeds, text_bytes

GRAM = 16
#: Classes with one lead that a task compares in all of their windows, and those that fit in a task at all.
PART, CROWD = 2048, 20_000
BLOCK = 4096
_ID = -(1 << 63)


def _slide(x: np.ndarray, w: int, op, pad: int) -> np.ndarray:
    """op over x[i : i + w] for each i up to len(x) - w, by blocks of w."""
    n = len(x)
    m = -(-n // w) * w
    y = np.full(m, pad, x.dtype)
    y[:n] = x
    y = y.reshape(-1, w)
    ahead = op.accumulate(y, axis=1).ravel()
    back = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - w + 1], ahead[w - 1 : n])


def places(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions of several texts joined, and their prefix hashes."""
    sums = prefix_hashes(data)
    w = length - GRAM + 1
    if len(data) < length:
        return np.zeros(0, np.int64), sums
    _, down = Powers.upto(len(data) + 1)
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1]) | np.uint64(1)
    low = _slide(gram, w, np.minimum, (1 << 64) - 1)
    inside = np.zeros(len(low) + 1, np.int8)  # windows within one text
    whole = np.diff(at) >= length
    np.add.at(inside, at[:-1][whole], 1)
    np.add.at(inside, at[1:][whole] - length + 1, -1)
    low[np.cumsum(inside[:-1]) == 0] = 0
    edge = np.zeros(w - 1, np.uint64)
    high = _slide(np.concatenate([edge, low, edge]), w, np.maximum, 0)
    return np.flatnonzero(high == gram), sums


def _places(length: int):
    half = length // 2
    salt = seeds(3, 211)
    names = ["id", "hash", "place", "before", "after", "around", "key_after", "key_before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column("text")):
                found, sums = places(data, at, length)
                if not len(found):
                    continue
                _, down = Powers.upto(len(data) + 1)

                def of(i, j, tag, sums=sums, down=down):
                    return mix((sums[j] - sums[i]) * down[i] ^ tag).view(np.int64)

                doc = np.searchsorted(at, found, "right") - 1
                before, after = np.minimum(length, found - at[doc]), np.minimum(length, at[doc + 1] - found)
                around = of(found - before, found + after, salt[0] + (before * (length + 1) + after).astype(np.uint64))
                key_after = of(found, np.minimum(found + half, len(data)), salt[1])
                key_before = of(np.maximum(found - half, 0), found, salt[2])
                rows = pa.array(lo + doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("hash").take(rows), pa.array((found - at[doc]).astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), pa.array(around), pa.array(key_after, mask=after < half), pa.array(key_before, mask=before < half)],
                    names=names,
                )

    return run


def _surroundings(length: int):
    """Bytes around each wanted place; ``lead`` and ``rest`` are read away from the place on the lead's side and on the other."""
    half = length // 2
    names = list(_AROUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            cols = {n: batch.column(n).to_pylist() for n in ("id", "hash", "wanted")}
            out: list[list] = [[] for _ in names]
            for row, wanted in enumerate(cols["wanted"]):
                data = texts[row].as_py().encode()
                for w in wanted:
                    p = w["place"]
                    if w["side"] == 0:
                        lead, far, near = data[p : p + half], data[p + half : p + length], data[max(0, p - half) : p][::-1]
                    else:
                        lead, far, near = data[p - half : p][::-1], data[max(0, p - length + GRAM) : p - half][::-1], data[p : p + half]
                    for part in range(w["parts"]):
                        for x, y in zip(out, (w["side"], lead, part, w["parts"], far, near, cols["id"][row], cols["hash"][row], p), strict=True):
                            x.append(y)
                if len(out[0]) >= BLOCK:
                    yield _batch(names, out)
                    out = [[] for _ in names]
            if out[0]:
                yield _batch(names, out)

    return run


_AROUND = {"side": pa.int32(), "lead": pa.binary(), "part": pa.int32(), "parts": pa.int32(), "far": pa.binary(), "near": pa.binary(), "id": pa.int64(), "hash": pa.int32(), "place": pa.int32()}


def _batch(names, out):
    return pa.RecordBatch.from_arrays([pa.array(x, _AROUND[n]) for n, x in zip(names, out, strict=True)], names=names)


def _padded(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    data, at = text_bytes(column)
    out, sizes = np.zeros((len(column), n), np.uint8), np.diff(at)
    out[np.arange(n)[None, :] < sizes[:, None]] = data
    return out, sizes


def _ends(side: int, length: int) -> tuple[int, int]:
    """Bytes on the near side of a window, from and below. Side 0: up to half the bytes before the place; side 1: fewer than half after it, and its gram at least."""
    half = length // 2
    return (0, half + 1) if side == 0 else (GRAM, half)


def _sums(lead: pa.Array, far: pa.Array, near: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hashes of each row's bytes, near side reversed, then away from the place; bytes on the near side and beyond the lead."""
    half = length // 2
    x, _ = _padded(lead, half)
    y, far_n = _padded(far, length - half)
    z, near_n = _padded(near, half)
    text = np.concatenate([z[:, ::-1], x, y], axis=1)
    up, _ = Powers.upto(2 * length)
    sums = np.zeros((len(text), text.shape[1] + 1), np.uint64)
    for lo in range(0, len(text), 1024):
        np.cumsum(BYTE[text[lo : lo + 1024]] * up[None, : text.shape[1]], axis=1, out=sums[lo : lo + 1024, 1:])
    return sums, near_n, far_n


def window_hashes(side: int, lead: pa.Array, far: pa.Array, near: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row, a number of bytes on the near side and a hash for each window around the places."""
    half = length // 2
    sums, near_n, far_n = _sums(lead, far, near, length)
    _, down = Powers.upto(2 * length)
    n = np.arange(*_ends(side, length))
    h = mix((sums[:, half - n + length] - sums[:, half - n]) * down[half - n])
    rows, at = np.nonzero((near_n[:, None] >= n) & (far_n[:, None] >= length - half - n))
    return rows, n[at], h[rows, at]


def _equal(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal values together, where each begins in it, and how many they are."""
    order = np.argsort(h)
    start = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    return order, start, np.diff(np.append(start, len(h)))


def extremes(h, near_n: np.ndarray, far_n: np.ndarray, beyond: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the least and the most n, lo <= n < hi, for which another row has the same window of n bytes on the near side and ``beyond`` - n beyond the lead; most is -1 without one.

    ``h(rows, n, m)`` hashes n bytes on the near side, the lead and m beyond.  A
    range of n is halved only for rows that share with another what all of its
    windows hold; of rows that share all that any of them holds, which is their
    answer, one stays as a partner for others.
    """
    least, most = hi.copy(), np.full(len(hi), -1)
    rows, new = np.arange(len(hi)), np.ones(len(hi), bool)
    while True:
        has = (lo < hi) & (near_n[rows] >= lo) & (far_n[rows] > beyond - hi)
        rows, lo, hi, new = (x[has] for x in (rows, lo, hi, new))
        new &= (least[rows] > lo) | (most[rows] < hi - 1)
        if not new.any():
            return least, most
        order, start, size = _equal(h(rows, lo, beyond - hi + 1))
        held = order[np.repeat((size > 1) & np.logical_or.reduceat(new[order], start), size)]
        rows, lo, hi, new = (x[held] for x in (rows, lo, hi, new))
        whole = np.flatnonzero((near_n[rows] >= hi - 1) & (far_n[rows] >= beyond - lo))
        if len(whole):
            order, start, size = _equal(h(rows[whole], hi[whole] - 1, beyond - lo[whole]))
            found = whole[order[np.repeat(size > 1, size)]]
            np.minimum.at(least, rows[found], lo[found])
            np.maximum.at(most, rows[found], hi[found] - 1)
            new[found] = False
            held = np.ones(len(rows), bool)
            held[whole[np.delete(order, start)]] = False
            rows, lo, hi, new = (x[held] for x in (rows, lo, hi, new))
        rows, lo, hi, new = (x[hi - lo > 1] for x in (rows, lo, hi, new))
        mid = (lo + hi) // 2
        rows, lo, hi, new = np.tile(rows, 2), np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.tile(new, 2)


def _begins(rows: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    """Rows that differ from the one before in one of these columns."""
    out = np.ones(rows.num_rows, bool)
    out[1:] = False
    for n in names:
        x = rows.column(n)
        out[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    return out


def _compare(length: int):
    half = length // 2
    _, down = Powers.upto(2 * length)
    run_of = ("part", "side", "lead")

    def block(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(_begins(rows, run_of)).astype(np.uint64)
        side = rows.column("side").to_numpy()
        for s in (0, 1):
            own = np.flatnonzero(side == s)
            if not len(own):
                continue
            part = rows.take(pa.array(own))
            tag = mix(group[own])
            sums, near_n, far_n = _sums(*(part.column(c) for c in ("lead", "far", "near")), length)

            def h(rows, n, m, sums=sums, tag=tag):
                text = mix((sums[rows, 2 * half + m] - sums[rows, half - n]) * down[half - n])
                return mix(text + tag[rows] + mix((n * (2 * length) + m).astype(np.uint64)))

            first, last = _ends(s, length)
            k, parts = (part.column(c).to_numpy().astype(np.int64) for c in ("part", "parts"))
            least, most = extremes(h, near_n, far_n, length - half, *(first + (last - first) * x // parts for x in (k, k + 1)))
            hit = np.flatnonzero(most >= 0)
            a, b = least[hit], most[hit]
            start, stop = (-b, length - a) if s == 0 else (a - length, b)
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(hit)) for c in ("id", "hash", "place")), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["id", "hash", "place", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                held = part if held is None else pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                # A repeated row of the input gives its places again.
                held = held.filter(pa.array(_begins(held, ("place", "part", "side", "hash", "id", "lead"))))
                if held.num_rows >= BLOCK and (last := int(np.flatnonzero(_begins(held, run_of))[-1])):
                    yield from block(held.slice(0, last))
                    held = held.slice(last)
        if held is not None and held.num_rows:
            yield from block(held)

    return run


def _dealt(places: DataFrame) -> DataFrame:
    """Each crowded place once, dealt out to all tasks: a place makes hundreds of windows, so tasks joined by their bytes would be long."""
    return places.repartition(width(places.sparkSession), "side", "id", "hash", "place").distinct()


def _windows(length: int):
    """Windows of crowded leads, and how often they are found.

    Windows that places of one batch share are given once.  The first and last
    such window of each of these places stand apart, as found, under a name of
    their own, so that not all rows of a frequent window meet in a task.
    """
    names = ["lead_hash", "n", "window", "m", "side", "id", "hash", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                cols = {n: part.column(n).to_pylist() for n in part.schema.names}
                for s in (0, 1):
                    own = np.array([i for i, x in enumerate(cols["side"]) if x == s], np.int64)
                    if not len(own):
                        continue
                    leads = np.array([int.from_bytes(hashlib.blake2b(bytes([s]) + cols["lead"][i], digest_size=8).digest(), "little", signed=True) for i in own])
                    rows, n, h = window_hashes(s, *(part.column(c).take(pa.array(own)) for c in ("lead", "far", "near")), length)
                    if not len(rows):
                        continue
                    order, start, size = _equal(mix(mix(h + n.astype(np.uint64)) + leads[rows].view(np.uint64)))
                    same = order[np.repeat(size > 1, size)]
                    least, most = np.full(len(own), length), np.full(len(own), -1)
                    np.minimum.at(least, rows[same], n[same])
                    np.maximum.at(most, rows[same], n[same])
                    hit = np.flatnonzero(most >= 0)
                    apart = mix(np.array([hash((cols["id"][i], cols["hash"][i], cols["place"][i])) for i in own[hit]], np.int64).view(np.uint64))
                    once = order[start]
                    of = np.concatenate([rows[once], hit, hit])
                    at = pa.array(own[of])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(leads[of]),
                            pa.array(np.concatenate([n[once], least[hit], most[hit]]).astype(np.int32)),
                            pa.array(np.concatenate([h[once], apart, apart]).view(np.int64)),
                            pa.array(np.concatenate([np.minimum(size, 2), np.full(2 * len(hit), 2)]).astype(np.int32)),
                            *(part.column(c).take(at) for c in ("side", "id", "hash", "place")),
                        ],
                        names=names,
                    )

    return run


def _cut(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                data = text.as_py().encode()
                runs: list[list[int]] = []
                for s in sorted((x["start"], x["stop"]) for x in spans or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                edges = [0, *(p for r in runs for p in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((None if doc == _ID else doc, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"), [{"start": a, "stop": b} for a, b in runs]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, spans`` for each row of ``docs``.

    Null and empty texts have no bytes.  Rows that repeat one another are
    occurrences of their own, so both lose what they have in common, as do
    overlapping occurrences in one text.  ``kept_text`` replaces what a cut
    leaves of a character; ``kept_sha256`` is of the exact bytes.  Null ids
    stay null.  Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(doc_col).cast("long"), F.lit(_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("hash", F.hash("text"))
    found = texts.mapInArrow(_places(length), "id long, hash int, place int, before int, after int, around long, key_after long, key_before long")
    classes = cut(found.groupBy("around").agg(F.count("*").cast("int").alias("n"), F.min(F.struct("id", "hash", "place")).alias("at"), F.first("key_after").alias("key_after"), F.first("key_before").alias("key_before")).select("around", "n", "at.*", "key_after", "key_before"))
    sides = classes.select("n", "id", "hash", "place", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("key_after").alias("key")), F.struct(F.lit(1).alias("side"), F.col("key_before").alias("key")))).alias("s")).select("n", "id", "hash", "place", "s.*").where("key is not null")
    shared = cut(sides.groupBy("side", "key").agg(F.count("*").alias("m"), F.min("n").alias("rarest")).where("m > 1 and rarest = 1").select("side", "key", (F.col("m") > CROWD).alias("crowded"), F.when(F.col("m") > CROWD, 1).otherwise(F.ceil(F.col("m") / PART)).cast("int").alias("parts")))
    wanted = cut(sides.drop("n").join(shared, ["side", "key"]).groupBy("id", "hash", "crowded").agg(F.collect_list(F.struct("place", "side", "parts")).alias("wanted")))

    def around(crowded: bool) -> DataFrame:
        own = wanted.where(F.col("crowded") == crowded).drop("crowded")
        return texts.join(own, ["id", "hash"]).mapInArrow(_surroundings(length), "side int, lead binary, part int, parts int, far binary, near binary, id long, hash int, place int")

    spans = "id long, hash int, place int, start int, stop int"
    ordered = around(False).repartitionByRange(width(spark), "side", "lead", "part").sortWithinPartitions("side", "lead", "part", "id", "hash", "place")
    matched = ordered.mapInArrow(_compare(length), spans)
    if not shared.where("crowded").isEmpty():
        windows = _dealt(around(True)).mapInArrow(_windows(length), "lead_hash long, n int, window long, m int, side int, id long, hash int, place int")
        windows = windows.withColumn("times", F.sum("m").over(Window.partitionBy("lead_hash", "n", "window")))
        crowded = windows.where("times > 1").groupBy("side", "id", "hash", "place").agg(F.min("n").alias("a"), F.max("n").alias("b"))
        crowded = crowded.select("id", "hash", "place", F.expr(f"if(side = 0, -b, a - {length})").alias("start"), F.expr(f"if(side = 0, {length} - a, b)").alias("stop"))
        matched = matched.unionByName(crowded)
    copies = found.select("around", "id", "hash", "place", (-F.col("before")).alias("start"), F.col("after").alias("stop")).join(classes.where("n > 1").select("around"), "around", "left_semi").drop("around")
    of_doc = matched.unionByName(copies).groupBy("id", "hash").agg(F.collect_list(F.struct((F.col("place") + F.col("start")).alias("start"), (F.col("place") + F.col("stop")).alias("stop"))).alias("spans"))
    return texts.join(of_doc, ["id", "hash"], "left").mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, spans array<struct<start:long,stop:long>>")
