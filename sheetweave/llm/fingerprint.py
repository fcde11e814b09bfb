"""Lempel-Ziv phrase fingerprints.

A text's UTF-8 bytes are parsed from left to right into phrases, each the
shortest that hasn't come before (LZ78).  The phrases are hashed, and the least
hash under each of ``HASHES`` permutations makes the signature; the share of
equal places of two signatures estimates how many phrases the texts have in
common, which falls as one compresses the other less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import width
from .tokens import BYTE, Powers, mix, seeds

HASHES = 64
_XOR, _MUL = seeds(HASHES, 401), seeds(HASHES, 403) | np.uint64(1)
_ID = -(1 << 63)


def parse(data: bytes, start: int, phrases: set[bytes], stop: int) -> int:
    """Add the phrases of data[start:stop]; returns where the unfinished last one starts."""
    add = phrases.add
    end = start + 1
    while end <= stop:
        phrase = data[start:end]
        if phrase in phrases:
            end += 1
        else:
            add(phrase)
            start = end
            end += 1
    return start


def signature(phrases: set[bytes], rest: bytes = b"") -> np.ndarray:
    """16 bits of the least hash under each permutation; of no phrases, zeros."""
    whole = [*phrases, rest] if rest else list(phrases)
    if not whole:
        return np.zeros(HASHES, np.uint16)
    sizes = np.fromiter(map(len, whole), np.int64, len(whole))
    data = np.frombuffer(b"".join(whole), np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    up, down = Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * down[starts])
    out = np.full(HASHES, (1 << 64) - 1, np.uint64)
    for lo in range(0, len(h), 4096):
        np.minimum(out, ((h[None, lo : lo + 4096] ^ _XOR[:, None]) * _MUL[:, None]).min(1), out=out)
    return (mix(out) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def of_text(text: str) -> np.ndarray:
    data = text.encode()
    phrases: set[bytes] = set()
    return signature(phrases, data[parse(data, 0, phrases, len(data)) :])


def with_edit(text: str, head: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Signatures of ``text`` and of its edited text, parsed once where they agree, and the edited text.

    The edit replaces the last half of the code points by the first as many of ``head``.
    """
    half = len(text) // 2
    edited = text[: len(text) - half] + head[:half]
    data, other = text.encode(), edited.encode()
    shared = len(text[: len(text) - half].encode())
    phrases: set[bytes] = set()
    start = parse(data, 0, phrases, shared)
    own = set(phrases)
    mark = signature(own, data[parse(data, start, own, len(data)) :])
    return mark, signature(phrases, other[parse(other, start, phrases, len(other)) :]), edited


def _deal(splits: np.ndarray, last: int):
    """Buckets of descending ids.  splits: the first id of each bucket; the first text of a bucket also ends the one before it."""
    names = ["bucket", "extra", "id", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            bucket = len(splits) - np.searchsorted(splits[::-1], ids, "left") - 1
            bucket = np.maximum(bucket, 0)
            first = np.flatnonzero(np.isin(ids, splits))
            into = np.where(bucket[first] == 0, last, bucket[first] - 1)
            rows = pa.array(np.concatenate([np.arange(len(ids)), first]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([bucket, into]).astype(np.int32)), pa.array(np.concatenate([np.zeros(len(ids), np.int32), np.ones(len(first), np.int32)])), batch.column("id").take(rows), batch.column("text").take(rows)], names=names)

    return run


def _hex(mark: np.ndarray) -> str:
    return mark.astype(">u2").tobytes().hex()


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket after the other in descending order of id; a text is written once the next one has come."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    held: tuple | None = None  # bucket, id, text
    rows: list[tuple] = []
    waiting: tuple | None = None  # a row whose next text has no fingerprint yet

    def finish(mark):
        nonlocal waiting
        if waiting is not None:
            doc, n, sha, own, edited = waiting
            rows.append((None if doc == _ID else doc, n, sha, _hex(own), _hex(edited), likeness(own, edited), likeness(own, mark)))
            waiting = None

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("bucket", "extra", "id", "text")]
        for bucket, extra, doc, text in zip(*cols, strict=True):
            if held is not None and held[0] == bucket:
                mark, edited_mark, edited = with_edit(held[2], text)
                finish(mark)
                waiting = (held[1], len(held[2]), hashlib.sha256(edited.encode()).hexdigest(), mark, edited_mark)
                if extra:
                    finish(of_text(text))
                    held = None
                    continue
            held = None if extra else (bucket, doc, text)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows = []


def compare_to_next(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for each row.

    The next document has the next lower id, that of the lowest the highest; a
    null id is the lowest of all, and rows that share an id follow one another
    in order of their texts.  A null text is empty.  Two empty texts are alike
    (1.0), an empty and another one aren't.  Other columns are ignored.

    Splitters sampled from the ids deal the texts into buckets of neighbouring
    ids with one shuffle; each bucket also gets the first text of the next one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(doc_col).cast("long"), F.lit(_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = 4 * width(spark)
    # Ids that occur, so a bucket begins with its splitter; their number is that of the buckets.
    found = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n).alias("splits"), F.max("id").alias("top")).first()
    if found["top"] is None:
        splits = np.zeros(1, np.int64)
    else:
        splits = np.unique(np.array([*found["splits"], found["top"]], np.int64))[::-1].copy()
    dealt = rows.mapInArrow(_deal(splits, len(splits) - 1), "bucket int, extra int, id long, text string")
    return dealt.repartition(width(spark), "bucket").sortWithinPartitions("bucket", "extra", F.desc("id"), "text").mapInArrow(_follow, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
