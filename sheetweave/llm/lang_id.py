"""Language identification with bit-sliced Bloom filters of byte n-grams.

Every position of the filter holds a bit for each language, so that one look-up
of an n-gram, the AND of its positions, gives all languages that contain it.  A
text's bits are counted by language, the counts are freed of the filter's
expected false positives, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import cut
from .sampling import held_out
from .tokens import LOWER, chunks, mix

GRAM = 4
#: Filter positions for each language (their sum is rounded up to a power of two), hash functions, and bits of a hash each may use.
POSITIONS, HASHES, BITS = 1 << 18, 3, 26
#: Languages that a filter can hold: 128 take 1 << 25 positions of 16 bytes.
LANGUAGES = 128
#: N-grams that a task counts before it hands them on.
HELD = 2_000_000
#: N-grams that the filter holds for each language, at most, the most frequent first; n-grams that are rarer are left out.
GRAMS, RARE = 37_500, 5
#: An n-gram belongs to a language where its rate is at least this share of its highest rate in any language.
SHARE = 0.25
UNKNOWN = "und"
#: Steps of a rate of hits that are told apart.
RATES = 10_000


@dataclass
class Model:
    """languages[i] has bit i % 8 of byte i // 8 at every position."""

    languages: list[str]
    filter: np.ndarray
    false_rate: np.ndarray


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of lower-cased texts with a space at either end, and the range of each text's."""
    n = len(at) - 1
    padded = np.insert(LOWER[data], np.repeat(at, [1, *[2] * (n - 1), 1]) if n else [], 32)
    start = at[:-1] + 2 * np.arange(n)
    stop = at[1:] + 2 * np.arange(1, n + 1)
    if len(padded) < GRAM:
        return np.zeros(0, np.uint32), start * 0, start * 0
    wide = padded.astype(np.uint32)
    joined = sum((wide[j : len(wide) - GRAM + 1 + j] << np.uint32(8 * j) for j in range(GRAM)), np.uint32(0))
    return joined, np.minimum(start, len(joined)), np.minimum(np.maximum(start, stop - GRAM + 1), len(joined))


def slots(gram: np.ndarray, positions: int) -> list[np.ndarray]:
    """The positions of each n-gram, one for each hash function."""
    first, second = mix(gram.astype(np.uint64) + np.uint64(0x51ED270B)), mix(gram.astype(np.uint64) + np.uint64(0x2F0B4C47))
    parts = [first, first >> np.uint64(64 - BITS), second]
    return [(h & np.uint64(positions - 1)).astype(np.int64) for h in parts[:HASHES]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, n-gram), merged as long as they fit."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for name, (values, n) in held.items():
            for lo in range(0, len(values), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values[lo : lo + 100_000]), pa.string()), pa.array(values[lo : lo + 100_000].astype(np.int64)), pa.array(n[lo : lo + 100_000])], names=["lang", "gram", "n"])

    for batch in batches:
        names = np.array(batch.column("lang").to_pylist(), object)
        for lo, hi, data, at in chunks(batch.column("text")):
            gram, start, stop = grams(data, at)
            for name in sorted(set(names[lo:hi])):
                own = np.flatnonzero(names[lo:hi] == name)
                values, n = np.unique(np.concatenate([gram[start[i] : stop[i]] for i in own]), return_counts=True)
                if name in held:
                    known, before = held[name]
                    values, at_value = np.unique(np.concatenate([known, values]), return_inverse=True)
                    n = np.bincount(at_value, np.concatenate([before, n]), len(values)).astype(np.int64)
                held[name] = values, n
            if sum(len(v) for v, _ in held.values()) > HELD:
                yield from told()
                held = {}
    yield from told()


def train(labelled: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A filter from all texts of each language; what comes to the driver is at most ``GRAMS`` n-grams a language.

    Rows with a null id, text or language aren't learned from.  Repeated rows
    count each.
    """
    rows = labelled.select(F.col(doc_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and doc_id is not null and text is not null")
    counted = cut(rows.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros((POSITIONS, 1), np.uint8), np.zeros(0))
    if len(languages) > LANGUAGES:
        raise ValueError(f"{len(languages)} languages; a filter holds {LANGUAGES}")
    positions = 1 << (POSITIONS * len(languages) - 1).bit_length()
    rates = F.create_map(*(x for name in languages for x in (F.lit(name), F.lit(1.0 / totals[name]))))
    rated = counted.withColumn("rate", F.col("n") * rates[F.col("lang")])
    best = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.sum("n").alias("all"), F.collect_list(F.struct("lang", "rate")).alias("each")).where(F.col("all") >= RARE)
    kept = best.orderBy(F.desc("top"), "gram").limit(GRAMS * len(languages)).select("gram", F.transform(F.filter("each", lambda e: e["rate"] >= SHARE * F.col("top")), lambda e: e["lang"]).alias("langs")).collect()
    bits = np.zeros((positions, -(-len(languages) // 8)), np.uint8)
    number = {name: i for i, name in enumerate(languages)}
    for s in slots(np.array([r["gram"] for r in kept], np.uint64), positions):
        for i, name in enumerate(languages):
            own = s[[name in r["langs"] for r in kept]]
            bits[own, number[name] // 8] |= np.uint8(1 << (i % 8))
    share = np.array([((bits[:, i // 8] >> (i % 8)) & 1).mean() for i in range(len(languages))])
    return Model(languages, bits, share**HASHES)


def _predict(model):
    names = ["row", "held_out", "lang_pred", "score", "hits", "n_grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*model.value)
        letters = np.zeros(256, bool)
        letters[65:91] = letters[97:123] = True
        for batch in batches:
            texts = batch.column("text")
            for lo, hi, data, at in chunks(texts):
                gram, start, stop = grams(data, at)
                n = np.maximum(stop - start, 1)
                counts = np.zeros((hi - lo, max(1, len(m.languages))))
                if m.languages and len(gram):
                    a, b, c = (m.filter[s] for s in slots(gram, len(m.filter)))
                    bits = a & b & c
                    for i in range(len(m.languages)):
                        upto = np.zeros(len(gram) + 1, np.int64)
                        np.cumsum((bits[:, i // 8] >> np.uint8(i % 8)) & 1, out=upto[1:])
                        counts[:, i] = np.maximum(0, (upto[stop] - upto[start] - n * m.false_rate[i]) / (1 - m.false_rate[i]))
                total = counts.sum(1)
                first = counts.argmax(1)
                score = np.where(total > 0, counts[np.arange(hi - lo), first] / np.maximum(total, 1e-9), 0.0)
                seen = np.zeros(len(data) + 1, np.int64)
                np.cumsum(letters[data], out=seen[1:])
                spoken = seen[at[1:]] > seen[at[:-1]]
                for i in np.flatnonzero(~spoken & (np.diff(at) > 0)):
                    spoken[i] = any(ch.isalpha() for ch in texts[lo + int(i)].as_py())
                spoken &= bool(m.languages)
                pred = [m.languages[k] if ok else UNKNOWN for k, ok in zip(first, spoken, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row")[lo:hi], batch.column("held_out")[lo:hi], pa.array(pred, pa.string()), pa.array(np.where(spoken, score, 0.0)), pa.array(counts[np.arange(hi - lo), first]), pa.array((stop - start).astype(np.int64))], names=names)

    return run


def predict(docs: DataFrame, model: Model, *, doc_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, hits, n_grams`` for each row; only the text decides.

    ``und`` with score 0 where the text is null or has no letter, or where no
    language was learned.  The score is the winner's share of all corrected
    counts, ``hits`` its corrected count among the text's ``n_grams``.  Ties go to
    the first language in order of name.  Repeated rows are predicted each, and
    texts of any length as a whole.  With ``keep``, the struct ``row`` of those
    columns takes the place of ``doc_id``.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.filter, model.false_rate))
    row = F.struct(*(F.col(f"`{c}`") for c in keep or [doc_col]))
    rows = docs.select(row.alias("row"), held_out(F.col(doc_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    judged = rows.mapInArrow(_predict(shared), f"row {rows.schema['row'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, hits double, n_grams long")
    return judged if keep else judged.select(F.col(f"row.`{doc_col}`").alias("doc_id"), "held_out", "lang_pred", "score", "hits", "n_grams")


def usual_rates(labelled: DataFrame, model: Model, *, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, float]:
    """For each language, the share of hits among n-grams that 99 of 100 of its texts have, to four decimals rounded down.

    All texts count that the model gives their own language; of texts and ids
    that are repeated each row does.  What comes to the driver is one number a
    language, from counts by rate.
    """
    rows = labelled.select(F.col(doc_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and doc_id is not null and text is not null")
    judged = predict(rows, model, keep=["doc_id", "lang"]).where("n_grams > 0 and row.lang = lang_pred")
    rated = judged.groupBy("lang_pred", F.floor(F.col("hits") / F.col("n_grams") * RATES).cast("long").alias("rate")).agg(F.count("*").alias("n"))
    upto = W.partitionBy("lang_pred").orderBy("rate")
    placed = rated.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(W.partitionBy("lang_pred")))
    found = placed.where(F.col("upto") * 100 >= F.col("all")).groupBy("lang_pred").agg(F.min("rate").alias("rate")).collect()
    return {r["lang_pred"]: r["rate"] / RATES for r in found}


def fluent(hits, n_grams, rate):
    """Whether a text has as many hits as a text of its language can be expected to: half the usual rate, less two standard errors."""
    return hits >= rate / 2 * n_grams - 2 * F.sqrt(n_grams)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs`` that aren't held out and predict them all."""
    return predict(docs, train(docs.where(~held_out(F.col("doc_id")))))
