"""States that the rows of a group change one after the other, over groups of any number and length.

Sorted partitions are read as streams, many groups in one call.  Groups of up to
``LONG`` rows stay whole.  Longer ones are dealt out by ranges of their order:
stretches of rows are summed up as functions of the state before them, the few
functions of a group are applied one after the other, and then each partition is
walked from its own state.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Rows of a group that is walked in one task, and of a stretch that is summed up.
LONG = 100_000


@dataclass(frozen=True)
class Walk:
    #: The state before a group's first row.
    start: Any
    #: From numbers and the state before them what each row is, and the state after them.
    step: Callable[[list[float], Any], tuple[list, Any]]
    #: From numbers the values of their function.
    summed_up: Callable[[list[float]], tuple]
    #: From a state and a function's values the state after them.
    applied: Callable[..., Any]
    #: A function's values: name, type in Spark, type in Arrow.
    function: list[tuple[str, str, pa.DataType]]


def _same(a: tuple, b: tuple) -> bool:
    return a == b or all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))


def groups(batch: pa.RecordBatch, by: list[str]) -> list[tuple[tuple, int, int]]:
    """The keys of a sorted batch, each with its rows from and to."""
    keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
    at = [i for i in range(len(keys)) if i == 0 or not _same(keys[i], keys[i - 1])]
    return [(keys[a], a, b) for a, b in zip(at, [*at[1:], len(keys)], strict=True)]


def _walker(by: list[str], x: str, walk: Walk, emit: Callable, before: dict[int, Any]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, number = None, walk.start, None
        for batch in batches:
            if not batch.num_rows:
                continue
            told: list = []
            numbers = batch.column(x).to_pylist()
            split = groups(batch, by)
            if number is None:
                part = batch.column("_part")[0].as_py()
                number = part << 32
                key, state = split[0][0], before.get(part, walk.start)
            for own, a, b in split:
                if not _same(key, own):
                    key, state = own, walk.start
                out, state = walk.step(numbers[a:b], state)
                told += out
            yield emit(batch, told, number)
            number += 1

    return run


def _functions(by: list[str], x: str, walk: Walk, long: int):
    """Functions of the stretches of each group in a partition; number 0 is the first of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, numbers, part, seq = None, [], [], 0, 0

        def told(xs: list[float]) -> pa.RecordBatch:
            values = [pa.array([v], t) for v, (_, _, t) in zip(walk.summed_up(xs), walk.function, strict=True)]
            return pa.RecordBatch.from_arrays([*own, pa.array([part], pa.int32()), pa.array([seq], pa.int64()), *values], names=[*by, "_part", "_seq", *(n for n, _, _ in walk.function)])

        for batch in batches:
            xs = batch.column(x).to_pylist()
            for k, a, b in groups(batch, by):
                if key is None or not _same(key, k):
                    if numbers:
                        yield told(numbers)
                        seq += 1
                    key, numbers, own, part = k, [], [batch.column(c).slice(a, 1) for c in by], batch.column("_part")[0].as_py()
                numbers += xs[a:b]
                while len(numbers) > long:
                    yield told(numbers[:long])
                    numbers, seq = numbers[long:], seq + 1
        if numbers:
            yield told(numbers)

    return run


def _handed_on(by: list[str], walk: Walk):
    """The state before each partition's first stretch, from functions in the order of their groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, walk.start
        for batch in batches:
            cols = [batch.column(n).to_pylist() for n, _, _ in walk.function]
            part, seq = batch.column("_part").to_pylist(), batch.column("_seq").to_pylist()
            out: list[tuple] = []
            for k, a, b in groups(batch, by):
                if key is None or not _same(key, k):
                    key, state = k, walk.start
                for i in range(a, b):
                    if seq[i] == 0:
                        out.append((part[i], pickle.dumps(state)))
                    state = walk.applied(state, *(c[i] for c in cols))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([s for _, s in out], pa.binary())], names=["_part", "state"])

    return run


def walked_in_order(rows: DataFrame, by: list[str], order: list[str], x: str, walk: Walk, emit: Callable[[pa.RecordBatch, list, int], pa.RecordBatch], schema: str, *, long: int = LONG) -> DataFrame:
    """What ``emit`` makes of each batch of ``rows``, sorted by ``by, order``, and of what its rows are.

    ``emit`` also gets the batch's number, which rises along a group.  The keys
    of long groups, one of ``long`` rows at most, are broadcast; of their
    partitions one state each comes to the driver.
    """
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > long)
    large = checkpointed(sizes.select(*(F.col(c).alias(f"_of_{c}") for c in by), "_n"))

    def in_parts(some: DataFrame) -> DataFrame:
        return some.sortWithinPartitions(*by, *order).withColumn("_part", F.spark_partition_id())

    every = large.isEmpty()
    short = rows if every else rows.join(F.broadcast(large), same, "left_anti")
    found = in_parts(short.repartition(*by) if by else short.repartition(1)).mapInArrow(_walker(by, x, walk, emit, {}), schema)
    if every:
        return found
    parts = checkpointed(in_parts(rows.join(F.broadcast(large), same, "left_semi").repartitionByRange(*by, *order)))
    kinds = dict(parts.dtypes)
    lead = "".join(f"`{c}` {kinds[c]}, " for c in by)
    told = parts.mapInArrow(_functions(by, x, walk, long), f"{lead}_part int, _seq long, " + ", ".join(f"{n} {t}" for n, t, _ in walk.function))
    told = (told.repartition(*by) if by else told.repartition(1)).sortWithinPartitions(*by, "_part", "_seq")
    before = {r["_part"]: pickle.loads(r["state"]) for r in told.mapInArrow(_handed_on(by, walk), "_part int, state binary").collect()}
    return found.unionByName(parts.mapInArrow(_walker(by, x, walk, emit, before), schema))
