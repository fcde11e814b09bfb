"""Key labels by indentation, as a scan of transition functions.

What a row means depends on the indent of the parent that is open, which the
rows before it decide.  A row maps that state to the next one, and so does a
strip of rows: as a function of the state before it, a strip gives the state
unchanged, or a constant that depends on the first row the state meets.  So long
groups can be walked in parts (``walk``).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .walk import LONG, Walk, walked_in_order

# How far a parent may stand right of the one before, and how far in a child begins.
SLACK, INDENT = 3.0, 4.0
NONE = float("nan")


def summed_up(x: list[float]) -> tuple[float, list[float], list[float], list[float]]:
    """A strip as a function: its state after no parent, and rows of falling indent with the states after.

    An open parent first meets the first of these rows that isn't too far right
    of it.  If the row is the next parent the strip ends in the second list's
    state, if it is a footer in the third's.  A parent that meets none stays.
    """
    n = len(x)
    final = [NONE] * (n + 1)  # the state at the end if row i becomes a parent; after the last row, that there is none
    at: list[int] = []  # rows to the right that are lower than all between, the nearest last
    low: list[float] = []
    for i in range(n - 1, -1, -1):
        k = bisect_right(low, x[i] + SLACK) - 1
        if k < 0:
            final[i] = x[i]
        else:
            j = at[k]
            final[i] = final[j + 1] if x[j] < x[i] - SLACK else final[j]
        while low and low[-1] >= x[i]:
            low.pop()
            at.pop()
        low.append(x[i])
        at.append(i)
    first, record = [], float("inf")
    for i, v in enumerate(x):
        if v < record:
            first.append(i)
            record = v
    return final[0], [x[i] for i in first], [final[i] for i in first], [final[i + 1] for i in first]


def applied(state: float, none: float, falling: list[float], parent: list[float], footer: list[float]) -> float:
    if state != state:
        return none
    k = bisect_left(falling, -state - SLACK, key=lambda v: -v)
    if k == len(falling):
        return state
    return footer[k] if falling[k] < state - SLACK else parent[k]


def stepped(x: list[float], state: float) -> tuple[list[str], float]:
    """What each row is, from the state before the first, and the state after the last."""
    out = []
    for v in x:
        if state == state and v < state - SLACK:
            state = NONE
            out.append("footer")
        elif state != state or v <= state + SLACK:
            state = v
            out.append("parent")
        else:
            out.append("child" if v >= state + INDENT else "")
    return out, state


def walked(x: list[float], state: float) -> list[str]:
    return stepped(x, state)[0]


_NUMBERS = ("array<double>", pa.list_(pa.float64()))
WALK = Walk(NONE, stepped, summed_up, applied, [("none", "double", pa.float64()), ("falling", *_NUMBERS), ("parent", *_NUMBERS), ("footer", *_NUMBERS)])


def indent_roles(rows: DataFrame, by: list[str], order: str, label: str, x: str, width: int = LONG) -> DataFrame:
    """``by, order, label, role`` of the rows with a label and an indent: ``parent``, ``child``, ``footer`` or empty.

    A row further left than the open parent ends it as a footer.  Without an
    open parent, or about as far left, a row is the next parent; one further in
    is a child.  Rows without a label or a number are passed over.
    """
    kept = rows.select(*by, F.col(order).alias("_order"), F.trim(label).alias("label"), F.col(x).cast("double").alias("_x")).where("label != '' and _x is not null and not isnan(_x)")
    kinds = dict(kept.dtypes)
    own = "".join(f"{c} {kinds[c]}, " for c in by)

    def emit(batch: pa.RecordBatch, roles: list[str], _: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*by, "_order", "label")), pa.array(roles, pa.string())], names=[*by, "_order", "label", "role"])

    roles = walked_in_order(kept, by, ["_order", "_x", "label"], "_x", WALK, emit, f"{own}_order {kinds['_order']}, label string, role string", long=width)
    return roles.withColumnRenamed("_order", order)


def indent_labels(rows: DataFrame, by: list[str], order: str, label: str, x: str, width: int = LONG) -> DataFrame:
    """``by, label, first``: labels of children, with the first row they stand in."""
    return indent_roles(rows, by, order, label, x, width).where("role = 'child'").groupBy(*by, "label").agg(F.min(order).alias("first"))
