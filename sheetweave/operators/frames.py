"""Window frames that leave out the current row or its peers."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def sum_and_count(value: Column, frame: WindowSpec, peers: WindowSpec, exclude: str) -> tuple[Column, Column]:
    """Sum and count of ``value`` over a frame without some of its rows.

    ``exclude`` is ``current row``, ``group`` (the current row and those that
    order the same) or ``ties`` (those without the current row).  What is left
    out is taken off, so the frame must hold the current row and, but for
    ``current row``, all of its peers, as RANGE and GROUPS frames about it do;
    ``peers`` is the window of a row's peers.  A sum of nothing is null.
    """
    mine, n_mine = F.coalesce(value, F.lit(0)), F.when(value.isNotNull(), 1).otherwise(0)
    own, n_own = F.coalesce(F.sum(value).over(peers), F.lit(0)), F.count(value).over(peers)
    off = {"current row": (mine, n_mine), "group": (own, n_own), "ties": (own - mine, n_own - n_mine)}[exclude]
    n = F.count(value).over(frame) - off[1]
    return F.when(n > 0, F.sum(value).over(frame) - off[0]), n
