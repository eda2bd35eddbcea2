"""The small side of a join, broadcast if a count says so.

A frame that other frames are derived from has no size that the optimizer could know, so a join with it may sort and
shuffle the large side by a few keys.  Here its rows are written once and counted; up to ``ROWS`` of them are broadcast.
More are joined as the optimizer likes, so the bound holds whatever the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 100_000


def small_side(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df``, written once, with the hint to broadcast it if it has no more than ``rows`` rows."""
    return small_written(df.checkpoint(eager=True), rows)


def small_written(kept: DataFrame, rows: int = ROWS) -> DataFrame:
    """The same for a frame that is written already."""
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept
