"""Positions in a global or per-key order without one task that holds a key.

Rows are range-partitioned by the whole order (key, time, tie-breakers), so a key with most of the rows is cut
between its rows like any other stretch, also where all of them share one time.  A row's place in its partition and
the sizes of the partitions before give its global position; a key's least position, a partial aggregate, turns
that into the position within the key.  The numbered frame is written to the shared folder once, since partition
bounds must not move between the readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_LOCAL_BITS = 33   # monotonically_increasing_id(): partition number above, place in the partition below


def numbered(df: DataFrame, order, out: str = "_g") -> DataFrame:
    """Add ``out`` = 0-based position in the total order given by columns or sort expressions."""
    part = (df.repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("_m", F.monotonically_increasing_id()).checkpoint(eager=True))
    pid = F.shiftright("_m", _LOCAL_BITS)
    sizes = part.groupBy(pid.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition.
    offsets = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o"))
    return (part.withColumn("_p", pid).join(F.broadcast(offsets), "_p")
            .withColumn(out, F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
            .drop("_m", "_p", "_o"))


def sequence_index(df: DataFrame, key: str, ts: str, tiebreak=(), out: str = "_x",
                   with_count: str | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of the row within its key, ordered by (ts, *tiebreak).

    ``with_count`` additionally adds the key's row count under that name.
    """
    g = numbered(df, [F.col(c) for c in (key, ts, *tiebreak)])
    stats = g.groupBy(key).agg(F.min("_g").alias("_g0"), F.count(F.lit(1)).alias("_kn"))
    res = g.join(stats, key).withColumn(out, (F.col("_g") - F.col("_g0")).cast("long"))
    if with_count:
        res = res.withColumn(with_count, F.col("_kn"))
    return res.drop("_g", "_g0", "_kn")
