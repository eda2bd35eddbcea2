"""#63-65: average-tie ranks and per-item rolling statistics.

``average_rank`` never funnels the frame through one partition: ties are first
collapsed by a ``groupBy(value).count()`` (map-side combined, so a value held by
a third of the rows is one partial row per task), the distinct values are
range-partitioned, prefix counts are taken inside each partition plus a tiny
table of partition offsets, and the ranks are joined back on the value.
Where the rows already lie by a column (``place``), the ranks go back to the rows' places and the rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import sequence_index


def average_rank(df: DataFrame, value: str, out: str, descending: bool = True,
                 pct_out: str | None = None, place: str | None = None) -> DataFrame:
    """pandas ``rank(method='average')`` as a column (nulls get a null rank).

    ``pct_out`` also adds ``rank(pct=True) * 100`` in the opposite direction
    (ascending when ``descending``), i.e. ``(n + 1 - rank) / n * 100``.
    ``place`` names a column without nulls by which wide rows are partitioned: a join on it and the value moves the ranks
    only, if ``spark.sql.requireAllClusterKeysForCoPartition`` is off.  Without ``place`` the join moves the rows.
    """
    v = F.col(value)
    if place:
        ranks, total = _placed_ranks(df, value, out, descending, place)
        got = df.join(ranks, (F.col(place) == F.col("_rp")) & (v == F.col("_rv")), "left").drop("_rp", "_rv")
        return got.withColumn(pct_out, (F.lit(total) + 1 - F.col(out)) / F.lit(total) * 100) if pct_out else got
    vals = df.filter(v.isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_cnt"))
    order = v.desc() if descending else v.asc()
    # Distinct values in range partitions, written once; a partition's rows before it are its offset.
    part = vals.repartitionByRange(order).withColumn("_b", F.spark_partition_id()).checkpoint(eager=True)
    totals = part.groupBy("_b").agg(F.sum("_cnt").alias("_bn"))
    offs = totals.select(
        "_b", (F.sum("_bn").over(Window.orderBy("_b")) - F.col("_bn")).alias("_off"),
        F.sum("_bn").over(Window.partitionBy()).alias("_total"))
    within = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = part.withColumn("_before", F.coalesce(F.sum("_cnt").over(within), F.lit(0)))
    rank = (F.col("_off") + F.col("_before") + (F.col("_cnt") + 1) / 2).cast("double")
    cols = [F.col(value).alias("_rv"), rank.alias(out)]
    if pct_out:
        cols.append(((F.col("_total") + 1 - rank) / F.col("_total") * 100).alias(pct_out))
    # offs has one row per partition: a bounded broadcast.
    ranks = before.join(F.broadcast(offs), "_b").select(*cols)
    return df.join(ranks, v == F.col("_rv"), "left").drop("_rv")


def _placed_ranks(df: DataFrame, value: str, out: str, descending: bool, place: str) -> tuple[DataFrame, int]:
    """(_rp, _rv, out) for each place and numeric value of the rows, and the number of ranked rows.

    Places and values are range-partitioned by (value, place), so a value of many places is cut like any other stretch, and
    written once.  A first pass takes each partition's rows and those of its first and last value; these edges, one row a
    partition, are all that a partition needs of the others.  A second pass ranks in place.
    """
    order = [F.col(value).desc() if descending else F.col(value).asc(), F.col(place)]
    # The sample for the ranges reads finished rows behind a shuffle, which Spark would leave out without a filter between.
    pairs = df.filter(F.col(value).isNotNull()).select(place, (F.col(value) + F.lit(0)).alias(value))     # no negative zero
    part = (pairs.repartition(place, value).withColumn("_from", F.spark_partition_id()).where("_from >= 0").drop("_from")
            .repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("_p", F.spark_partition_id()).checkpoint(eager=True))

    def key_of(v: np.ndarray) -> np.ndarray:      # equal bits for equal doubles
        return np.where(np.isnan(v), np.nan, v).view(np.int64) if v.dtype == np.float64 else v.astype(np.int64)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, n, first, n_first, last, n_last = None, 0, 0, 0, 0, 0
        for b in batches:
            if b.num_rows:
                k = key_of(b.column(value).to_numpy())
                if p is None:
                    p, first = b.column("_p")[0].as_py(), int(k[0])
                n, n_first = n + len(k), n_first + int((k == first).sum())
                last, n_last = int(k[-1]), (n_last if last == k[-1] else 0) + int((k == k[-1]).sum())
        if p is not None:
            yield pa.RecordBatch.from_pydict({"p": pa.array([p], pa.int32())} | {x: pa.array([y], pa.int64()) for x, y in (
                ("n", n), ("first", first), ("n_first", n_first), ("last", last), ("n_last", n_last))})

    found = part.select(value, "_p").mapInArrow(ends, "p int, n long, first long, n_first long, last long, n_last long").collect()
    known: dict[int, list[int]] = {}               # of a value at an end: the rows before it, and its own
    offsets, total = {}, 0
    for r in sorted(found, key=lambda r: r["p"]):
        offsets[r["p"]] = total
        known.setdefault(r["first"], [total, 0])[1] += r["n_first"]
        if r["last"] != r["first"]:
            known[r["last"]] = [total + r["n"] - r["n_last"], r["n_last"]]
        total += r["n"]
    sent = df.sparkSession.sparkContext.broadcast({r["p"]: (offsets[r["p"]], {k: known[k] for k in (r["first"], r["last"])}) for r in found})

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, edges, held, done = None, {}, None, None
        for b in batches:
            if not b.num_rows:
                continue
            if before is None:
                before, edges = sent.value[b.column("_p")[0].as_py()]
            t = pa.Table.from_batches([b])
            t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
            v, at = t.column(value).to_numpy(), t.column(place).combine_chunks()
            k = key_of(v)
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            if int(k[-1]) in edges:
                held, n = None, len(k)
            else:                                   # the next batch may have more of the last value
                held, n = t.slice(starts[-1]), starts[-1]
                starts = starts[:-1]
            if not n:
                continue
            lengths = np.diff(np.append(starts, n))
            own, above = lengths.copy(), before + np.cumsum(lengths) - lengths
            before += n
            for i in {0, len(starts) - 1}:
                if (edge := edges.get(int(k[starts[i]]))):
                    above[i], own[i] = edge
            rank = np.repeat(above + (own + 1) / 2, lengths)
            # A place's rows of one value stand together; the first of them goes back.
            one = np.ones(n, bool)
            one[1:] = (k[1:n] != k[:n - 1]) | pc.not_equal(at.slice(1, n - 1), at.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            if done == (k[0], at[0].as_py()):
                one[0] = False
            done = (k[n - 1], at[n - 1].as_py())
            yield pa.RecordBatch.from_arrays([at.slice(0, n).filter(pa.array(one)), pa.array(v[:n][one]), pa.array(rank[one])], ["_rp", "_rv", out])

    kinds = dict(df.dtypes)
    return part.mapInArrow(ranked, f"_rp {kinds[place]}, _rv {kinds[value]}, `{out}` double"), total


def rolling_means(history: DataFrame, ts: str = "ts", value: str = "profit",
                  short: int = 3, long: int = 6, tiebreak=()) -> DataFrame:
    """#64: trailing means over the last ``short`` / ``long`` rows per item (min_periods=1).

    Rows are cut into range partitions of (item, time), so a hot item is cut like any other stretch.  A first pass
    takes the last ``long - 1`` rows of each partition; these edge rows, a few a partition, are what a partition needs
    of those before it.  A second pass computes both means in place: the table is shuffled once, and nothing is copied.
    """
    order = ["item_id", ts, *tiebreak]
    part = (history.repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("_p", F.spark_partition_id()).checkpoint(eager=True))
    edge = long - 1
    key_type = dict(history.dtypes)["item_id"]

    def narrow(b: pa.RecordBatch) -> pa.Table:
        return pa.table([b.column("item_id"), b.column(value).cast(pa.float64())], ["key", "v"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, p = None, 0
        for b in batches:
            if b.num_rows:
                p = b.column("_p")[0].as_py()
                held = narrow(b) if held is None else pa.concat_tables([held, narrow(b)])
                held = held.slice(max(0, held.num_rows - edge)).combine_chunks()
        if held is not None:
            n = held.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([p] * n, pa.int32()), pa.array(range(n), pa.int32()), *(
                held.column(c).combine_chunks() for c in ("key", "v"))], ["p", "i", "key", "v"])

    edges = part.select("_p", "item_id", value).mapInArrow(last, f"p int, i int, key {key_type}, v double")
    before: list[tuple] = []
    carry: dict[int, list[tuple]] = {}
    for p, own in groupby(sorted((tuple(r) for r in edges.collect()), key=lambda r: r[:2]), key=lambda r: r[0]):
        carry[p] = before
        before = [*before, *((r[2], r[3]) for r in own)][-edge:] if edge else []
    sent = history.sparkSession.sparkContext.broadcast(carry)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            now = narrow(b)
            if held is None:
                rows = sent.value[b.column("_p")[0].as_py()]
                held = pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(now.schema.types)], ["key", "v"])
            t = pa.concat_tables([held, now]).combine_chunks()
            key = pc.dictionary_encode(t.column("key").combine_chunks(), null_encoding="encode").indices.to_numpy()
            there = t.column("v").is_valid().to_numpy()
            v = np.where(there, t.column("v").fill_null(0.0).to_numpy(), 0.0)
            skip, out = held.num_rows, []
            total, count = np.zeros(len(v)), np.zeros(len(v), np.int64)
            for lag in range(long):
                same = (key[lag:] == key[:len(key) - lag]) & there[:len(v) - lag]
                total[lag:] += np.where(same, v[:len(v) - lag], 0.0)
                count[lag:] += same
                if lag + 1 in (short, long):
                    with np.errstate(invalid="ignore"):
                        out.append(pa.array((total / count)[skip:], mask=(count == 0)[skip:]))
            held = t.slice(max(0, t.num_rows - edge))
            rest = [(n, b.column(n)) for n in b.schema.names if n != "_p"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), *out], [*(n for n, _ in rest), "sma_short", "sma_long"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in history.schema.fields)
    return part.mapInArrow(means, f"{fields}, sma_short double, sma_long double")


def recent_direction(history: DataFrame, ts: str = "ts", value: str = "profit", n: int = 5,
                     tiebreak=()) -> DataFrame:
    """#65: mean of successive differences over the last ``n`` points, and their mean.

    The mean of the diffs telescopes to (last - first) / (k - 1).  The last
    ``n`` rows are those whose position is >= count - n (skew-safe index).
    """
    return direction_of(sequence_index(history, "item_id", ts, tiebreak, out="_x", with_count="_n"), value, n)


def direction_of(idx: DataFrame, value: str = "profit", n: int = 5) -> DataFrame:
    """#65 on rows that carry their position ``_x`` and their item's count ``_n``."""
    last = idx.filter(F.col("_x") >= F.col("_n") - n)
    agg = last.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("_k"),
        F.min_by(value, "_x").alias("_first"), F.max_by(value, "_x").alias("_last"),
        F.avg(value).alias("recent_avg"))
    diff = F.when(F.col("_k") > 1, (F.col("_last") - F.col("_first")) / (F.col("_k") - 1)).otherwise(F.lit(0.0))
    return agg.select("item_id", diff.alias("recent_trend"),
                      F.when(diff > 0, "increasing").when(diff < 0, "decreasing").otherwise("stable")
                      .alias("trend"), "recent_avg")
