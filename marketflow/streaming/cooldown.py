"""#88, #93 as a stateful operator: cooldowns of rules over a stream of polls, without rewritten rule tables.

Matches of a micro-batch are cut down to the first of each rule and poll where they stand (those of rules over all items
by record highs, without a pair of rule and item), and meet by rule in a
``transformWithState`` operator.  A rule's state is the time of its last firing; an event-time timer clears it once the
cooldown has passed under the watermark, so rules that are quiet hold none.  Rules without a cooldown need no state.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import alerts as AL
from ..operators import learned as L
from ..sources import store as ST

_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_FIELDS = ("alert_id", "alert_type", "priority", "item_id", "item_name", "profit", "roi", "message")
_OUT = "alert_id string, alert_type string, priority string, item_id string, item_name string, profit double, roi double, message string, t long"

_ROW = "_ets timestamp, " + _OUT + ", before long, gap long, place string"


class Cooldown(StatefulProcessor):
    """Keeps the polls of a rule that lie later than its last firing plus its cooldown."""

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        polls: dict[int, tuple] = {}       # the first match of each poll of the batch
        gap, last = 0, None
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                gap = int(r.gap)
                if not pd.isna(r.before):
                    last = max(int(r.before), last) if last is not None else int(r.before)
                if r.t not in polls or r.place < polls[r.t].place:
                    polls[r.t] = r
        if self.last.exists():
            held = int(self.last.get()[0])
            last = held if last is None else max(held, last)
        kept = []
        for t in sorted(polls):
            if last is None or t > last + gap:
                kept.append(polls[t])
                last = int(t)
        if kept:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.last.update((last,))
            self.handle.registerTimer(max((last + gap) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        cols = {c: pd.Series([getattr(r, c) for r in kept], dtype="float64" if c in ("profit", "roi") else object) for c in _FIELDS}
        yield pd.DataFrame({**cols, "t": pd.Series([int(r.t) for r in kept], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({**{c: pd.Series([], dtype="float64" if c in ("profit", "roi") else object) for c in _FIELDS}, "t": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def _place(df: DataFrame, seq) -> Column:
    """A text that sorts like (seq, item_id): numbers are padded, so a poll's first match is its least."""
    kinds = dict(df.dtypes)
    parts = [F.lpad(F.format_string("%d", F.coalesce(F.col(c).cast("long"), F.lit(0)) + F.lit(1 << 62)), 20, "0")
             if kinds[c] in ("tinyint", "smallint", "int", "bigint") else F.coalesce(F.col(c).cast("string"), F.lit(""))
             for c in seq if c in df.columns]
    return F.concat_ws("\x01", *parts, F.coalesce(F.col("item_id").cast("string"), F.lit("")))


def _of_all_items(held: DataFrame, rules: DataFrame, ts: str, seq) -> DataFrame:
    """First matches, in each part of a poll, of the rules over all items: by record highs, without pairs of rule and item.

    The rules are read when the stream starts; a task holds their thresholds, and sends a row for each rule and poll
    that match at most.
    """
    asked = AL.thresholds(rules).select(
        "r_id", "r_alert_type", "r_priority", "r_message", "k", "v", F.unix_micros(F.col("r_last_triggered").cast("timestamp")).alias("before"),
        (F.col("r_cooldown_minutes") * F.lit(60_000_000).cast("long")).alias("gap")).orderBy("k", "r_id").collect()
    measures = [m.cast("double").alias(f"m{k}") for k, m in enumerate(AL.measures(held))]
    by = {k: [r for r in asked if r["k"] == k] for k in range(len(measures))}
    least = {k: np.array([r["v"] for r in rs]) for k, rs in by.items()}
    rows = held.select("_ets", F.col("item_id").cast("string").alias("item_id"), F.col("name").cast("string").alias("name"),
                       F.col("profit").cast("double").alias("profit"), F.col("roi").cast("double").alias("roi"),
                       F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), _place(held, seq).alias("place"), *measures)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t, poll in pdf.sort_values("place", kind="stable").groupby("t"):
                for k, rs in by.items():
                    top = np.maximum.accumulate(poll[f"m{k}"].to_numpy(float))
                    record = np.flatnonzero(np.concatenate([[True], top[1:] > top[:-1]]))
                    at = np.searchsorted(top[record], least[k], side="left")
                    hit = np.flatnonzero(at < len(record))
                    if not len(hit):
                        continue
                    rows, mine = poll.iloc[record[at[hit]]], [rs[i] for i in hit]
                    text = lambda c, rows=rows: [None if pd.isna(v) else v for v in rows[c]]
                    named = ["None" if n is None else n for n in text("name")]
                    cols = {"_ets": rows["_ets"].to_numpy(), "alert_id": [r["r_id"] for r in mine], "alert_type": [r["r_alert_type"] for r in mine],
                            "priority": [r["r_priority"] for r in mine], "item_id": text("item_id"), "item_name": text("name"),
                            "profit": rows["profit"].to_numpy(), "roi": rows["roi"].to_numpy(),
                            "message": [r["r_message"] if r["r_message"] is not None else f"Alert triggered for {n}" for r, n in zip(mine, named)],
                            "t": np.full(len(mine), t), "before": [r["before"] for r in mine], "gap": [r["gap"] for r in mine], "place": rows["place"].tolist()}
                    kinds = {"before": "Int64", "gap": "int64"}
                    yield pd.DataFrame({c: pd.Series(v, dtype=kinds.get(c, object if isinstance(v, list) else None)) for c, v in cols.items()})

    return rows.mapInPandas(run, _ROW)


def cooldown_firings(polls: DataFrame, rules: DataFrame, watermark: str, ts: str = "ts", seq=L.SEQ) -> DataFrame:
    """Notifications (#89) of a stream of polls; every row carries its poll's time, and a poll may come in any batch
    within the watermark's delay.

    As in the batch replay: with a cooldown, a rule fires for a poll's first match once that poll is strictly later than
    its last firing plus the cooldown; without one, for every match.  A batch should hold whole polls, in time order
    from batch to batch: a poll that comes behind a later firing of the rule does not fire.  Rows without time match nothing.
    """
    held = polls.where(F.col(ts).isNotNull()).withColumn("_ets", F.col(ts).cast("timestamp"))
    for c, kind in (("roi", "double"), ("name", "string")):
        if c not in held.columns:
            held = held.withColumn(c, F.lit(None).cast(kind))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = (F.col("r_cooldown_minutes") * F.lit(60_000_000).cast("long")).alias("gap")
    fields = [F.col(c).cast("double" if c in ("profit", "roi") else "string").alias(c) for c in _FIELDS]

    def shaped(matches: DataFrame) -> DataFrame:
        rows = matches.select("_ets", *AL.notification_fields(), micros(F.col(ts)).alias("t"), micros(F.col("r_last_triggered")).alias("before"),
                              gap, _place(matches, seq).alias("place"))
        return rows.select("_ets", *fields, "t", "before", "gap", "place")

    def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.sort_values("place", kind="stable").drop_duplicates(["alert_id", "t"])

    cooled = F.col("cooldown_minutes") > 0
    named = shaped(AL.keyed_matches(held, rules.where(cooled))).mapInPandas(firsts, _ROW)
    once = named.unionByName(_of_all_items(held, rules, ts, seq))
    fired = (once.withWatermark("_ets", watermark).groupBy("alert_id")
             .transformWithStateInPandas(Cooldown(), _OUT, "Append", "EventTime"))
    free = shaped(AL.alert_matches(held, rules.where(~cooled)))
    every = free.where((F.col("before").isNull() | (F.col("t") > F.col("before") + F.col("gap")))).select(*_FIELDS, "t")
    return fired.unionByName(every).withColumn("triggered_at", F.timestamp_micros("t").cast("timestamp_ntz")).drop("t")


def cooldown_stream(polls: DataFrame, rules: DataFrame, history_path: str, checkpoint: str, watermark: str = "1 hour",
                    ts: str = "ts", seq=L.SEQ, callback=None, available_now: bool = True):
    """Write the firings, a folder for each batch, which replaces itself when played again; ``callback`` (#93) gets each row."""
    spark, run = polls.sparkSession, ST.run_id(checkpoint)

    def batch(df: DataFrame, batch_id: int):
        path = f"{history_path}/batch={run}-{batch_id}"
        df.write.mode("overwrite").parquet(path)
        if callback is not None:
            def deliver(rows):
                for row in rows:
                    try:
                        callback(row)
                    except Exception as e:  # noqa: BLE001  (one failing hook must not stop the batch)
                        logging.getLogger(__name__).error("alert callback failed: %s", e)
            spark.read.parquet(path).foreachPartition(deliver)

    before = spark.conf.get(_PROVIDER[0], None)
    spark.conf.set(*_PROVIDER)      # read when the query starts
    try:
        w = (cooldown_firings(polls, rules, watermark, ts, seq).writeStream.outputMode("append").foreachBatch(batch)
             .option("checkpointLocation", checkpoint))
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 minutes")).start()
    finally:
        spark.conf.unset(_PROVIDER[0]) if before is None else spark.conf.set(_PROVIDER[0], before)
