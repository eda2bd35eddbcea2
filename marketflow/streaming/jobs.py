"""Structured Streaming forms (#10, #88, #93, #94-97, and windowed trends).

* ``stream_ingest`` — payload files land in a folder per poll; each micro-batch is flattened (#1), stamped with
  its files' time and written to the date-partitioned ``prices`` store under its own batch id.  The freshness
  guard is asked once, when the stream starts (#10): a batch that has been read is always written.
* ``learned_state_stream`` — each micro-batch is merged into keyed states: item statistics by the order-independent
  Chan merge (#94), category and trader sums (#96, #97), calibration as a row per poll (#98).
* ``alert_stream`` — each micro-batch is one alert batch (#87) against the stored rule state; fired notifications
  go to the history table and to an optional user callback whose failures are isolated (#93).
* ``windowed_trends`` — our own addition for a stream: event-time tumbling windows with a watermark (the
  streaming shape of #23), upserted per key.

Every write carries the stream's and the batch's id and replaces itself, so a batch that is played again changes
nothing; learned states are hash buckets (``sources.buckets``), rules versioned folders (``sources.store.Versions``).
"""

from __future__ import annotations

import datetime as dt
import inspect
import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.columns import ts_literal, utc_now
from ..operators import alerts as AL
from ..operators import learned as L
from ..operators.scan import LARGEST, prefix_scan
from ..sources import payload as P
from ..sources import store as ST
from ..sources.buckets import Buckets

log = logging.getLogger(__name__)


def _start(writer, available_now: bool, every: str):
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def is_fresh(spark: SparkSession, store: str, now: dt.datetime, interval_minutes: int = S.COLLECTION_INTERVAL_MINUTES) -> bool:
    """#10: does the store hold data younger than the poll interval?"""
    newest = ST.newest(spark, store)
    return newest is not None and now - newest < dt.timedelta(minutes=interval_minutes)


def stream_ingest(spark: SparkSession, source_dir: str, store: str, checkpoint: str,
                  interval_minutes: int = S.COLLECTION_INTERVAL_MINUTES, available_now: bool = True,
                  on_batch=None, poll_time: Column | None = None, guard: bool = True, files_per_batch: int = 1):
    """#10: poll files → flattened rows written to the store, partitioned by day.

    With ``guard`` a store that is fresher than the poll interval defers the start: the stream is not started
    (None is returned) and no file is consumed.  ``poll_time`` defaults to each file's modification time, which a
    replayed batch reads again.
    """
    if guard and is_fresh(spark, store, utc_now(), interval_minutes):
        log.info("not started: the store is fresher than the poll interval")
        return None
    src = (spark.readStream.schema(P.ITEM).option("maxFilesPerTrigger", files_per_batch).json(source_dir)
           .select("*", F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("_landed")))
    run = ST.run_id(checkpoint)

    def batch(df: DataFrame, batch_id: int):
        rows = P.ingest_offers(df, poll_time=F.col("_landed") if poll_time is None else poll_time)
        ST.write_prices(rows, store, f"{run}-{batch_id}")
        if on_batch is not None:
            on_batch(rows, batch_id)

    w = src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return _start(w, available_now, f"{interval_minutes} minutes")


@dataclass(frozen=True)
class Part:
    """One keyed state that a stream maintains: how a batch is summed up, merged into the state, and read."""
    name: str
    key: str
    sum_up: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame, DataFrame], DataFrame]
    read: Callable[[DataFrame], DataFrame]


def item_part(ts: str = "ts", seq=L.SEQ) -> Part:
    return Part("items", "item_id", lambda df: L.item_statistics(df, ts=ts, seq=seq, keep_key=True), L.merge_item_statistics,
                lambda st: st.drop("last_key", "name_key"))


#: #96, #97: sums by category and by trader.
CATEGORIES = Part("categories", "category", L.category_totals, L.merge_totals, L.weighted_categories)
TRADERS = Part("traders", "trader", L.trader_totals, L.merge_totals, L.reliable_traders)


def calibration_part(ts: str = "ts") -> Part:
    """#98: a row per poll, which a batch holds whole; a poll that comes again takes the place of its earlier row."""
    return Part("calibration", "cycle", lambda df: L.calibration_pairs(L.cycle_stats(df, ts=ts)), L.newest_of, L.smoothed)


def learned_state(spark: SparkSession, root: str, part: Part, buckets: int = 16) -> Buckets:
    return Buckets(spark, f"{root}/{part.name}", part.key, buckets)


def learned_state_stream(source: DataFrame, state_root: str, checkpoint: str, ts: str = "ts", seq=L.SEQ,
                         available_now: bool = True, parts: list[Part] | None = None, buckets: int = 16):
    """#94, #96-98: merge each micro-batch into the keyed states of ``parts`` (item statistics, unless others are given).

    Each state writes the buckets of the batch's keys under the batch's id.  A batch that failed between two states
    is played again, and only the states that it had not reached change.
    """
    spark, run = source.sparkSession, ST.run_id(checkpoint)
    parts = [item_part(ts, seq)] if parts is None else parts

    def batch(df: DataFrame, batch_id: int):
        for part in parts:
            learned_state(spark, state_root, part, buckets).update(part.sum_up(df), part.merge, run, batch_id)

    w = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return _start(w, available_now, "1 minute")


def read_state(spark: SparkSession, state_root: str, part: Part | None = None) -> DataFrame:
    part = part or item_part()
    return part.read(learned_state(spark, state_root, part).current())


def expire_learned(spark: SparkSession, state_root: str, now, days: int = 30, run: str = "retention") -> int:
    """#18 on the stored item state: drop items not seen within ``days``, in the buckets that hold any; returns how many.

    Readers that have begun go on with the version before.  ``days <= 0`` keeps everything.
    """
    if days <= 0:
        return 0
    state = learned_state(spark, state_root, item_part())
    cut = ts_literal(now) - F.make_dt_interval(F.lit(int(days)))
    when = dt.datetime.fromisoformat(now) if isinstance(now, str) else now
    run_no = int((when - dt.datetime(1970, 1, 1)).total_seconds())     # the same time twice is the same run
    return state.rewrite(lambda st: L.learned_retention(st, now, days), F.col("last_seen") < cut, f"{run}{days}", run_no)


def read_rules(spark: SparkSession, rules_root: str) -> DataFrame:
    """The alert rules with their newest state."""
    return ST.Versions(spark, rules_root).current()


def alert_stream(source: DataFrame, rules_root: str, history_path: str, checkpoint: str, callback=None,
                 available_now: bool = True, clock=utc_now, seq=L.SEQ):
    """#87-#89, #93: every micro-batch is checked against the current rule state.

    ``clock(batch_id)`` or ``clock()`` stamps a batch; rules start as ``Versions(...).write(rules, "start", 0)``.
    Notifications of a batch stand in their own folder of the history, written before the new rule state: a batch
    that failed in between fires again from the same state and replaces them.
    """
    spark = source.sparkSession
    state, run = ST.Versions(spark, rules_root), ST.run_id(checkpoint)
    takes_id = any(p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD, p.VAR_POSITIONAL) and p.default is p.empty
                   for p in inspect.signature(clock).parameters.values())

    def batch(df: DataFrame, batch_id: int):
        if state.has(run, batch_id):
            return
        rules = state.current()
        now = clock(batch_id) if takes_id else clock()
        path = f"{history_path}/batch={run}-{batch_id}"
        AL.alert_fire(df, rules, now, seq).write.mode("overwrite").parquet(path)
        fired = spark.read.parquet(path)
        state.write(AL.rule_state_after(rules, fired, now), run, batch_id)
        if callback is not None:
            def deliver(rows):                        # runs on the executors, next to the data
                for row in rows:
                    try:
                        callback(row)
                    except Exception as e:  # noqa: BLE001  (one failing hook must not stop the batch)
                        logging.getLogger(__name__).error("alert callback failed: %s", e)
            fired.foreachPartition(deliver)

    w = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return _start(w, available_now, "5 minutes")


def lateness(deliveries: DataFrame, order: str = "delivery", ts: str = "ts") -> str:
    """The watermark delay that loses nothing of these deliveries: how far a row may lie behind the newest of its own and
    of earlier ones (a stream may read a delivery in several batches).

    ``deliveries`` are the rows (or a sample of their files) with the number of the delivery that brought each; a
    delivery is one row after the first step, and the newest time up to each is a prefix scan.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    parts = deliveries.groupBy(F.col(order).cast("long").alias("no")).agg(F.min(micros).alias("first"), F.max(micros).alias("last"))
    seen = prefix_scan(parts.where("last IS NOT NULL"), ["no"], ["last"], ["newest"], LARGEST)
    behind = seen.agg(F.max(F.col("newest") - F.col("first"))).first()[0]
    return f"{-(-max(0, behind or 0) // 1_000_000) + 1} seconds"


def timed(events: DataFrame, watermark: str, ts: str = "ts") -> DataFrame:
    """``events`` with an event time ``_ets`` under a watermark."""
    return events.withColumn("_ets", F.col(ts).cast("timestamp")).withWatermark("_ets", watermark)


def deduplicated(events: DataFrame, watermark: str, keys=("user_id",), ts: str = "ts") -> DataFrame:
    """The first row of each (keys, ts) as far as copies come within the watermark's delay; state goes with the watermark.

    Null times are never copies of one another for a watermark, so such rows are dropped: they belong to no window.
    """
    return timed(events.where(F.col(ts).isNotNull()), watermark, ts).dropDuplicatesWithinWatermark([*keys, "_ets"])


def windowed_trends(events: DataFrame, window: str = "6 hours", watermark: str = "1 hour",
                    key: str = "user_id", value: str = "value", ts: str = "ts", slide: str | None = None) -> DataFrame:
    """Avg/min/max/count per key in tumbling windows, or hop windows every ``slide`` (streaming #23 form).

    ``events`` may carry its watermark already (``deduplicated``).
    """
    t = events if "_ets" in events.columns else timed(events, watermark, ts)
    w = F.window("_ets", window) if slide is None else F.window("_ets", window, slide)
    return (t.groupBy(w.alias("w"), F.col(key))
            .agg(F.avg(value).alias("avg_value"), F.min(value).alias("min_value"),
                 F.max(value).alias("max_value"), F.count(F.lit(1)).alias("data_points"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), key, "avg_value", "min_value",
                    "max_value", "data_points"))


def windowed_trends_stream(events: DataFrame, out: str, checkpoint: str, window: str = "6 hours",
                           watermark: str = "1 hour", key: str = "user_id", available_now: bool = True,
                           slide: str | None = None, mode: str = "update"):
    """A batch writes the windows that it changed (update mode) or that the watermark closed (append, needed after
    ``deduplicated``); the watermark drops finished ones from state."""
    def batch(df: DataFrame, batch_id: int):
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    w = (windowed_trends(events, window, watermark, key, slide=slide).writeStream.outputMode(mode).foreachBatch(batch)
         .option("checkpointLocation", checkpoint))
    return _start(w, available_now, "1 minute")


def read_windowed_trends(spark: SparkSession, out: str, key: str = "user_id") -> DataFrame:
    """The newest row of every window and key."""
    rows = spark.read.option("basePath", out).parquet(out)
    newest = F.max_by(F.struct("avg_value", "min_value", "max_value", "data_points"), "batch")
    return rows.groupBy("window_start", key).agg(newest.alias("r")).select("window_start", key, "r.*")
