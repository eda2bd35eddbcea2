"""Registered streaming queries: micro-batch state and windowed trends over ``events``.

The events table is staged once per run as day directories in the shared
folder (a distributed write of the given table) and then consumed as a file
stream, several files per micro-batch, with ``availableNow``.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..operators import alerts as AL
from ..operators import anchored as A
from ..session import scratch_path
from ..sources import payload as P
from ..sources import store as ST
from ..sources.testdata import prices, read_table
from ..streaming import cooldown as C
from ..streaming import jobs as J
from . import oracle_sql as O
from . import queries_ingest as Q
from .registry import register

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stage_events(spark, d):
    root = scratch_path(spark, f"stream/{uuid.uuid4().hex[:12]}")
    ev = read_table(spark, d, "events")
    ev.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(f"{root}/in")
    src = (spark.readStream.schema(EVENT_SCHEMA + ", day date").option("maxFilesPerTrigger", 4)
           .parquet(f"{root}/in"))
    return root, src


def events_as_prices(ev):
    """events → price-shaped rows: item = user, category = event type, profit = value."""
    return ev.select(F.col("user_id").cast("string").alias("item_id"), F.lit("").alias("name"),
                     F.col("event_type").alias("category"), F.lit(None).cast("string").alias("trader_name"),
                     F.col("value").alias("profit"), F.lit(0).alias("flea_price"),
                     F.lit(0).alias("last_offer_count"), F.lit(0.0).alias("liquidity_score"), "ts", "event_id")


EV_ORDER = "(ts, event_id)"
EV_STATS_SQL = f"""
WITH ev AS (
  SELECT CAST(user_id AS VARCHAR) AS item_id, event_type AS category, value AS profit, ts, event_id FROM events
),
s0 AS (
  SELECT item_id, COUNT(*) AS count, AVG(profit) AS profit_mean,
    COALESCE(VAR_SAMP(profit), 0.0) * (COUNT(*) - 1) AS m2, MIN(profit) AS profit_min, MAX(profit) AS profit_max,
    0.0 AS flea_price_mean, 0.0 AS offers_mean, 0.0 AS roi_mean, 0.0 AS liquidity_mean,
    COUNT(*) FILTER (WHERE profit > 0) AS profitable_count,
    arg_max(CASE WHEN trim(category) IS NULL OR trim(category) = '' THEN 'Unknown' ELSE trim(category) END, {EV_ORDER}) AS category,
    'Unknown' AS trader, '' AS item_name, MIN(ts) AS first_seen, MAX(ts) AS last_seen
  FROM ev GROUP BY item_id
)
SELECT * EXCLUDE (m2),
  CASE WHEN count >= 2 THEN sqrt(GREATEST(m2 / (count - 1), 0.0)) ELSE 0.0 END AS profit_std,
  CASE WHEN count >= 2 AND abs(profit_mean) > 1
       THEN LEAST(GREATEST(100 * (1 - sqrt(GREATEST(m2 / (count - 1), 0.0)) / abs(profit_mean)), 0), 100)
       ELSE 50.0 END AS consistency_score
FROM s0"""

STAT_COLS = ("item_id", "count", "profit_mean", "profit_min", "profit_max", "flea_price_mean", "offers_mean",
             "roi_mean", "liquidity_mean", "profitable_count", "category", "trader", "item_name", "first_seen",
             "last_seen", "profit_std", "consistency_score")


@register("stream_item_statistics", EV_STATS_SQL,
          doubles=("profit_mean", "profit_min", "profit_max", "flea_price_mean", "offers_mean", "roi_mean",
                   "liquidity_mean", "profit_std", "consistency_score"), digits=4)
def q_stream_item_statistics(spark, d):
    """#94 as a stream: per-micro-batch statistics merged into versioned state; final state returned."""
    root, src = _stage_events(spark, d)
    q = J.learned_state_stream(events_as_prices(src), f"{root}/state", f"{root}/ckpt", seq=("event_id",))
    q.awaitTermination()
    return J.read_state(spark, f"{root}/state").select(*STAT_COLS)


#: events with a price and a trader, for the states that need them; a poll is a day.
def _events_with_traders(ev):
    return events_as_prices(ev).withColumns({
        "trader_name": F.when(F.col("item_id").cast("long") % 29 != 0, F.concat(F.lit("T"), (F.col("item_id").cast("long") % 8).cast("string"))),
        "flea_price": 5 + F.col("item_id").cast("long") % 20,
        "ts": F.date_trunc("day", "ts").cast("timestamp_ntz")})


EV_TRADERS_CTE = """
ev AS (
  SELECT CAST(user_id AS VARCHAR) AS item_id, event_type AS category, value AS profit, 5 + user_id % 20 AS flea_price,
    CASE WHEN user_id % 29 <> 0 THEN 'T' || CAST(user_id % 8 AS VARCHAR) END AS trader_name, CAST(date_trunc('day', ts) AS TIMESTAMP) AS cycle
  FROM events
)"""


def _learned(spark, d, part):
    """The state of a part after a stream over polls that come in no order, of which the last batch is played twice."""
    root = scratch_path(spark, f"stream/{uuid.uuid4().hex[:12]}")
    ev = read_table(spark, d, "events").withColumn("day", F.to_date("ts"))
    ev.repartition("day").write.partitionBy("day").parquet(f"{root}/in")     # a poll is one file
    src = spark.readStream.schema(EVENT_SCHEMA + ", day date").option("maxFilesPerTrigger", 7).parquet(f"{root}/in")
    play = lambda: J.learned_state_stream(_events_with_traders(src), f"{root}/state", f"{root}/ckpt", parts=[part]).awaitTermination()
    play()
    commits = [c for c in ST.files(spark, f"{root}/ckpt/commits") if c.isdigit()]
    ST.remove(spark, f"{root}/ckpt/commits/{max(commits, key=int)}")   # as if the driver had died after the batch
    play()
    return J.read_state(spark, f"{root}/state", part)


@register("stream_category_performance", f"""
WITH {EV_TRADERS_CTE}
SELECT trim(category) AS category, COUNT(*) AS total_items, COUNT(*) FILTER (WHERE profit > 0) AS profitable_items, AVG(profit) AS avg_profit,
  CASE WHEN COUNT(*) >= 5 THEN 0.5 + COUNT(*) FILTER (WHERE profit > 0) / COUNT(*) ELSE 1.0 END AS weight
FROM ev WHERE trim(category) <> '' GROUP BY 1""", doubles=("avg_profit", "weight"), digits=4)
def q_stream_category_performance(spark, d):
    """#96 as a stream."""
    return _learned(spark, d, J.CATEGORIES)


@register("stream_trader_reliability", f"""
WITH {EV_TRADERS_CTE}
SELECT trader_name AS trader, COUNT(*) AS count, AVG(profit) AS avg_profit,
  CASE WHEN COUNT(*) >= 10 THEN LEAST(GREATEST(0.5 + AVG(profit) / 20000, 0), 1) ELSE 0.5 END AS reliability
FROM ev WHERE trader_name IS NOT NULL GROUP BY 1""", doubles=("avg_profit", "reliability"), digits=4)
def q_stream_trader_reliability(spark, d):
    """#97 as a stream."""
    return _learned(spark, d, J.TRADERS)


_CAL_SQL = f"""
WITH {EV_TRADERS_CTE},
cq AS (SELECT cycle, quantile_cont(profit, 0.05) AS a, quantile_cont(profit, 0.95) AS b FROM ev GROUP BY cycle),
cagg AS (
  SELECT e.cycle, COUNT(*) AS n, AVG(LEAST(GREATEST(profit, a), b)) AS pm, STDDEV_SAMP(LEAST(GREATEST(profit, a), b)) AS ps,
    AVG(LEAST(GREATEST(profit / flea_price * 100, -200), 200)) AS rm, STDDEV_SAMP(LEAST(GREATEST(profit / flea_price * 100, -200), 200)) AS rs
  FROM ev e JOIN cq ON e.cycle = cq.cycle GROUP BY e.cycle),
cyc AS (
  SELECT cycle, pm, CASE WHEN n <= 1 OR ps IS NULL OR ps = 0 THEN 1.0 ELSE ps END AS ps, rm,
    CASE WHEN n <= 1 OR rs IS NULL OR rs = 0 THEN 1.0 ELSE rs END AS rs,
    row_number() OVER (ORDER BY cycle) AS i, COUNT(*) OVER () AS c FROM cagg)
SELECT COUNT(*) AS cycles,
  SUM(0.1 * pm * pow(0.9, c - i)) AS profit_mean, pow(0.9, COUNT(*)) + SUM(0.1 * ps * pow(0.9, c - i)) AS profit_std,
  SUM(0.1 * rm * pow(0.9, c - i)) AS roi_mean, pow(0.9, COUNT(*)) + SUM(0.1 * rs * pow(0.9, c - i)) AS roi_std
FROM cyc"""


@register("stream_calibration_ema", _CAL_SQL, doubles=("profit_mean", "profit_std", "roi_mean", "roi_std"), digits=4)
def q_stream_calibration_ema(spark, d):
    """#98 as a stream: a row per poll, smoothed in time order whatever the order of arrival."""
    return _learned(spark, d, J.calibration_part())


@register("stream_learned_retention", f"SELECT * FROM ({EV_STATS_SQL}) s WHERE NOT (last_seen < TIMESTAMP '2024-01-31' - INTERVAL 2 DAY)",
          doubles=("profit_mean", "profit_min", "profit_max", "flea_price_mean", "offers_mean", "roi_mean",
                   "liquidity_mean", "profit_std", "consistency_score"), digits=4)
def q_stream_learned_retention(spark, d):
    """#18 on the streamed state: items not seen for two days go, in the buckets that hold any."""
    root, src = _stage_events(spark, d)
    J.learned_state_stream(events_as_prices(src), f"{root}/state", f"{root}/ckpt", seq=("event_id",)).awaitTermination()
    J.expire_learned(spark, f"{root}/state", "2024-01-31 00:00:00", 2)
    return J.read_state(spark, f"{root}/state").select(*STAT_COLS)


def _deliver(spark, rows, root, column="delivery"):
    """Write ``rows`` once, a folder for each delivery, and date the files so that a stream reads them in that order."""
    rows.repartition(column).write.mode("append").partitionBy(column).parquet(root)
    start = 1_700_000_000_000
    for folder in ST.folders(spark, root):
        for name in ST.files(spark, f"{root}/{folder}"):
            ST.date_file(spark, f"{root}/{folder}/{name}", start + 60_000 * int(folder.split("=")[1]))


LATE = "CASE WHEN event_id % 7 = 0 THEN 36 ELSE 0 END"     # hours that every seventh event comes late
AGAIN = 18                                                 # hours until every fifth event comes once more
_EVERY = 3                                                 # days of a delivery


def _planted(spark, d):
    """events as they arrive: some late, some twice, and a row far ahead that closes all windows."""
    ev = read_table(spark, d, "events")
    late = F.when(F.col("event_id") % 7 == 0, 36).otherwise(0)
    hours = lambda h: F.make_dt_interval(F.lit(0), h)
    once = ev.withColumn("arrived", F.col("ts") + hours(late))
    twice = ev.where(F.col("event_id") % 5 == 0).withColumn("arrived", F.col("ts") + hours(late + AGAIN))
    both = once.unionByName(twice)
    first = both.agg(F.to_date(F.min("arrived")).alias("first"))
    both = both.crossJoin(F.broadcast(first)).withColumn("delivery", F.floor(F.datediff("arrived", "first") / _EVERY).cast("int"))
    last = both.agg(F.max("ts").alias("ts"), F.max("delivery").alias("delivery")).select(
        F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + hours(F.lit(24 * 30))).alias("ts"), F.lit(None).cast("long").alias("user_id"),
        F.lit("close").alias("event_type"), F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("props"), (F.col("delivery") + 1).alias("delivery"))
    return both.drop("arrived", "first").unionByName(last)


@register("stream_deduplicated_windows", """
SELECT w AS window_start, user_id, AVG(value) AS avg_value, MIN(value) AS min_value, MAX(value) AS max_value, COUNT(*) AS data_points
FROM (SELECT user_id, value, unnest([time_bucket(INTERVAL 2 HOUR, ts), time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 2 HOUR,
                                     time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 4 HOUR]) AS w FROM events) e
GROUP BY 1, 2""", doubles=("avg_value", "min_value", "max_value"))
def q_stream_deduplicated_windows(spark, d):
    """Six-hour windows every two hours over events of which some come late and some twice; the watermark is taken from
    the deliveries, so nothing is lost and nothing counts twice."""
    root = scratch_path(spark, f"stream/{uuid.uuid4().hex[:12]}")
    _deliver(spark, _planted(spark, d), f"{root}/in")
    came = spark.read.parquet(f"{root}/in")
    delay = J.lateness(came.where("event_id >= 0"))
    src = (spark.readStream.schema(EVENT_SCHEMA + ", delivery int").option("maxFilesPerTrigger", 1).parquet(f"{root}/in"))
    once = J.deduplicated(src, delay, keys=("event_id", "user_id"))
    J.windowed_trends_stream(once, f"{root}/trends", f"{root}/ckpt", slide="2 hours", mode="append").awaitTermination()
    return J.read_windowed_trends(spark, f"{root}/trends").where("user_id IS NOT NULL")


@register("stream_windowed_trends", """
SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts) AS TIMESTAMP) AS window_start, user_id,
  AVG(value) AS avg_value, MIN(value) AS min_value, MAX(value) AS max_value, COUNT(*) AS data_points
FROM events GROUP BY 1, 2""", doubles=("avg_value", "min_value", "max_value"))
def q_stream_windowed_trends(spark, d):
    """Event-time 6 h windows with a watermark over the table's span, upserted per micro-batch (update mode)."""
    root, src = _stage_events(spark, d)
    # Files of the staged table are read in no order of time, so a row may lie behind by the whole span of the table.
    span = read_table(spark, d, "events").select(F.timestamp_diff("SECOND", F.min("ts"), F.max("ts"))).first()[0]
    J.windowed_trends_stream(src, f"{root}/trends", f"{root}/ckpt", watermark=f"{(span or 0) + 1} seconds").awaitTermination()
    return J.read_windowed_trends(spark, f"{root}/trends")


@register("stream_ingest", Q.INGEST_SQL, doubles=("change_last_48h", "weight", "price_velocity", "liquidity_score"))
def q_stream_ingest(spark, d):
    """#5, #10: payload pages as JSON files, three eighths of them per run, polled into the store; the second start finds
    nothing new."""
    root = scratch_path(spark, f"stream/{uuid.uuid4().hex[:12]}")
    P.write_pages(Q.payload_from_prices(prices(spark, d)), f"{root}/in", least=8)
    pages = len(ST.files(spark, f"{root}/in"))
    stamp = P.normalize_timestamps(F.col("updated"))
    for _ in range(2):
        J.stream_ingest(spark, f"{root}/in", f"{root}/store", f"{root}/ckpt", poll_time=stamp, guard=False,
                        files_per_batch=max(1, -(-3 * pages // 8))).awaitTermination()
    return ST.read_prices(spark, f"{root}/store").select(*Q.INGEST_COLS)


@register("payload_pages", Q.INGEST_SQL, doubles=("change_last_48h", "weight", "price_velocity", "liquidity_score"))
def q_payload_pages(spark, d):
    """#5: the pages of a poll, read from two folders of JSON files and put together."""
    root = scratch_path(spark, f"pages/{uuid.uuid4().hex[:12]}")
    pay = Q.payload_from_prices(prices(spark, d))
    odd = F.crc32(F.col("id").cast("binary")) % 2 == 1
    for k, part in enumerate((pay.filter(odd), pay.filter(~odd))):
        P.write_pages(part, f"{root}/{k}")
    pages = P.union_pages(*(P.read_payload(spark, f"{root}/{k}") for k in range(2)))
    return P.ingest_offers(pages, poll_time=P.normalize_timestamps(F.col("updated"))).select(*Q.INGEST_COLS)


STORE_COLS = ("item_id", "ts", "l_orderkey", "l_linenumber", "l_suppkey", "profit")


def _stored(spark, d):
    path = scratch_path(spark, f"store/{uuid.uuid4().hex[:12]}")
    ST.write_prices(prices(spark, d, with_levels=False), path, "all")
    return path


@register("store_retention", O.with_ctes(O.PRICES, body=f"""
SELECT {', '.join(STORE_COLS)} FROM prices WHERE ts IS NULL OR NOT (ts < TIMESTAMP '{O.NOW}' - INTERVAL 7 DAY)"""))
def q_store_retention(spark, d):
    """#16 on the store: expired days are dropped, the day of the cut is rewritten."""
    path = _stored(spark, d)
    ST.expire(spark, path, O.NOW, 7)
    return ST.read_prices(spark, path).select(*STORE_COLS)


@register("store_latest_prices", O.with_ctes(O.PRICES, O.LATEST, body=f"SELECT {', '.join(STORE_COLS)} FROM latest"))
def q_store_latest_prices(spark, d):
    """#19 on the store: only the days of the lookback window are read."""
    rows = ST.recent(spark, _stored(spark, d), F.make_dt_interval(F.lit(0), F.lit(0), F.lit(45)))
    return A.latest_prices(rows).select(*STORE_COLS)


ALERT_NOW = dt.datetime(2024, 2, 1)
ALERT_FROM = 150.0
ALERT_DAYS = 5          # days of events in a batch
ALERT_STREAM_SQL = f"""
WITH RECURSIVE polls AS (SELECT *, (dense_rank() OVER (ORDER BY CAST(ts AS DATE)) - 1) // {ALERT_DAYS} AS batch FROM events),
firsts AS (
  SELECT batch, arg_min(CAST(user_id AS VARCHAR), event_id) AS item_id, arg_min(value, event_id) AS profit
  FROM polls WHERE value >= {ALERT_FROM} GROUP BY batch),
fires(b) AS (
  SELECT MIN(batch) FROM firsts
  UNION ALL
  SELECT (SELECT MIN(f.batch) FROM firsts f WHERE f.batch >= fires.b + 2) FROM fires WHERE b IS NOT NULL)
SELECT 'high' AS alert_id, item_id, profit, TIMESTAMP '2024-02-01' + to_hours(CAST(batch AS BIGINT)) AS triggered_at
FROM firsts WHERE batch IN (SELECT b FROM fires)"""


@register("alert_stream", ALERT_STREAM_SQL, doubles=("profit",))
def q_alert_stream(spark, d):
    """#87, #88, #93 as a stream: batches of a few days of events, one hour apart, under a 90-minute cooldown."""
    root = scratch_path(spark, f"stream/{uuid.uuid4().hex[:12]}")
    ev = read_table(spark, d, "events").withColumn("day", F.to_date("ts"))
    every = [r["day"] for r in ev.select("day").distinct().orderBy("day").collect()]      # a row a day of the table
    number = F.create_map(*[x for k, day in enumerate(every) for x in (F.lit(day), F.lit(k // ALERT_DAYS))])
    ev.withColumn("delivery", number[F.col("day")]).write.partitionBy("delivery").parquet(f"{root}/in")    # once, in any number of files
    rules = AL.rules_frame(spark, [AL.rule("high", AL.PROFIT_THRESHOLD, threshold_value=ALERT_FROM, cooldown_minutes=90)])
    ST.Versions(spark, f"{root}/rules").write(rules, "start", 0)
    for k in range(-(-len(every) // ALERT_DAYS)):          # a delivery is one batch, all its files together
        src = spark.readStream.schema(EVENT_SCHEMA + ", day date").parquet(f"{root}/in/delivery={k}")
        J.alert_stream(events_as_prices(src), f"{root}/rules", f"{root}/history", f"{root}/ckpt/{k}",
                       clock=lambda _, k=k: ALERT_NOW + dt.timedelta(hours=k), seq=("event_id",)).awaitTermination()
    return spark.read.parquet(f"{root}/history/*").select("alert_id", "item_id", "profit", "triggered_at")


COOL_RULES = [AL.rule("high", AL.PROFIT_THRESHOLD, threshold_value=60.0, cooldown_minutes=90, message="High"),
              AL.rule("clicks", AL.CATEGORY_ALERT, category="click", threshold_value=40.0, cooldown_minutes=300),
              AL.rule("watch", AL.ITEM_WATCHLIST, item_id="7", threshold_value=5.0, cooldown_minutes=1440),
              AL.rule("tiny", AL.PROFIT_THRESHOLD, threshold_value=0.02, threshold_type="below", cooldown_minutes=0),
              AL.rule("off", AL.PROFIT_THRESHOLD, threshold_value=1.0, enabled=False)]
COOL_SQL = """
WITH RECURSIVE ev AS (
  SELECT CAST(user_id AS VARCHAR) AS item_id, event_type AS category, value AS profit, date_trunc('hour', ts) AS t, event_id FROM events),
rules AS (SELECT * FROM (VALUES ('high', 'profit_threshold', 'High', 90), ('clicks', 'category_alert', 'Alert triggered for ', 300),
  ('watch', 'item_watchlist', 'Alert triggered for ', 1440), ('tiny', 'profit_threshold', 'Alert triggered for ', 0)) v(id, kind, message, cooldown)),
m AS (SELECT r.*, ev.* FROM ev JOIN rules r ON (id = 'high' AND profit >= 60) OR (id = 'clicks' AND category = 'click' AND profit >= 40)
  OR (id = 'watch' AND item_id = '7' AND profit >= 5) OR (id = 'tiny' AND profit <= 0.02)),
firsts AS (SELECT id, kind, message, cooldown, t, arg_min(item_id, event_id) AS item_id, arg_min(profit, event_id) AS profit
  FROM m WHERE cooldown > 0 GROUP BY ALL),
fires(id, t) AS (
  SELECT id, MIN(t) FROM firsts GROUP BY id
  UNION ALL
  SELECT f.id, (SELECT MIN(c.t) FROM firsts c WHERE c.id = f.id AND c.t > f.t + to_minutes(CAST(c.cooldown AS BIGINT))) FROM fires f WHERE f.t IS NOT NULL)
SELECT id AS alert_id, kind AS alert_type, item_id, profit, message, CAST(t AS TIMESTAMP) AS triggered_at FROM (
  SELECT id, kind, message, t, item_id, profit FROM firsts WHERE (id, t) IN (SELECT (id, t) FROM fires WHERE t IS NOT NULL)
  UNION ALL SELECT id, kind, message, t, item_id, profit FROM m WHERE cooldown <= 0) x"""
COOL_COLS = ("alert_id", "alert_type", "item_id", "profit", "message", "triggered_at")


def _fails(row):
    raise RuntimeError(f"hook of {row['alert_id']}")        # #93: a failing hook stops nothing


def _hourly(ev):
    return events_as_prices(ev).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))


@register("stream_alert_cooldown", COOL_SQL, doubles=("profit",))
def q_stream_alert_cooldown(spark, d):
    """#88 as a stateful operator: hourly polls, days in order, the stream stopped and started again between the deliveries."""
    root = scratch_path(spark, f"stream/{uuid.uuid4().hex[:12]}")
    ev = read_table(spark, d, "events")
    first = ev.agg(F.to_date(F.min("ts")).alias("first"))
    days = ev.crossJoin(F.broadcast(first)).withColumn("delivery", F.floor(F.datediff("ts", "first") / 4).cast("int")).drop("first")
    rules, half = AL.rules_frame(spark, COOL_RULES), F.col("delivery") < 4
    for part in (half, ~half):      # the second start goes on from the state of the first
        _deliver(spark, days.where(part), f"{root}/in")
        src = spark.readStream.schema(EVENT_SCHEMA + ", delivery int").option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
        C.cooldown_stream(_hourly(src), rules, f"{root}/history", f"{root}/ckpt", watermark="1 hour", seq=("event_id",), callback=_fails).awaitTermination()
    return spark.read.parquet(f"{root}/history/*").select(*COOL_COLS)
