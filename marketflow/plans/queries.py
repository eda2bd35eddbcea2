"""Query definitions over the shared test tables (Spark side + oracle SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anchored as A
from ..operators import metrics as M
from ..operators import query as Q
from ..sources.testdata import prices
from . import oracle_sql as O
from .registry import register

PRICE_DOUBLES = ("change_last_48h", "weight", "price_velocity", "liquidity_score")
METRIC_DOUBLES = PRICE_DOUBLES + ("roi", "profit_per_slot", "discount_percent", "profit_per_kg",
                                  "flea_to_base_ratio", "price_range_percent")
ROW_ORDER = "item_id, ts, l_orderkey, l_linenumber, l_suppkey"


def latest(spark, d):
    return A.latest_prices(prices(spark, d, last_minutes=45))


def snapshot(spark, d):
    """The dashboard frame: latest prices + trade metrics."""
    return M.trade_metrics(latest(spark, d))


# --- slice: scan -> latest -> metrics -> top-k -------------------------------

@register("latest_prices", O.with_ctes(O.PRICES, O.LATEST, body="SELECT * FROM latest"),
          doubles=PRICE_DOUBLES)
def q_latest_prices(spark, d):
    return latest(spark, d)


@register("trade_metrics", O.with_ctes(O.PRICES, O.LATEST, O.METRICS, body="SELECT * FROM metrics"),
          doubles=METRIC_DOUBLES)
def q_trade_metrics(spark, d):
    return snapshot(spark, d)


@register("profitable_items", O.with_ctes(O.PRICES, O.LATEST, O.METRICS, body=f"""
SELECT * FROM metrics
WHERE profit >= 0 AND roi >= 0 AND last_offer_count >= 5
ORDER BY profit DESC, {ROW_ORDER} LIMIT 50"""), doubles=METRIC_DOUBLES)
def q_profitable_items(spark, d):
    return Q.profitable_items(snapshot(spark, d))


# --- anchored queries (#20-28) ------------------------------------------------
from ..operators import summary as SM  # noqa: E402

_P = O.PRICES
_SNAP = (O.PRICES, O.LATEST, O.METRICS)


@register("latest_timestamp", O.with_ctes(_P, body="SELECT MAX(ts) AS latest_ts FROM prices"))
def q_latest_timestamp(spark, d):
    return A.latest_timestamp(prices(spark, d, with_levels=False))


@register("item_history", O.with_ctes(_P, body=
          "SELECT item_id, ts, flea_price, trader_price, profit FROM prices"))
def q_item_history(spark, d):
    return A.item_history(prices(spark, d, with_levels=False))


@register("item_history_clean", O.with_ctes(_P, body="""
SELECT item_id, ts, flea_price, trader_price, profit FROM prices
WHERE ts IS NOT NULL AND item_id IN (
  SELECT item_id FROM prices GROUP BY item_id HAVING COUNT(*) > 1 AND COUNT(ts) > 1)"""))
def q_item_history_clean(spark, d):
    return A.item_history_clean(A.item_history(prices(spark, d, with_levels=False)))


TRENDS_SQL = """
SELECT item_id, AVG(profit) AS avg_profit, MIN(profit) AS min_profit, MAX(profit) AS max_profit,
       COUNT(*) AS data_points
FROM prices WHERE ts > {a} - INTERVAL {h} HOUR GROUP BY item_id"""


@register("market_trends", O.with_ctes(_P, body=TRENDS_SQL.format(a=O.ANCHOR, h=6)),
          doubles=("avg_profit",))
def q_market_trends(spark, d):
    return A.market_trends(prices(spark, d, with_levels=False, last_minutes=6 * 60), hours=6)


ITEM_TREND_SQL = """
SELECT item_id, COUNT(*) AS data_points, AVG(profit) AS avg_profit, MIN(profit) AS min_profit,
       MAX(profit) AS max_profit, AVG(flea_price) AS avg_flea_price,
       AVG(trader_price) AS avg_trader_price, AVG(last_offer_count) AS avg_offers,
       MIN(ts) AS first_seen, MAX(ts) AS last_seen
FROM prices WHERE ts > {a} - INTERVAL {h} HOUR
GROUP BY item_id HAVING COUNT(*) >= 2"""
TREND_DOUBLES = ("avg_profit", "avg_flea_price", "avg_trader_price", "avg_offers")


@register("item_trend_data", O.with_ctes(_P, body=ITEM_TREND_SQL.format(a=O.ANCHOR, h=24)),
          doubles=TREND_DOUBLES)
def q_item_trend_data(spark, d):
    return A.item_trend_data(prices(spark, d, with_levels=False, last_minutes=24 * 60), hours=24)


@register("profit_statistics", O.with_ctes(_P, body=f"""
SELECT CAST(COUNT(DISTINCT item_id) AS BIGINT) AS unique_items, CAST(COUNT(*) AS BIGINT) AS total_records,
       COALESCE(AVG(profit), 0) AS avg_profit, CAST(COALESCE(MIN(profit), 0) AS BIGINT) AS min_profit,
       CAST(COALESCE(MAX(profit), 0) AS BIGINT) AS max_profit,
       COALESCE(AVG(flea_price), 0) AS avg_flea_price, COALESCE(AVG(last_offer_count), 0) AS avg_offers,
       24 AS data_hours
FROM prices WHERE ts > {O.ANCHOR} - INTERVAL 24 HOUR"""), doubles=("avg_profit", "avg_flea_price", "avg_offers"))
def q_profit_statistics(spark, d):
    return A.profit_statistics(prices(spark, d, with_levels=False, last_minutes=24 * 60), hours=24)


@register("table_health", O.with_ctes(_P, body=f"""
SELECT total_records, unique_items, oldest_record, newest_record, data_age_hours,
  CASE WHEN total_records = 0 THEN 'warning' WHEN data_age_hours > 2 THEN 'warning' ELSE 'healthy' END AS status,
  CASE WHEN floor(data_age_hours * 60) < 1 THEN 'just now'
       WHEN floor(data_age_hours * 60) < 60 THEN CAST(CAST(floor(data_age_hours * 60) AS BIGINT) AS VARCHAR) || 'm ago'
       ELSE CAST(CAST(floor(floor(data_age_hours * 60) / 60) AS BIGINT) AS VARCHAR) || 'h '
            || CAST(CAST(floor(data_age_hours * 60) AS BIGINT) % 60 AS VARCHAR) || 'm ago' END AS age_label
FROM (SELECT COUNT(*) AS total_records, COUNT(DISTINCT item_id) AS unique_items,
             MIN(ts) AS oldest_record, MAX(ts) AS newest_record,
             COALESCE(epoch(TIMESTAMP '{O.NOW}' - MAX(ts)) / 3600.0, 0.0) AS data_age_hours
      FROM prices) h"""), doubles=("data_age_hours",))
def q_table_health(spark, d):
    return A.table_health(prices(spark, d, with_levels=False), now=O.NOW)


@register("trend_volatility", O.with_ctes(_P, body=f"""
SELECT *, CASE WHEN abs(avg_profit) <> 0 THEN (max_profit - min_profit) / abs(avg_profit) ELSE 0.0 END AS volatility
FROM ({TRENDS_SQL.format(a=O.ANCHOR, h=24)}) t"""), doubles=("avg_profit", "volatility"))
def q_trend_volatility(spark, d):
    return A.trend_volatility(A.market_trends(prices(spark, d, with_levels=False, last_minutes=24 * 60), hours=24))


@register("market_with_trends", O.with_ctes(O.PRICES, O.LATEST, body=f"""
SELECT l.*, t.avg_profit AS trend_avg, t.min_profit AS trend_min, t.max_profit AS trend_max,
       CAST(COALESCE(t.data_points, 0) AS BIGINT) AS data_points,
       CAST(COALESCE(COALESCE(t.max_profit, l.profit) - COALESCE(t.min_profit, l.profit), 0) AS BIGINT) AS volatility
FROM latest l LEFT JOIN ({TRENDS_SQL.format(a=O.ANCHOR, h=168)}) t ON l.item_id = t.item_id"""),
          doubles=PRICE_DOUBLES + ("trend_avg",))
def q_market_with_trends(spark, d):
    return A.market_with_trends(latest(spark, d), A.market_trends(prices(spark, d, with_levels=False, last_minutes=168 * 60), hours=168))


# --- filters / lookups / top-k (#36-42, #66) -----------------------------------

@register("filter_market", O.with_ctes(*_SNAP, body="""
SELECT * FROM metrics WHERE profit >= 0 AND roi >= 0 AND last_offer_count >= 5
  AND profit_per_slot >= 0 AND trader_level_required <= 4 AND no_flea = 0 AND profit > 0"""),
          doubles=METRIC_DOUBLES)
def q_filter_market(spark, d):
    return Q.filter_market(snapshot(spark, d), max_trader_level=4)


EXPLORE_COLS = ("name, profit, roi, flea_price, trader_price, trader_name, trader_level_required, "
                "flea_level_required, category, avg_24h_price, low_24h_price, high_24h_price, "
                "change_last_48h, last_offer_count, weight, no_flea, marked_only")


@register("explore_market", O.with_ctes(*_SNAP, body=f"""
SELECT {EXPLORE_COLS} FROM metrics
WHERE regexp_matches(name, '(?i)plate') AND flea_price >= 0 AND profit > 0"""),
          doubles=("roi", "change_last_48h", "weight"))
def q_explore_market(spark, d):
    return Q.explore_market(snapshot(spark, d), search="plate")


@register("items_page", O.with_ctes(*_SNAP, body=f"""
SELECT * FROM metrics WHERE profit >= -1000
ORDER BY roi DESC NULLS LAST, {ROW_ORDER} LIMIT 100 OFFSET 10"""), doubles=METRIC_DOUBLES)
def q_items_page(spark, d):
    return Q.items_page(snapshot(spark, d), limit=100, offset=10, min_profit=-1000, sort_by="roi")


@register("item_by_id", O.with_ctes(*_SNAP, body=f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT m.*, row_number() OVER (PARTITION BY m.item_id ORDER BY profit DESC, {ROW_ORDER}) AS rn
  FROM metrics m WHERE m.item_id IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)) WHERE rn = 1"""),
          doubles=METRIC_DOUBLES)
def q_item_by_id(spark, d):
    ids = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string"))
    return Q.item_by_id(snapshot(spark, d), ids)


@register("item_by_name", O.with_ctes(*_SNAP, body=f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT m.*, row_number() OVER (PARTITION BY lower(m.name) ORDER BY profit DESC, {ROW_ORDER}) AS rn
  FROM metrics m WHERE lower(m.name) IN (SELECT lower(upper(p_name)) FROM part)) WHERE rn = 1"""),
          doubles=METRIC_DOUBLES)
def q_item_by_name(spark, d):
    names = spark.read.parquet(f"{d}/part.parquet").select(F.upper("p_name"))
    return Q.item_by_name(snapshot(spark, d), names)


@register("search_items", O.with_ctes(*_SNAP, body=f"""
SELECT * FROM metrics WHERE regexp_matches(name, '(?i)^(red|blue) ')
ORDER BY profit DESC, {ROW_ORDER} LIMIT 20"""), doubles=METRIC_DOUBLES)
def q_search_items(spark, d):
    return Q.search_items(snapshot(spark, d), "^(red|blue) ")


@register("reliable_volume", O.with_ctes(*_SNAP, body="SELECT * FROM metrics WHERE last_offer_count >= 5"),
          doubles=METRIC_DOUBLES)
def q_reliable_volume(spark, d):
    return Q.reliable_volume(snapshot(spark, d))


@register("top_gainers", O.with_ctes(*_SNAP, body=f"""
SELECT * FROM metrics WHERE change_last_48h IS NOT NULL AND change_last_48h <> 0
ORDER BY change_last_48h DESC, {ROW_ORDER} LIMIT 10"""), doubles=METRIC_DOUBLES)
def q_top_gainers(spark, d):
    return Q.gainers_losers(snapshot(spark, d))[0]


@register("top_losers", O.with_ctes(*_SNAP, body=f"""
SELECT * FROM metrics WHERE change_last_48h IS NOT NULL AND change_last_48h <> 0
ORDER BY change_last_48h ASC, {ROW_ORDER} LIMIT 10"""), doubles=METRIC_DOUBLES)
def q_top_losers(spark, d):
    return Q.gainers_losers(snapshot(spark, d))[1]


@register("best_per_kg", O.with_ctes(*_SNAP, body=f"""
SELECT * FROM metrics WHERE weight > 0 ORDER BY profit_per_kg DESC, {ROW_ORDER} LIMIT 20"""),
          doubles=METRIC_DOUBLES)
def q_best_per_kg(spark, d):
    return Q.best_per_kg(snapshot(spark, d))


# --- summaries (#13, #50-59, #67-69) ----------------------------------------

@register("market_overview", O.with_ctes(*_SNAP, body="""
SELECT COUNT(*) AS total_items, COUNT(*) FILTER (WHERE profit > 0) AS profitable_count,
  CASE WHEN COUNT(*) > 0 THEN COUNT(*) FILTER (WHERE profit > 0) / COUNT(*) * 100 ELSE 0.0 END AS profitable_pct,
  CAST(COALESCE(MAX(profit), 0) AS BIGINT) AS best_profit,
  COALESCE(AVG(roi) FILTER (WHERE profit > 0), 0.0) AS avg_roi,
  CAST(COALESCE(SUM(profit) FILTER (WHERE profit > 0), 0) AS BIGINT) AS total_potential
FROM metrics"""), doubles=("profitable_pct", "avg_roi"))
def q_market_overview(spark, d):
    return SM.market_overview(snapshot(spark, d))


@register("category_stats", O.with_ctes(*_SNAP, body="""
SELECT category, COUNT(*) AS item_count, AVG(profit) AS avg_profit, CAST(SUM(profit) AS BIGINT) AS total_profit,
       COUNT(*) FILTER (WHERE profit > 0) AS profitable_count
FROM metrics WHERE category IS NOT NULL GROUP BY category"""), doubles=("avg_profit",))
def q_category_stats(spark, d):
    return SM.category_stats(snapshot(spark, d))


@register("trader_stats", O.with_ctes(*_SNAP, body="""
SELECT trader_name, COUNT(*) AS item_count, AVG(profit) AS avg_profit, CAST(SUM(profit) AS BIGINT) AS total_profit
FROM metrics WHERE trader_name IS NOT NULL GROUP BY trader_name"""), doubles=("avg_profit",))
def q_trader_stats(spark, d):
    return SM.trader_stats(snapshot(spark, d))


@register("category_summary", O.with_ctes(*_SNAP, body="""
SELECT category, CAST(SUM(profit) AS BIGINT) AS total_profit, AVG(profit) AS avg_profit, MAX(profit) AS max_profit,
       AVG(roi) AS avg_roi, AVG(flea_price) AS avg_price, COUNT(*) AS items
FROM metrics WHERE category IS NOT NULL GROUP BY category"""), doubles=("avg_profit", "avg_roi", "avg_price"))
def q_category_summary(spark, d):
    return SM.category_summary(snapshot(spark, d))


@register("trader_summary", O.with_ctes(*_SNAP, body="""
SELECT trader_name, AVG(profit) AS avg_profit, MAX(profit) AS best_profit, CAST(SUM(profit) AS BIGINT) AS total_profit,
       AVG(roi) AS avg_roi, AVG(trader_price) AS avg_payout, COUNT(*) AS items,
       CAST(COALESCE(SUM(profit) FILTER (WHERE profit > 0), 0) AS BIGINT) AS profitable_total_profit,
       COUNT(*) FILTER (WHERE profit > 0) AS profitable_items
FROM metrics WHERE trader_name IS NOT NULL GROUP BY trader_name"""),
          doubles=("avg_profit", "avg_roi", "avg_payout"))
def q_trader_summary(spark, d):
    return SM.trader_summary(snapshot(spark, d))


@register("value_counts_category", O.with_ctes(*_SNAP, body="""
SELECT category, COUNT(*) AS count FROM metrics WHERE category IS NOT NULL
GROUP BY category ORDER BY count DESC, category LIMIT 10"""))
def q_value_counts_category(spark, d):
    return SM.value_counts(snapshot(spark, d), "category", 10)


@register("distinct_traders", O.with_ctes(*_SNAP, body="""
SELECT DISTINCT trader_name FROM metrics WHERE trader_name IS NOT NULL"""))
def q_distinct_traders(spark, d):
    return SM.distinct_values(snapshot(spark, d), "trader_name")


@register("profit_pivot", O.with_ctes(*_SNAP, body="""
SELECT category,
  COALESCE(AVG(profit) FILTER (WHERE trader_name = 'T0'), 0.0) AS T0,
  COALESCE(AVG(profit) FILTER (WHERE trader_name = 'T1'), 0.0) AS T1,
  COALESCE(AVG(profit) FILTER (WHERE trader_name = 'T2'), 0.0) AS T2,
  COALESCE(AVG(profit) FILTER (WHERE trader_name = 'T3'), 0.0) AS T3,
  COALESCE(AVG(profit) FILTER (WHERE trader_name = 'T4'), 0.0) AS T4,
  COALESCE(AVG(profit) FILTER (WHERE trader_name = 'T5'), 0.0) AS T5,
  COALESCE(AVG(profit) FILTER (WHERE trader_name = 'T6'), 0.0) AS T6,
  COALESCE(AVG(profit) FILTER (WHERE trader_name = 'T7'), 0.0) AS T7
FROM metrics
WHERE trader_name IS NOT NULL AND category IN (
  SELECT category FROM metrics WHERE category IS NOT NULL GROUP BY category ORDER BY COUNT(*) DESC, category LIMIT 10)
GROUP BY category"""), doubles=tuple(f"T{i}" for i in range(8)))
def q_profit_pivot(spark, d):
    return SM.profit_pivot(snapshot(spark, d))


@register("profit_hierarchy", O.with_ctes(*_SNAP, f"""
top AS (SELECT * FROM metrics WHERE profit > 0 ORDER BY profit DESC, {ROW_ORDER} LIMIT 100)""", body="""
SELECT category, trader_name, name, CAST(SUM(profit) AS BIGINT) AS profit,
       SUM(profit * profit) / SUM(profit) AS color,
       CAST(GROUPING_ID(category, trader_name, name) AS INTEGER) AS level_id
FROM top GROUP BY ROLLUP (category, trader_name, name)"""),
          doubles=("color",))
def q_profit_hierarchy(spark, d):
    return SM.profit_hierarchy(snapshot(spark, d))


HIST_SQL = """
b AS (SELECT MIN({c})::DOUBLE AS lo, MAX({c})::DOUBLE AS hi FROM src)
SELECT bin, lo + bin * (hi - lo) / {n} AS bin_start, lo + (bin + 1) * (hi - lo) / {n} AS bin_end, COUNT(*) AS count
FROM (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE LEAST(FLOOR(({c} - lo) / ((hi - lo) / {n})), {n} - 1) END AS INTEGER) AS bin,
             lo, hi FROM src, b)
GROUP BY bin, lo, hi"""


@register("histogram_profit", O.with_ctes(*_SNAP, "src AS (SELECT profit FROM metrics WHERE profit IS NOT NULL)",
                                          body=HIST_SQL.format(c="profit", n=50).replace("\nb AS", ", b AS", 1)
                                          .replace("WITH", "WITH", 1)),
          doubles=("bin_start", "bin_end"))
def q_histogram_profit(spark, d):
    return SM.histogram(snapshot(spark, d), "profit", 50)


@register("histogram_flea_p95", O.with_ctes(
    *_SNAP, """src AS (SELECT flea_price FROM metrics WHERE flea_price IS NOT NULL AND flea_price <
       (SELECT quantile_cont(flea_price, 0.95) FROM metrics WHERE flea_price IS NOT NULL))""",
    body=HIST_SQL.format(c="flea_price", n=50).replace("\nb AS", ", b AS", 1)),
    doubles=("bin_start", "bin_end"))
def q_histogram_flea_p95(spark, d):
    return SM.histogram(snapshot(spark, d), "flea_price", 50, below_quantile=0.95)


@register("box_stats", O.with_ctes(*_SNAP, """
src AS (SELECT category, flea_price FROM metrics WHERE flea_price IS NOT NULL AND category IN (
  SELECT category FROM metrics WHERE category IS NOT NULL GROUP BY category ORDER BY COUNT(*) DESC, category LIMIT 8)),
q AS (SELECT category, COUNT(*) AS n, quantile_cont(flea_price, 0.25) AS q1, quantile_cont(flea_price, 0.5) AS median,
             quantile_cont(flea_price, 0.75) AS q3 FROM src GROUP BY category)""", body="""
SELECT q.category, q.n, q.q1, q.median, q.q3,
  MIN(CASE WHEN s.flea_price >= q.q1 - 1.5 * (q.q3 - q.q1) THEN s.flea_price END) AS whisker_low,
  MAX(CASE WHEN s.flea_price <= q.q3 + 1.5 * (q.q3 - q.q1) THEN s.flea_price END) AS whisker_high,
  COUNT(*) FILTER (WHERE s.flea_price < q.q1 - 1.5 * (q.q3 - q.q1) OR s.flea_price > q.q3 + 1.5 * (q.q3 - q.q1)) AS outliers
FROM src s JOIN q ON s.category = q.category GROUP BY q.category, q.n, q.q1, q.median, q.q3"""),
          doubles=("q1", "median", "q3"))
def q_box_stats(spark, d):
    return SM.box_stats(snapshot(spark, d))


@register("restriction_summary", O.with_ctes(*_SNAP, "t AS (SELECT COUNT(*) AS n, SUM(no_flea) AS nf, SUM(marked_only) AS mo, "
                                             "COUNT(*) FILTER (WHERE flea_level_required > 15) AS rs FROM metrics)", body="""
SELECT 'flags' AS section, 'no_flea' AS label, CAST(NULL AS INTEGER) AS level, CAST(nf AS BIGINT) AS item_count FROM t
UNION ALL SELECT 'flags', 'marked_only', NULL, CAST(mo AS BIGINT) FROM t
UNION ALL SELECT 'flags', 'level_restricted', NULL, CAST(rs AS BIGINT) FROM t
UNION ALL SELECT 'types', 'Flea Allowed', NULL, CAST(n - nf - mo AS BIGINT) FROM t WHERE n - nf - mo > 0
UNION ALL SELECT 'types', 'No Flea', NULL, CAST(nf AS BIGINT) FROM t WHERE nf > 0
UNION ALL SELECT 'types', 'Marked Only', NULL, CAST(mo AS BIGINT) FROM t WHERE mo > 0
UNION ALL SELECT 'by_level', NULL, flea_level_required, COUNT(*) FROM metrics GROUP BY flea_level_required
UNION ALL SELECT 'restricted_by_category', category, flea_level_required, COUNT(*) FROM metrics
  WHERE flea_level_required > 15 AND category IS NOT NULL GROUP BY category, flea_level_required"""))
def q_restriction_summary(spark, d):
    return SM.restriction_summary(snapshot(spark, d))


@register("roi_price_points", O.with_ctes(*_SNAP, body=
          "SELECT item_id, name, flea_price, roi, profit FROM metrics WHERE profit > 0"), doubles=("roi",))
def q_roi_price_points(spark, d):
    return SM.roi_price_points(snapshot(spark, d))


@register("price_trader_points", O.with_ctes(*_SNAP, body="""
SELECT item_id, name, flea_price, trader_price, profit,
       (SELECT GREATEST(MAX(flea_price), MAX(trader_price)) FROM metrics) AS break_even_max FROM metrics"""))
def q_price_trader_points(spark, d):
    return SM.price_trader_points(snapshot(spark, d))


@register("market_summary", O.with_ctes(*_SNAP, body=f"""
SELECT 'overview' AS section, 1 AS ord, 'total_items' AS label, CAST(COUNT(*) AS DOUBLE) AS value FROM metrics
UNION ALL SELECT 'overview', 2, 'profitable_items', CAST(COUNT(*) FILTER (WHERE profit > 0) AS DOUBLE) FROM metrics
UNION ALL SELECT 'overview', 3, 'avg_profit', COALESCE(AVG(profit) FILTER (WHERE profit > 0), 0.0) FROM metrics
UNION ALL SELECT 'overview', 4, 'max_profit', COALESCE(CAST(MAX(profit) AS DOUBLE), 0.0) FROM metrics
UNION ALL SELECT 'top_categories', row_number() OVER (ORDER BY c DESC, category), category, CAST(c AS DOUBLE)
  FROM (SELECT category, COUNT(*) AS c FROM metrics WHERE category IS NOT NULL GROUP BY category ORDER BY c DESC, category LIMIT 10)
UNION ALL SELECT 'traders', row_number() OVER (ORDER BY c DESC, trader_name), trader_name, CAST(c AS DOUBLE)
  FROM (SELECT trader_name, COUNT(*) AS c FROM metrics WHERE trader_name IS NOT NULL GROUP BY trader_name)
UNION ALL SELECT 'top_items', row_number() OVER (ORDER BY profit DESC, {ROW_ORDER}), name, CAST(profit AS DOUBLE)
  FROM (SELECT * FROM metrics ORDER BY profit DESC, {ROW_ORDER} LIMIT 10)"""), doubles=("value",))
def q_market_summary(spark, d):
    return SM.market_summary(snapshot(spark, d))
from . import queries_scoring  # noqa: E402,F401
from . import queries_learned  # noqa: E402,F401
from . import queries_ml  # noqa: E402,F401
from . import queries_alerts  # noqa: E402,F401
from . import queries_ingest  # noqa: E402,F401
from . import queries_stream  # noqa: E402,F401
from . import queries_more  # noqa: E402,F401
