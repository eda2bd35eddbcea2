"""Registered learned-state queries (#18, #45, #94-105)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anchored as A
from ..operators import learned as L
from ..operators import metrics as M
from ..operators import scoring as SC
from ..sources.testdata import prices, read_table
from . import oracle_sql as O
from .registry import register

SPLIT_TS = "2024-01-05 00:00:00"
ITEM_STAT_COLS = ("item_id", "count", "profit_mean", "profit_min", "profit_max", "flea_price_mean",
                  "offers_mean", "roi_mean", "liquidity_mean", "profitable_count", "category", "trader",
                  "item_name", "first_seen", "last_seen", "profit_std", "consistency_score")
ITEM_STAT_DOUBLES = ("profit_mean", "profit_min", "profit_max", "flea_price_mean", "offers_mean", "roi_mean",
                     "liquidity_mean", "profit_std", "consistency_score")

_ORDER = "(ts, l_orderkey, l_linenumber, l_suppkey)"


def _txt(c, default):
    return f"CASE WHEN trim({c}) IS NULL OR trim({c}) = '' THEN '{default}' ELSE trim({c}) END"


ITEM_STATS_CTE = f"""
ist0 AS (
  SELECT trim(item_id) AS item_id, COUNT(*) AS count, AVG(CAST(profit AS DOUBLE)) AS profit_mean,
    COALESCE(VAR_SAMP(CAST(profit AS DOUBLE)), 0.0) * (COUNT(*) - 1) AS profit_m2,
    MIN(CAST(profit AS DOUBLE)) AS profit_min, MAX(CAST(profit AS DOUBLE)) AS profit_max,
    AVG(CAST(flea_price AS DOUBLE)) AS flea_price_mean, AVG(CAST(last_offer_count AS DOUBLE)) AS offers_mean,
    AVG(CASE WHEN flea_price > 0 THEN profit / flea_price * 100 ELSE 0.0 END) AS roi_mean,
    AVG(liquidity_score) AS liquidity_mean,
    COUNT(*) FILTER (WHERE profit > 0) AS profitable_count,
    arg_max({_txt('category', 'Unknown')}, {_ORDER}) AS category,
    arg_max({_txt('trader_name', 'Unknown')}, {_ORDER}) AS trader,
    COALESCE(arg_max(trim(name), {_ORDER}) FILTER (WHERE trim(name) <> ''), '') AS item_name,
    MIN(ts) AS first_seen, MAX(ts) AS last_seen
  FROM prices WHERE trim(item_id) IS NOT NULL AND trim(item_id) <> '' GROUP BY trim(item_id)
),
ist AS (
  SELECT * EXCLUDE (profit_m2),
    CASE WHEN count >= 2 THEN sqrt(GREATEST(profit_m2 / (count - 1), 0.0)) ELSE 0.0 END AS profit_std,
    CASE WHEN count >= 2 AND abs(profit_mean) > 1
         THEN LEAST(GREATEST(100 * (1 - sqrt(GREATEST(profit_m2 / (count - 1), 0.0)) / abs(profit_mean)), 0), 100)
         ELSE 50.0 END AS consistency_score
  FROM ist0
)"""


def item_stats(spark, d):
    return L.item_statistics(prices(spark, d, with_levels=False))


@register("item_statistics", O.with_ctes(O.PRICES, ITEM_STATS_CTE, body="SELECT * FROM ist"),
          doubles=ITEM_STAT_DOUBLES)
def q_item_statistics(spark, d):
    return item_stats(spark, d).select(*ITEM_STAT_COLS)


@register("item_statistics_incremental", O.with_ctes(O.PRICES, ITEM_STATS_CTE, body="SELECT * FROM ist"),
          doubles=ITEM_STAT_DOUBLES)
def q_item_statistics_incremental(spark, d):
    """State over the older polls merged with the newer polls' batch = full statistics."""
    p = prices(spark, d, with_levels=False)
    cut = F.lit(SPLIT_TS).cast("timestamp_ntz")
    state = L.item_statistics(p.filter(F.col("ts") >= cut), keep_key=True)   # order-independent merge
    batch = L.item_statistics(p.filter(F.col("ts") < cut), keep_key=True)
    return L.merge_item_statistics(state, batch).select(*ITEM_STAT_COLS)


CAT_PERF_CTE = """
cperf AS (
  SELECT trim(category) AS category, COUNT(*) AS total_items, COUNT(*) FILTER (WHERE profit > 0) AS profitable_items,
         AVG(CAST(profit AS DOUBLE)) AS avg_profit,
         CASE WHEN COUNT(*) >= 5 THEN 0.5 + COUNT(*) FILTER (WHERE profit > 0) / COUNT(*) ELSE 1.0 END AS weight
  FROM prices WHERE trim(category) IS NOT NULL AND trim(category) <> '' GROUP BY trim(category)
)"""
TRADER_CTE = """
trel AS (
  SELECT trim(trader_name) AS trader, COUNT(*) AS count, AVG(CAST(profit AS DOUBLE)) AS avg_profit,
         CASE WHEN COUNT(*) >= 10 THEN LEAST(GREATEST(0.5 + AVG(CAST(profit AS DOUBLE)) / 20000, 0), 1) ELSE 0.5 END AS reliability
  FROM prices WHERE trim(trader_name) IS NOT NULL AND trim(trader_name) <> '' GROUP BY trim(trader_name)
)"""


@register("category_performance", O.with_ctes(O.PRICES, CAT_PERF_CTE, body="SELECT * FROM cperf"),
          doubles=("avg_profit", "weight"))
def q_category_performance(spark, d):
    return L.category_performance(prices(spark, d, with_levels=False))


@register("trader_reliability", O.with_ctes(O.PRICES, TRADER_CTE, body="SELECT * FROM trel"),
          doubles=("avg_profit", "reliability"))
def q_trader_reliability(spark, d):
    return L.trader_reliability(prices(spark, d, with_levels=False))


CYCLE_CTE = """
cbase AS (
  SELECT ts AS cycle, CAST(profit AS DOUBLE) AS p,
    LEAST(GREATEST(CASE WHEN flea_price > 0 THEN profit / flea_price * 100 ELSE 0.0 END, -200), 200) AS r,
    trim(item_id) IS NOT NULL AND trim(item_id) <> '' AS ok
  FROM prices
),
cq AS (SELECT cycle, quantile_cont(p, 0.05) AS q05, quantile_cont(p, 0.95) AS q95 FROM cbase GROUP BY cycle),
cagg AS (
  SELECT b.cycle, COUNT(*) AS nrows, COUNT(*) FILTER (WHERE ok) AS items_processed,
    COUNT(*) FILTER (WHERE ok AND p > 0) AS profitable_count, AVG(p) AS avg_profit,
    AVG(LEAST(GREATEST(p, q05), q95)) AS pm, STDDEV_SAMP(LEAST(GREATEST(p, q05), q95)) AS ps,
    AVG(r) AS rm, STDDEV_SAMP(r) AS rs
  FROM cbase b JOIN cq ON b.cycle = cq.cycle GROUP BY b.cycle
),
cyc AS (
  SELECT cycle, items_processed, profitable_count, profitable_count / GREATEST(items_processed, 1) AS profitable_rate,
    COALESCE(avg_profit, 0.0) AS avg_profit, COALESCE(pm, 0.0) AS profit_mean,
    CASE WHEN nrows <= 1 OR ps IS NULL OR isnan(ps) OR ps = 0 THEN 1.0 ELSE ps END AS profit_std,
    COALESCE(rm, 0.0) AS roi_mean,
    CASE WHEN nrows <= 1 OR rs IS NULL OR isnan(rs) OR rs = 0 THEN 1.0 ELSE rs END AS roi_std
  FROM cagg
)"""


def cycles(spark, d):
    return L.cycle_stats(prices(spark, d, with_levels=False))


@register("cycle_stats", O.with_ctes(O.PRICES, CYCLE_CTE, body="SELECT * FROM cyc"),
          doubles=("profitable_rate", "avg_profit", "profit_mean", "profit_std", "roi_mean", "roi_std"))
def q_cycle_stats(spark, d):
    return cycles(spark, d)


@register("calibration_ema", O.with_ctes(O.PRICES, CYCLE_CTE, """
cyc2 AS (SELECT *, row_number() OVER (ORDER BY cycle) AS i, COUNT(*) OVER () AS n FROM cyc)""", body="""
SELECT COUNT(*) AS cycles,
  0.0 * pow(0.9, COUNT(*)) + COALESCE(SUM(0.1 * profit_mean * pow(0.9, n - i)), 0.0) AS profit_mean,
  1.0 * pow(0.9, COUNT(*)) + COALESCE(SUM(0.1 * profit_std * pow(0.9, n - i)), 0.0) AS profit_std,
  0.0 * pow(0.9, COUNT(*)) + COALESCE(SUM(0.1 * roi_mean * pow(0.9, n - i)), 0.0) AS roi_mean,
  1.0 * pow(0.9, COUNT(*)) + COALESCE(SUM(0.1 * roi_std * pow(0.9, n - i)), 0.0) AS roi_std
FROM cyc2"""), doubles=("profit_mean", "profit_std", "roi_mean", "roi_std"))
def q_calibration_ema(spark, d):
    return L.calibration_ema(cycles(spark, d))


@register("training_sessions", O.with_ctes(O.PRICES, CYCLE_CTE, body="""
SELECT * EXCLUDE (back) FROM (
  SELECT cycle, items_processed, profitable_count, profitable_rate, avg_profit,
    SUM(items_processed) OVER (ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total_items_seen,
    SUM(profitable_count) OVER (ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total_profitable_items,
    row_number() OVER (ORDER BY cycle DESC) AS back
  FROM cyc) WHERE back <= 1000"""), doubles=("profitable_rate", "avg_profit"))
def q_training_sessions(spark, d):
    return L.training_sessions(cycles(spark, d))


@register("daily_summary", O.with_ctes(O.PRICES, body="""
SELECT * EXCLUDE (back) FROM (
  SELECT CAST(ts AS DATE) AS date, COUNT(*) AS items, COUNT(*) FILTER (WHERE profit > 0) AS profitable,
         AVG(profit) AS avg_profit, MAX(profit) AS max_profit,
         row_number() OVER (ORDER BY CAST(ts AS DATE) DESC) AS back
  FROM prices GROUP BY CAST(ts AS DATE)) WHERE back <= 90"""), doubles=("avg_profit",))
def q_daily_summary(spark, d):
    return L.daily_summary(prices(spark, d, with_levels=False))


@register("top_learned_items", O.with_ctes(O.PRICES, ITEM_STATS_CTE, body="""
SELECT *, profitable_count / count * 100 AS profitable_rate FROM ist WHERE count >= 6
ORDER BY profit_mean * (consistency_score / 100) DESC, item_id LIMIT 20"""),
          doubles=ITEM_STAT_DOUBLES + ("profitable_rate",))
def q_top_learned_items(spark, d):
    return L.top_learned_items(item_stats(spark, d).select(*ITEM_STAT_COLS))


@register("category_trends", O.with_ctes(O.PRICES, CAT_PERF_CTE, body="""
SELECT *, profitable_items / total_items AS profitable_rate FROM cperf WHERE total_items >= 5"""),
          doubles=("avg_profit", "weight", "profitable_rate"))
def q_category_trends(spark, d):
    return L.category_trends(L.category_performance(prices(spark, d, with_levels=False)))


@register("learning_progress", O.with_ctes(O.PRICES, ITEM_STATS_CTE, CAT_PERF_CTE, TRADER_CTE, CYCLE_CTE, body="""
SELECT *, LEAST(100.0, unique_items_learned / 50 * 100) AS items_quality,
  LEAST(100.0, total_sessions / 100 * 100) AS sessions_quality,
  LEAST(100.0, total_samples / 10000 * 100) AS samples_quality,
  (LEAST(100.0, unique_items_learned / 50 * 100) + LEAST(100.0, total_sessions / 100 * 100)
   + LEAST(100.0, total_samples / 10000 * 100)) / 3 AS overall_quality,
  CAST(NULL AS DOUBLE) AS recent_accuracy
FROM (SELECT COUNT(*) AS unique_items_learned FROM ist), (SELECT COUNT(*) AS categories_tracked FROM cperf),
     (SELECT COUNT(*) AS traders_tracked FROM trel),
     (SELECT COUNT(*) AS total_sessions, CAST(COALESCE(SUM(items_processed), 0) AS BIGINT) AS total_samples FROM cyc)"""),
          doubles=("items_quality", "sessions_quality", "samples_quality", "overall_quality", "recent_accuracy"))
def q_learning_progress(spark, d):
    p = prices(spark, d, with_levels=False)
    return L.learning_progress(L.item_statistics(p), L.category_performance(p), L.trader_reliability(p),
                               L.cycle_stats(p))


TREND24 = """
trends AS (
  SELECT item_id, COUNT(*) AS data_points, AVG(profit) AS avg_profit, MIN(profit) AS min_profit, MAX(profit) AS max_profit,
         AVG(flea_price) AS avg_flea_price, AVG(trader_price) AS avg_trader_price, AVG(last_offer_count) AS avg_offers,
         MIN(ts) AS first_seen, MAX(ts) AS last_seen
  FROM prices WHERE ts > (SELECT MAX(ts) FROM prices) - INTERVAL 24 HOUR
  GROUP BY item_id HAVING COUNT(*) >= 2
)"""


@register("trend_learning_status", O.with_ctes(O.PRICES, TREND24, body="""
SELECT COUNT(*) > 0 AS enabled, COUNT(*) AS items_with_history,
  CAST(COALESCE(SUM(data_points), 0) AS BIGINT) AS total_data_points,
  COALESCE(AVG(data_points), 0.0) AS avg_data_points,
  CAST(LEAST(100, floor(COUNT(*) FILTER (WHERE data_points >= 12) / GREATEST(COUNT(*), 1) * 100)) AS INTEGER) AS learning_quality
FROM trends"""), doubles=("avg_data_points",))
def q_trend_learning_status(spark, d):
    return L.trend_learning_status(A.item_trend_data(prices(spark, d, with_levels=False, last_minutes=24 * 60), hours=24))


@register("item_trend_summary", O.with_ctes(O.PRICES, TREND24, body="""
SELECT *, CAST(max_profit - min_profit AS DOUBLE) AS profit_range FROM trends
WHERE item_id IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)"""),
          doubles=("avg_profit", "avg_flea_price", "avg_trader_price", "avg_offers", "profit_range"))
def q_item_trend_summary(spark, d):
    ids = read_table(spark, d, "part").select("p_partkey")
    return L.item_trend_summary(A.item_trend_data(prices(spark, d, with_levels=False, last_minutes=24 * 60), hours=24), ids)


@register("learned_retention", O.with_ctes(O.PRICES, ITEM_STATS_CTE, body=f"""
SELECT * FROM ist WHERE NOT (last_seen < TIMESTAMP '{O.NOW}' - INTERVAL 3 DAY)"""), doubles=ITEM_STAT_DOUBLES)
def q_learned_retention(spark, d):
    return L.learned_retention(item_stats(spark, d).select(*ITEM_STAT_COLS), now=O.NOW, days=3)


ENRICH_DOUBLES = ("learned_profit_mean", "learned_consistency", "category_weight", "trader_reliability",
                  "learned_score_adjustment", "profit_vs_learned")


@register("enrich_learned", O.with_ctes(O.PRICES, O.LATEST, O.METRICS, ITEM_STATS_CTE, CAT_PERF_CTE, TRADER_CTE,
                                        body="""
SELECT m.*,
  CASE WHEN i.count >= 6 THEN i.profit_mean ELSE CAST(m.profit AS DOUBLE) END AS learned_profit_mean,
  CASE WHEN i.count >= 6 THEN i.consistency_score ELSE 50.0 END AS learned_consistency,
  CAST(CASE WHEN i.count >= 6 THEN i.count ELSE 0 END AS BIGINT) AS learned_data_points,
  COALESCE(c.weight, 1.0) AS category_weight,
  COALESCE(t.reliability, 0.5) AS trader_reliability,
  CASE WHEN i.count >= 6 THEN (i.consistency_score - 50) / 50 * 20 ELSE 0.0 END AS learned_score_adjustment,
  CASE WHEN i.count >= 6 AND abs(i.profit_mean) > 1 THEN (m.profit - i.profit_mean) / abs(i.profit_mean)
       ELSE 0.0 END AS profit_vs_learned,
  CASE WHEN (CASE WHEN i.count >= 6 THEN (i.consistency_score - 50) / 50 * 20 ELSE 0.0 END) > 5 THEN '📈'
       WHEN (CASE WHEN i.count >= 6 THEN (i.consistency_score - 50) / 50 * 20 ELSE 0.0 END) < -5 THEN '📉'
       WHEN CASE WHEN i.count >= 6 THEN i.count ELSE 0 END >= 6 THEN '➡️' ELSE '🆕' END AS learned_trend_icon
FROM metrics m
LEFT JOIN ist i ON m.item_id = i.item_id
LEFT JOIN cperf c ON COALESCE(m.category, 'Unknown') = c.category
LEFT JOIN trel t ON COALESCE(m.trader_name, 'Unknown') = t.trader"""),
          doubles=tuple(sorted(set(("change_last_48h", "weight", "price_velocity", "liquidity_score", "roi",
                                    "profit_per_slot", "discount_percent", "profit_per_kg", "flea_to_base_ratio",
                                    "price_range_percent")) | set(ENRICH_DOUBLES))))
def q_enrich_learned(spark, d):
    p = prices(spark, d)
    snap = M.trade_metrics(A.latest_prices(p))
    return SC.enrich_learned(snap, L.item_statistics(p), L.category_performance(p), L.trader_reliability(p))
