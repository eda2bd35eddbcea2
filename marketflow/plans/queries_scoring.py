"""Registered feature, score, rank, rolling and forecast queries (#31-35, #62-65, #70-77, #84)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anchored as A
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import scoring as SC
from ..operators.ml import forecast as FC
from ..session import shuffles_freed
from ..sources.testdata import prices
from . import oracle_sql as O
from .queries import METRIC_DOUBLES, PRICE_DOUBLES, snapshot
from .registry import register

TIEBREAK = ("l_orderkey", "l_linenumber", "l_suppkey")
SEQ_ORDER = "ts, l_orderkey, l_linenumber, l_suppkey"

FEATURE_DOUBLES = tuple(sorted(set(METRIC_DOUBLES) | {
    "profit_margin", "capital_efficiency", "profit_per_slot", "density", "profit_density",
    "price_spread_pct", "price_position", "momentum", "momentum_abs", "flea_premium",
    "trader_premium", "log_offers", "market_saturation", "volume_adjusted_profit",
    "profit_per_offer", "buy_feasibility", "category_avg_profit"}))


def full_metrics(spark, d, place=None):
    """Trade metrics over every price row (the whole history, not only the snapshot)."""
    return M.trade_metrics(prices(spark, d, place=place))


def full_features(spark, d, place=None):
    return M.prepare_features(full_metrics(spark, d, place))


_FEAT = (O.PRICES, O.PMETRICS, O.features_cte("pmetrics"))


@register("flip_features", O.with_ctes(*_FEAT, body="SELECT * FROM features"), doubles=FEATURE_DOUBLES, wide=True)
def q_flip_features(spark, d):
    return full_features(spark, d)


@register("listing_fee", O.with_ctes(O.PRICES, body="""
SELECT item_id, ts, l_orderkey, l_linenumber, l_suppkey, base_price, flea_price, profit, listing_fee,
       profit - listing_fee AS net_profit_after_fee
FROM (SELECT *, CASE WHEN base_price <= 0 OR flea_price <= 0 OR base_price IS NULL OR flea_price IS NULL THEN 0
  ELSE CAST(LEAST(FLOOR(CASE WHEN flea_price >= base_price
         THEN base_price * 0.05 * pow(4.0, LEAST(flea_price / base_price - 1, 10.0))
         ELSE base_price * 0.05 END * 0.9), 2000000000) AS BIGINT) END AS listing_fee FROM prices)"""))
def q_listing_fee(spark, d):
    p = M.listing_fee(prices(spark, d, with_levels=False), center_level=2)
    return p.select("item_id", "ts", "l_orderkey", "l_linenumber", "l_suppkey", "base_price",
                    "flea_price", "profit", "listing_fee", "net_profit_after_fee")


@register("opportunity_score", O.with_ctes(O.PRICES, O.PMETRICS, body="""
SELECT m.*, (GREATEST(profit, 0) / mp * 0.30 + GREATEST(roi, 0) / mr * 0.25
   + LEAST(GREATEST(COALESCE(liquidity_score, 0.0), 0), 100) / 100 * 0.20
   + LEAST(GREATEST(COALESCE(price_velocity, 0.0), 0), 100) / 100 * 0.15
   + LEAST(GREATEST(discount_percent, 0), 50) / 50 * 0.10) * 100 AS opportunity_score
FROM pmetrics m, (SELECT CAST(CASE WHEN MAX(profit) > 0 THEN MAX(profit) ELSE 1 END AS DOUBLE) AS mp,
                         CAST(CASE WHEN MAX(roi) > 0 THEN MAX(roi) ELSE 1 END AS DOUBLE) AS mr FROM pmetrics) g"""),
          doubles=METRIC_DOUBLES + ("opportunity_score",))
def q_opportunity_score(spark, d):
    return M.opportunity_score(full_metrics(spark, d))


ML_DOUBLES = tuple(sorted(set(FEATURE_DOUBLES) | {"ml_opportunity_score", "opportunity_rank",
                                                  "opportunity_percentile"}))


@register("opportunity_ml", O.with_ctes(*_FEAT, O.ml_score_cte("features"), body="SELECT * FROM scored"),
          doubles=ML_DOUBLES, wide=True, placed=True)
def q_opportunity_ml(spark, d):
    with shuffles_freed(spark):
        return SC.opportunity_ml(full_features(spark, d, place="_place"), place="_place")


RISK_SQL = """
SELECT *, CASE WHEN risk_score > 0 AND risk_score <= 30 THEN 'Low' WHEN risk_score > 30 AND risk_score <= 60 THEN 'Medium'
               WHEN risk_score > 60 AND risk_score <= 100 THEN 'High' END AS risk_level
FROM (SELECT *, (LEAST(GREATEST(COALESCE(price_spread_pct, 0.0) / 50, 0), 1) * 0.25
   + (1 - LEAST(GREATEST(COALESCE(last_offer_count, 0) / 100, 0), 1)) * 0.20
   + LEAST(GREATEST(COALESCE(momentum_abs, 0.0) / 30, 0), 1) * 0.20
   + (1 - LEAST(GREATEST(COALESCE(profit_margin, 0.0) / 30, 0), 1)) * 0.20
   + (COALESCE(trader_level_required, 1) - 1) / 3 * 0.15) * 100 AS risk_score FROM {src})"""


@register("risk_score", O.with_ctes(*_FEAT, body=RISK_SQL.format(src="features")),
          doubles=FEATURE_DOUBLES + ("risk_score",), wide=True)
def q_risk_score(spark, d):
    return SC.risk_score(full_features(spark, d))


def snapshot_trends(spark, d):
    snap = A.latest_prices(prices(spark, d, last_minutes=45))
    return M.trade_metrics(snap), A.item_trend_data(prices(spark, d, with_levels=False, last_minutes=24 * 60), hours=24)


TREND_CTE = """
trends AS (
  SELECT item_id, COUNT(*) AS data_points, AVG(profit) AS avg_profit, MIN(profit) AS min_profit, MAX(profit) AS max_profit
  FROM prices WHERE ts > (SELECT MAX(ts) FROM prices) - INTERVAL 24 HOUR
  GROUP BY item_id HAVING COUNT(*) >= 2
),
tf AS (
  SELECT item_id, CAST(avg_profit AS DOUBLE) AS h_avg,
    CASE WHEN abs(avg_profit) > 1 THEN (max_profit - min_profit) / abs(avg_profit) ELSE 0.0 END AS h_vol,
    data_points, min_profit, max_profit
  FROM trends
)"""

TREND_BODY = """
SELECT * EXCLUDE (h_avg, h_vol, data_points, min_profit, max_profit, tf_item),
  CASE WHEN profit_trend IS NULL OR isnan(profit_trend) OR isinf(profit_trend) THEN 'Unknown'
       WHEN profit_trend > 0.05 THEN 'Improving' WHEN profit_trend < -0.05 THEN 'Declining' ELSE 'Stable' END AS trend_direction,
  CASE WHEN abs(profit_trend) > 0.05 THEN profit_trend * 0.20 * 100 ELSE 0.0 END AS trend_bonus,
  (consistency_score - 50) / 50 * 0.25 * 100 AS consistency_bonus,
  LEAST(GREATEST(historical_volatility, 0), 1) * 0.15 * 100 AS volatility_penalty
FROM (
  SELECT *, CASE WHEN abs(historical_avg_profit) > 1
                 THEN (profit - historical_avg_profit) / abs(historical_avg_profit) ELSE 0.0 END AS profit_trend
  FROM (
    SELECT b.*, tf.item_id AS tf_item, tf.h_avg, tf.h_vol, tf.data_points, tf.min_profit, tf.max_profit,
      COALESCE(tf.h_avg, CAST(b.profit AS DOUBLE)) AS historical_avg_profit,
      COALESCE(tf.h_vol, 0.5) AS historical_volatility,
      COALESCE(CAST(tf.min_profit > 0 AS DOUBLE) * 30 + (1 - LEAST(GREATEST(tf.h_vol, 0), 1)) * 40
               + LEAST(GREATEST(tf.data_points / 6, 0), 1) * 30, 50.0) AS consistency_score,
      COALESCE(LEAST(GREATEST(tf.data_points / 12, 0), 1) * 100, 0.0) AS trend_confidence,
      CAST(COALESCE(tf.data_points, 0) AS BIGINT) AS historical_data_points,
      tf.min_profit AS historical_min_profit, tf.max_profit AS historical_max_profit
    FROM {src} b LEFT JOIN tf ON b.item_id = tf.item_id))"""

TREND_DOUBLES = ("historical_avg_profit", "historical_volatility", "consistency_score", "trend_confidence",
                 "profit_trend", "trend_bonus", "consistency_bonus", "volatility_penalty")


@register("trend_features", O.with_ctes(*(O.PRICES, O.LATEST, O.METRICS), TREND_CTE,
                                        body=TREND_BODY.format(src="metrics")),
          doubles=METRIC_DOUBLES + TREND_DOUBLES)
def q_trend_features(spark, d):
    snap, trends = snapshot_trends(spark, d)
    return SC.trend_features(snap, trends)


_SNAP_FEAT = (O.PRICES, O.LATEST, O.METRICS, O.features_cte("metrics", "sfeat"),
              O.ml_score_cte("sfeat", "sscored"), TREND_CTE)


@register("trend_enhanced_score", O.with_ctes(*_SNAP_FEAT, f"""
te AS ({TREND_BODY.format(src="sscored")}),
te2 AS (
  SELECT *, LEAST(GREATEST(ml_opportunity_score * (1 - trend_confidence / 100 * 0.3)
    + (ml_opportunity_score + trend_bonus + consistency_bonus - volatility_penalty) * (trend_confidence / 100 * 0.3),
    0.0), 100.0) AS trend_enhanced_score FROM te)""", body="""
SELECT *, CAST(rank() OVER (ORDER BY trend_enhanced_score DESC NULLS LAST) AS DOUBLE)
          + (COUNT(*) OVER (PARTITION BY trend_enhanced_score) - 1) / 2.0 AS trend_rank
FROM te2"""), doubles=tuple(sorted(set(ML_DOUBLES) | set(TREND_DOUBLES) | {"trend_enhanced_score", "trend_rank"})))
def q_trend_enhanced_score(spark, d):
    snap, trends = snapshot_trends(spark, d)
    return SC.trend_enhanced_score(M.prepare_features(snap), trends)


# --- per-item time series (#64, #65, #84) ------------------------------------------

@register("rolling_means", O.with_ctes(O.PRICES, body=f"""
SELECT item_id, ts, flea_price, trader_price, profit,
  AVG(profit) OVER (PARTITION BY item_id ORDER BY {SEQ_ORDER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS sma_short,
  AVG(profit) OVER (PARTITION BY item_id ORDER BY {SEQ_ORDER} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS sma_long
FROM prices"""), doubles=("sma_short", "sma_long"))
def q_rolling_means(spark, d):
    h = prices(spark, d, with_levels=False).select("item_id", "ts", "flea_price", "trader_price", "profit",
                                                   *TIEBREAK)
    return R.rolling_means(h, tiebreak=TIEBREAK).drop(*TIEBREAK)


SEQ_CTE = f"""
seq AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {SEQ_ORDER}) - 1 AS x,
               COUNT(*) OVER (PARTITION BY item_id) AS n FROM prices)"""
DIR_CTE = """
dir AS (
  SELECT item_id, COUNT(*) AS k, arg_min(profit, x) AS first_p, arg_max(profit, x) AS last_p, AVG(profit) AS recent_avg
  FROM seq WHERE x >= n - 5 GROUP BY item_id
),
dir2 AS (
  SELECT item_id, recent_avg, CASE WHEN k > 1 THEN (last_p - first_p) / (k - 1) ELSE 0.0 END AS recent_trend FROM dir
)"""


@register("recent_direction", O.with_ctes(O.PRICES, SEQ_CTE, DIR_CTE, body="""
SELECT item_id, recent_trend,
  CASE WHEN recent_trend > 0 THEN 'increasing' WHEN recent_trend < 0 THEN 'decreasing' ELSE 'stable' END AS trend,
  recent_avg FROM dir2"""), doubles=("recent_trend", "recent_avg"))
def q_recent_direction(spark, d):
    return R.recent_direction(prices(spark, d, with_levels=False), tiebreak=TIEBREAK)


FORECAST_CTE = """
mom AS (
  SELECT item_id, COUNT(*) AS n, SUM(CAST(profit AS HUGEINT)) AS sy,
         SUM(CAST(profit AS HUGEINT) * profit) AS syy, SUM(CAST(x AS HUGEINT) * profit) AS sxy
  FROM seq GROUP BY item_id
),
fit0 AS (
  SELECT item_id, n, CAST(sy AS DOUBLE) / n AS mean_y,
    CAST(n AS DOUBLE) * (CAST(n AS DOUBLE) * n - 1) / 12 AS sxx,
    CAST(CAST(n AS HUGEINT) * syy - sy * sy AS DOUBLE) / n AS cyy,
    CAST(2 * sxy - (n - 1) * sy AS DOUBLE) / 2 AS cxy
  FROM mom
),
fit1 AS (SELECT *, cxy / (sxx + 1.0) AS slope FROM fit0),
fit2 AS (
  SELECT *, mean_y - slope * (n - 1) / 2 AS intercept,
    cyy - 2 * slope * cxy + slope * slope * sxx AS ss_res,
    CASE WHEN n > 1 THEN sqrt(GREATEST(cyy, 0.0) / (n - 1)) END AS sd
  FROM fit1
),
fit3 AS (
  SELECT *, LEAST(GREATEST(CASE WHEN cyy <> 0 THEN 1 - ss_res / cyy
                                WHEN abs(ss_res) < 1e-9 THEN 1.0 ELSE 0.0 END, 0.0), 1.0) AS r2,
    CASE WHEN sd IS NULL OR sd = 0 THEN 1.0 ELSE sd END / GREATEST(abs(mean_y) + 1, 1.0) AS vol
  FROM fit2
),
summary AS (
  SELECT f.item_id, f.n,
    CASE WHEN n >= 10 THEN slope END AS slope, CASE WHEN n >= 10 THEN intercept END AS intercept,
    CASE WHEN n >= 10 THEN r2 END AS r2,
    CASE WHEN n >= 10 THEN LEAST(GREATEST(r2 * 100 * (1 - LEAST(vol, 1.0)), 0.0), 100.0) ELSE 0.0 END AS confidence,
    CASE WHEN n < 10 THEN 'unknown' WHEN recent_trend > 0 THEN 'increasing' WHEN recent_trend < 0 THEN 'decreasing'
         ELSE 'stable' END AS trend,
    CASE WHEN n >= 10 THEN recent_avg ELSE 0.0 END AS recent_avg,
    CASE WHEN n >= 10 THEN vol ELSE 0.0 END AS volatility
  FROM fit3 f JOIN dir2 d ON f.item_id = d.item_id
)"""

FC_DOUBLES = ("slope", "intercept", "r2", "confidence", "recent_avg", "volatility")


@register("forecast_summary", O.with_ctes(O.PRICES, SEQ_CTE, DIR_CTE, FORECAST_CTE, body="SELECT * FROM summary"),
          doubles=FC_DOUBLES)
def q_forecast_summary(spark, d):
    return FC.forecast_summary(prices(spark, d, with_levels=False), tiebreak=TIEBREAK)


@register("profit_forecast", O.with_ctes(O.PRICES, SEQ_CTE, DIR_CTE, FORECAST_CTE, body="""
SELECT item_id, step, intercept + slope * (n - 1 + step) AS predicted_profit, confidence, trend, recent_avg, volatility
FROM summary, range(1, 13) r(step) WHERE slope IS NOT NULL"""),
          doubles=("predicted_profit", "confidence", "recent_avg", "volatility"))
def q_profit_forecast(spark, d):
    return FC.profit_forecast(prices(spark, d, with_levels=False), 12, tiebreak=TIEBREAK)
