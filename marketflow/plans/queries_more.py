"""Registered queries for level tables, exports, learned lookups and the deterministic parts of the ML compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anchored as A
from ..operators import learned as L
from ..operators import levels as LV
from ..operators import metrics as M
from ..operators import query as Q
from ..operators import recommend as RC
from ..operators import scoring as SC
from ..operators import sinks as SK
from ..operators import summary as SM
from ..operators.sequence import numbered
from ..operators.ml import cluster as CL
from ..sources.testdata import prices, read_table
from . import oracle_sql as O
from . import queries_learned as QL
from . import queries_scoring as QS
from .queries_ingest import payload_from_prices
from .queries_ml import ROW_KEY, full_features, snapshot_features
from .registry import register

KEYS = "item_id, ts, l_orderkey, l_linenumber, l_suppkey"
KEY_COLS = ("item_id", "ts", "l_orderkey", "l_linenumber", "l_suppkey")

# --- #60, #61: level rules as a table --------------------------------------------------------------------

LEVEL_SQL = O.with_ctes(O.PRICES, """
p AS (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN ['none', 'promo'] WHEN 1 THEN ['Economy', 'PROMO'] ELSE [] END AS hb FROM prices)""",
    """
hit AS (
  SELECT *, (flea_level_required IN (30, 35, 40) AND regexp_matches(lower(coalesce(name, '')), 'hot plate|widget|(?:^|[\\s\\-_.,()\\[\\]])rod(?:$|[\\s\\-_.,()\\[\\]])'))
         OR lower(coalesce(category, '')) IN ('promo', 'economy', 'larges') AS direct FROM p)""", body=f"""
SELECT {KEYS}, CAST(CASE WHEN direct OR len(hb) = 0 THEN flea_level_required
  WHEN lower(hb[1]) = 'promo' THEN 25 WHEN lower(hb[1]) = 'economy' THEN 20 WHEN lower(hb[2]) = 'promo' THEN 25
  ELSE flea_level_required END AS INTEGER) AS flea_level_required FROM hit""")


@register("level_requirement", LEVEL_SQL)
def q_level_requirement(spark, d):
    p = prices(spark, d, with_levels=False)
    m = F.col("l_linenumber") % 3
    names = lambda *x: F.array(*[F.lit(v) for v in x])
    hb = F.when(m == 0, names("none", "promo")).when(m == 1, names("Economy", "PROMO")).otherwise(F.array().cast("array<string>"))
    out = LV.level_requirement(p.withColumn("_hb", hb), LV.rules_frame(spark), handbook="_hb")
    return out.select(*KEY_COLS, "flea_level_required")


@register("level_backfill", O.with_ctes(O.PRICES, """
s AS (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 99 WHEN 2 THEN 33 ELSE 15 END AS lvl FROM prices),
c AS (SELECT *, CASE WHEN lvl IS NULL THEN NULL WHEN category = 'LARGES' THEN 30 WHEN category = 'economy' THEN 20
                     WHEN category = 'PROMO' THEN 25 ELSE lvl END AS l0 FROM s),
i AS (SELECT *, CASE WHEN contains(lower(name), 'hot plate') AND l0 < 35 THEN 35 ELSE l0 END AS l1 FROM c),
j AS (SELECT *, CASE WHEN contains(lower(name), 'widget') AND l1 < 40 THEN 40 ELSE l1 END AS l2 FROM i)""", body=f"""
SELECT {KEYS}, CAST(CASE WHEN name = 'rod' AND l2 < 30 THEN 30 ELSE l2 END AS INTEGER) AS flea_level_required FROM j"""))
def q_level_backfill(spark, d):
    p = prices(spark, d, with_levels=False)
    m = F.col("l_linenumber") % 4
    stored = F.when(m == 1, 99).when(m == 2, 33).when(m == 3, 15)
    return LV.level_backfill(p.withColumn("flea_level_required", stored)).select(*KEY_COLS, "flea_level_required")


@register("lock_reference_table", O.with_ctes(O.PRICES, body="""
SELECT item_id, name, short_name, category, category AS handbook_categories,
  concat_ws(', ', CASE WHEN no_flea = 1 THEN 'noFlea' END, CASE WHEN marked_only = 1 THEN 'markedOnly' END, 'barter') AS types,
  no_flea = 1 AS no_flea, marked_only = 1 AS marked_only, base_price,
  CASE WHEN flea_price * 3 >= trader_price + 1000 AND flea_price > 0 THEN 'None' ELSE coalesce(trader_name, 'None') END AS best_trader,
  GREATEST(flea_price * 3, trader_price + 1000, 0) AS trader_price, flea_level_required, flea_level_required > 15 AS flea_locked
FROM prices"""))
def q_lock_reference_table(spark, d):
    return LV.lock_reference_table(payload_from_prices(prices(spark, d, with_levels=False)))


# --- #14: snapshot export; #69: risk points; #103, #105: learned lookups ------------------------------------

@register("market_snapshot", O.with_ctes(O.PRICES, O.LATEST, O.METRICS, body="""
SELECT 'csv' AS file, item_id, name, profit, roi, ts FROM metrics
UNION ALL SELECT 'json', item_id, name, profit, roi, ts FROM metrics"""), doubles=("roi",))
def q_market_snapshot(spark, d):
    snap = M.trade_metrics(A.latest_prices(prices(spark, d, last_minutes=45)))
    paths = SK.market_snapshot(snap, spark)
    # CSV is read by position: the schema names every written column.
    csv = spark.read.schema(snap.schema).option("header", True).csv(paths["csv"])
    json = spark.read.schema(snap.schema).json(paths["json"])
    both = [f.select(F.lit(n).alias("file"), "item_id", "name", "profit", "roi", "ts") for n, f in (("csv", csv), ("json", json))]
    return both[0].unionByName(both[1])


@register("risk_opportunity_points", O.with_ctes(*QS._SNAP_FEAT, body=f"""
SELECT item_id, name, profit, risk_score, ml_opportunity_score FROM ({QS.RISK_SQL.format(src='sscored')}) r"""),
          doubles=("risk_score", "ml_opportunity_score"))
def q_risk_opportunity_points(spark, d):
    return SM.risk_opportunity_points(SC.risk_score(SC.opportunity_ml(snapshot_features(spark, d), rank=False)))


@register("learned_item_score", O.with_ctes(O.PRICES, QL.ITEM_STATS_CTE, body="""
SELECT item_id, profit_mean AS learned_profit_mean, consistency_score AS learned_consistency, count AS data_points,
       first_seen, last_seen FROM ist"""), doubles=("learned_profit_mean", "learned_consistency"))
def q_learned_item_score(spark, d):
    return L.learned_item_score(QL.item_stats(spark, d), read_table(spark, d, "part").select("p_partkey"))


# The share of profitable quotes of a poll plays the accuracy of a training session; polls without one have null.
@register("recent_accuracy", O.with_ctes(O.PRICES, body="""
SELECT AVG(accuracy) AS recent_accuracy FROM (
  SELECT ts, CASE WHEN COUNT(*) > 1 THEN AVG(CASE WHEN profit > 0 THEN 1.0 ELSE 0.0 END) END AS accuracy
  FROM prices GROUP BY ts ORDER BY ts DESC LIMIT 10) q"""), doubles=("recent_accuracy",))
def q_recent_accuracy(spark, d):
    p = prices(spark, d, with_levels=False)
    share = F.when(F.count(F.lit(1)) > 1, F.avg(F.when(F.col("profit") > 0, 1.0).otherwise(0.0)))
    history = p.groupBy("ts").agg(share.alias("accuracy"))
    return L.learning_progress(L.item_statistics(p), L.category_performance(p), L.trader_reliability(p),
                               L.cycle_stats(p), accuracy=history).select("recent_accuracy")


# --- #79-82, #85: what follows from given flags, centres and clusters ---------------------------------------

@register("anomaly_type", O.with_ctes(O.PRICES, O.PMETRICS, O.features_cte("pmetrics"), body=f"""
SELECT {KEYS}, profit, CASE WHEN l_orderkey % 3 <> 0 THEN 'Normal'
  WHEN profit > 10000 AND last_offer_count < 10 THEN 'High Profit Low Volume (Risky)'
  WHEN profit > 5000 AND last_offer_count > 100 THEN 'High Profit High Volume (Opportunity!)'
  WHEN profit > flea_price * 0.5 THEN 'High Profit Opportunity' WHEN capital_efficiency > 0.5 THEN 'High ROI'
  WHEN price_position < 0.1 THEN 'Price Dip' WHEN flea_premium < -30 THEN 'Undervalued' ELSE 'Unusual Pattern' END AS anomaly_type
FROM features"""))
def q_anomaly_type(spark, d):
    f = full_features(spark, d).withColumn("is_anomaly", (F.col("l_orderkey") % 3 == 0).cast("int"))
    return SC.anomaly_type(f).select(*KEY_COLS, "profit", "anomaly_type")


# Centres along the first standardised feature (profit): clusters are bands of it.
CENTRES = (-1.5, -0.5, 0.25, 1.0, 2.0)
_Z = ("profit", "capital_efficiency", "profit_per_slot", "liquidity_score", "log_offers", "volume_adjusted_profit", "momentum", "price_spread_pct")
_STATS = ", ".join(f"AVG(CAST({c} AS DOUBLE)) OVER () AS mu{i}, STDDEV_POP(CAST({c} AS DOUBLE)) OVER () AS sd{i}" for i, c in enumerate(_Z))
_ZS = ", ".join(f"CASE WHEN sd{i} > 0 THEN (CAST({c} AS DOUBLE) - mu{i}) / sd{i} ELSE 0.0 END AS z{i}" for i, c in enumerate(_Z))
_REST = " + ".join(f"z{i} * z{i}" for i in range(1, len(_Z)))
_FAR = ", ".join(f"sqrt((z0 - ({v})) * (z0 - ({v})) + {_REST})" for v in CENTRES)
CLUSTER_CTE = f"""
zs AS (SELECT *, {_ZS} FROM (SELECT *, {_STATS} FROM sfeat) q),
ds AS (SELECT *, [{_FAR}] AS far FROM zs),
cl AS (SELECT *, CAST(list_position(far, list_min(far)) - 1 AS INTEGER) AS cluster, 1 / (1 + list_min(far)) AS cluster_confidence FROM ds),
means AS (SELECT cluster, AVG(profit) AS mp FROM cl GROUP BY cluster),
named AS (
  SELECT cluster, CASE rk WHEN 1 THEN '🥇 Elite Opportunities' WHEN 2 THEN '🥈 High Value' WHEN 3 THEN '🥉 Solid Picks'
    ELSE CASE WHEN mp < 0 THEN '⚠️ Avoid (Negative)' ELSE '📊 Standard' END END AS cluster_label
  FROM (SELECT *, CAST(floor(rank() OVER (ORDER BY mp DESC) + (COUNT(*) OVER (PARTITION BY mp) - 1) / 2) AS INTEGER) AS rk FROM means) q),
labelled AS (SELECT cl.*, cluster_label FROM cl JOIN named USING (cluster))"""
_CLUSTERED = (O.PRICES, O.LATEST, O.METRICS, O.features_cte("metrics", "sfeat"), CLUSTER_CTE)


def _clustered(spark, d):
    centres = [[v] + [0.0] * (len(_Z) - 1) for v in CENTRES]
    return CL.cluster_items(snapshot_features(spark, d), centres=centres)


@register("cluster_assign", O.with_ctes(*_CLUSTERED, body=f"SELECT {KEYS}, cluster, cluster_label, cluster_confidence FROM labelled"),
          doubles=("cluster_confidence",))
def q_cluster_assign(spark, d):
    """#80, #81 with given centres: assignment, confidence and labels."""
    return _clustered(spark, d).select(*KEY_COLS, "cluster", "cluster_label", "cluster_confidence")


@register("cluster_summary_fixed", O.with_ctes(*_CLUSTERED, body=f"""
SELECT cluster_label, AVG(profit) AS avg_profit, COUNT(*) AS items, AVG(risk_score) AS avg_risk
FROM ({QS.RISK_SQL.format(src='labelled')}) r GROUP BY cluster_label"""), doubles=("avg_profit", "avg_risk"))
def q_cluster_summary_fixed(spark, d):
    """#82 over clusters of given centres."""
    return CL.cluster_summary(SC.risk_score(_clustered(spark, d)))


_REC = (*QS._SNAP_FEAT, f"""
te AS ({QS.TREND_BODY.format(src="sscored")}),
te2 AS (
  SELECT *, LEAST(GREATEST(ml_opportunity_score * (1 - trend_confidence / 100 * 0.3)
    + (ml_opportunity_score + trend_bonus + consistency_bonus - volatility_penalty) * (trend_confidence / 100 * 0.3),
    0.0), 100.0) AS trend_enhanced_score FROM te),
rk AS ({QS.RISK_SQL.format(src="te2")}),
sc AS (
  SELECT *, LEAST(GREATEST(coalesce(trend_enhanced_score, 50.0) * 0.30 + (100 - risk_score) * 0.20 + 0.5 * 100 * 0.08
    + coalesce(liquidity_score, 50.0) * 0.12 + consistency_score / 100 * 12
    + CASE trend_direction WHEN 'Improving' THEN 5 WHEN 'Declining' THEN -5 ELSE 0 END, 0.0), 100.0) AS rec_score,
    CASE WHEN flea_price > 0 THEN GREATEST(CAST(floor(1000000 / flea_price) AS BIGINT), 0) END AS max_units FROM rk)""", """
rec AS (
SELECT * EXCLUDE (risk_score, risk_level, rec_score, max_units), risk_score, risk_level, rec_score, max_units, max_units * profit AS potential_profit,
  CASE WHEN rec_score > 0 AND rec_score <= 45 THEN 'Consider' WHEN rec_score > 45 AND rec_score <= 65 THEN 'Good'
       WHEN rec_score > 65 AND rec_score <= 80 THEN 'Great' WHEN rec_score > 80 AND rec_score <= 100 THEN 'Excellent' END AS rec_tier,
  CASE trend_direction WHEN 'Improving' THEN '📈' WHEN 'Declining' THEN '📉' WHEN 'Stable' THEN '➡️' ELSE '❓' END AS trend_indicator
FROM sc WHERE flea_level_required <= 15 AND coalesce(trader_level_required, 1) <= 4 AND risk_score <= 70 AND profit > 0 AND volume_reliable)""")


@register("recommendations_core", O.with_ctes(*_REC, body=f"""
SELECT {KEYS}, risk_score, risk_level, rec_score, max_units, potential_profit, rec_tier, trend_indicator FROM rec"""),
          doubles=("risk_score", "rec_score"))
def q_recommendations_core(spark, d):
    """#85 without the fitted parts: trend-adjusted score, risk, filters, units and tiers; clusters count 0.5."""
    return _recommended(spark, d).select(*KEY_COLS, "risk_score", "risk_level", "rec_score", "max_units", "potential_profit", "rec_tier", "trend_indicator")


def _recommended(spark, d):
    snap, trends = QS.snapshot_trends(spark, d)
    return RC.recommendations(snap, trends, row_key=ROW_KEY, anomalies=False, clusters=False)


_MONEY = "'₽' || format('{{:,}}', CAST(trunc(LEAST(GREATEST(CAST({c} AS DOUBLE), -999999999999), 999999999999)) AS BIGINT)) AS {c}"


@register("export_recommended", O.with_ctes(*_REC, body=f"""
SELECT name, {_MONEY.format(c='profit')},
  CASE WHEN roi IS NULL OR isinf(roi) OR isnan(roi) THEN '0.0%' ELSE format('{{:.1f}}', roi) || '%' END AS roi,
  {_MONEY.format(c='flea_price')}, {_MONEY.format(c='trader_price')}, trader_name, category, flea_level_required, last_offer_count,
  no_flea, marked_only, rec_score, rec_tier, risk_level FROM rec"""), doubles=("rec_score",))
def q_export_recommended(spark, d):
    """#15 on recommendations: all fourteen columns of the export."""
    return SK.export_frame(_recommended(spark, d))


# The explorer's sort orders: (option, column, SQL order).
_TEXT = {"roi": "CAST(CAST(round(roi, 4) AS DECIMAL(18, 4)) AS VARCHAR)"}
_SORTS = (("profit_desc", "profit", "profit DESC"), ("profit_asc", "profit", "profit"), ("roi_desc", "roi", "round(roi, 6) DESC"),
          ("flea_desc", "flea_price", "flea_price DESC"), ("flea_asc", "flea_price", "flea_price"), ("name_asc", "name", "name"),
          ("offers_desc", "last_offer_count", "last_offer_count DESC"))


@register("explore_sorted", O.with_ctes(O.PRICES, O.LATEST, O.METRICS, body=" UNION ALL ".join(f"""
SELECT '{n}' AS sort, row_number() OVER (ORDER BY {o}) AS place, {_TEXT.get(c, f'CAST({c} AS VARCHAR)')} AS value, '' AS icon_link
  FROM metrics WHERE flea_price >= 10 AND flea_price <= 3000 AND profit >= -100""" for n, c, o in _SORTS)))
def q_explore_sorted(spark, d):
    """#37: all rows in each of the seven sort orders, with their places, the icon column and price bounds."""
    snap = M.trade_metrics(A.latest_prices(prices(spark, d, last_minutes=45))).withColumn("icon_link", F.lit(""))
    snap = snap.checkpoint(eager=True)     # made once for all orders
    out = None
    for n, c, _ in _SORTS:
        rows = Q.explore_market(snap, min_flea=10, max_flea=3000, min_profit=-100, show_all_profits=True, sort=n)
        rows = numbered(rows, Q.total_order(rows, [Q.EXPLORE_SORTS[n]]), out="place")
        text = F.round("roi", 4).cast("decimal(18,4)") if c == "roi" else F.col(c)
        part = rows.select(F.lit(n).alias("sort"), (F.col("place") + 1).alias("place"), text.cast("string").alias("value"), "icon_link")
        out = part if out is None else out.unionByName(part)
    return out
