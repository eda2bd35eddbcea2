"""Registered ML queries (#78-83): anomalies, clusters, similar items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anchored as A
from ..operators import metrics as M
from ..operators import scoring as SC
from ..operators.ml import cluster as CL
from ..operators.ml import iforest as IF
from ..operators.ml import neighbors as NB
from ..sources.testdata import prices
from . import oracle_sql as O
from .registry import register

ROW_KEY = ("item_id", "ts", "l_orderkey", "l_linenumber", "l_suppkey")


def snapshot_features(spark, d):
    return M.prepare_features(M.trade_metrics(A.latest_prices(prices(spark, d, last_minutes=45))))


def full_features(spark, d):
    return M.prepare_features(M.trade_metrics(prices(spark, d)))


SIM_COLS = ("target_id", "rank", "item_id", "name", "category", "profit", "distance", "similarity_score")

SIM_SQL = f"""
feat AS (
  SELECT *, CAST(width * height AS DOUBLE) AS f_slots,
    CASE WHEN flea_price > 0 THEN profit / flea_price ELSE 0.0 END AS f_ce,
    CASE WHEN width * height > 0 THEN profit / (width * height) ELSE 0.0 END AS f_pps
  FROM metrics
),
st AS (
  SELECT COUNT(*) AS n,
    AVG(CAST(profit AS DOUBLE)) AS mu0, STDDEV_POP(CAST(profit AS DOUBLE)) AS sd0,
    AVG(f_ce) AS mu1, STDDEV_POP(f_ce) AS sd1, AVG(f_pps) AS mu2, STDDEV_POP(f_pps) AS sd2,
    AVG(f_slots) AS mu3, STDDEV_POP(f_slots) AS sd3, AVG(COALESCE(weight, 0.0)) AS mu4, STDDEV_POP(COALESCE(weight, 0.0)) AS sd4
  FROM feat
),
cats AS (
  SELECT category AS cat, CASE WHEN COUNT(*) / MAX(n) > 0 AND COUNT(*) / MAX(n) < 1
                               THEN 1 / ((COUNT(*) / MAX(n)) * (1 - COUNT(*) / MAX(n))) ELSE 0.0 END AS icv
  FROM feat, st WHERE category IS NOT NULL GROUP BY category
),
pts AS (
  SELECT f.*,
    CASE WHEN sd0 > 0 THEN (profit - mu0) / sd0 ELSE 0.0 END AS z0,
    CASE WHEN sd1 > 0 THEN (f_ce - mu1) / sd1 ELSE 0.0 END AS z1,
    CASE WHEN sd2 > 0 THEN (f_pps - mu2) / sd2 ELSE 0.0 END AS z2,
    CASE WHEN sd3 > 0 THEN (f_slots - mu3) / sd3 ELSE 0.0 END AS z3,
    CASE WHEN sd4 > 0 THEN (COALESCE(weight, 0.0) - mu4) / sd4 ELSE 0.0 END AS z4,
    COALESCE(c.icv, 0.0) AS icv
  FROM feat f CROSS JOIN st LEFT JOIN cats c ON f.category = c.cat
),
targets AS (SELECT DISTINCT item_id AS target_id FROM metrics),
tp AS (
  SELECT * FROM (
    SELECT t.target_id, p.z0 AS t0, p.z1 AS t1, p.z2 AS t2, p.z3 AS t3, p.z4 AS t4, p.category AS tcat, p.icv AS ticv,
           row_number() OVER (PARTITION BY t.target_id ORDER BY p.item_id, p.ts, p.l_orderkey, p.l_linenumber, p.l_suppkey) AS rn
    FROM (SELECT DISTINCT target_id FROM targets) t JOIN pts p ON p.item_id = t.target_id) WHERE rn = 1
),
cand AS (
  SELECT tp.target_id, p.*,
    sqrt((p.z0 - t0) ** 2 + (p.z1 - t1) ** 2 + (p.z2 - t2) ** 2 + (p.z3 - t3) ** 2 + (p.z4 - t4) ** 2
         + CASE WHEN p.category IS NOT DISTINCT FROM tcat THEN 0.0 ELSE p.icv + ticv END) AS distance
  FROM pts p JOIN tp ON p.item_id <> tp.target_id
)"""


@register("similar_items", O.with_ctes(O.PRICES, O.LATEST, O.METRICS, SIM_SQL, body="""
SELECT target_id, rank, item_id, name, category, profit, distance, 1 / (1 + distance) AS similarity_score FROM (
  SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY distance, item_id, ts, l_orderkey, l_linenumber, l_suppkey) AS rank
  FROM cand) WHERE rank <= 5"""), doubles=("distance", "similarity_score"))
def q_similar_items(spark, d):
    snap = snapshot_features(spark, d)
    out = NB.similar_items(snap, snap.select("item_id"), k=5, row_key=ROW_KEY)
    return out.select(*SIM_COLS)


ANOMALY_COLS = ("item_id", "ts", "l_orderkey", "l_linenumber", "l_suppkey", "profit", "anomaly_score",
                "is_anomaly", "anomaly_type")


@register("isolation_forest", wide=True)
def q_isolation_forest(spark, d):
    """Every price row scored by a 100-tree forest (rows-only check; properties in tests)."""
    scored = IF.isolation_forest(full_features(spark, d), row_key=ROW_KEY)
    return SC.anomaly_type(scored).select(*ANOMALY_COLS)


@register("cluster_items")
def q_cluster_items(spark, d):
    out = CL.cluster_items(snapshot_features(spark, d))
    return out.select("item_id", "ts", "l_orderkey", "l_linenumber", "l_suppkey", "profit", "cluster",
                      "cluster_label", "cluster_confidence")


@register("cluster_summary")
def q_cluster_summary(spark, d):
    return CL.cluster_summary(SC.risk_score(CL.cluster_items(snapshot_features(spark, d))))


REC_COLS = ("item_id", "ts", "l_orderkey", "l_linenumber", "l_suppkey", "name", "category", "profit",
            "flea_price", "trend_enhanced_score", "risk_score", "risk_level", "is_anomaly", "anomaly_type",
            "cluster", "cluster_label", "cluster_confidence", "max_units", "potential_profit", "rec_score",
            "rec_tier", "trend_indicator", "has_learned_data")


@register("recommendations")
def q_recommendations(spark, d):
    """Flagship: latest snapshot ⟶ learned ⟶ trend score ⟶ anomalies ⟶ risk ⟶ clusters ⟶ filters."""
    from ..operators import learned as L
    from ..operators import recommend as RC
    p = prices(spark, d, with_levels=False)
    snap = M.trade_metrics(A.latest_prices(prices(spark, d, last_minutes=45)))
    learned = (L.item_statistics(p), L.category_performance(p), L.trader_reliability(p))
    recs = RC.recommendations(snap, A.item_trend_data(prices(spark, d, with_levels=False, last_minutes=24 * 60), hours=24), learned, row_key=ROW_KEY)
    return recs.select(*REC_COLS)
