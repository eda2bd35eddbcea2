"""#85 trading recommendations: the composition of learned, trend, anomaly, risk and cluster scores.

The snapshot is featurised once and kept (it is one row per item, the frame
every stage reads); each stage adds columns, nothing is recomputed per stage.
Cluster and anomaly frames can be injected so that the deterministic part is
checkable on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.columns import clip, rec_tier, trend_indicator
from . import metrics as M
from . import scoring as SC
from .ml import cluster as CL
from .ml import iforest as IF


def recommendations(snapshot: DataFrame, trends: DataFrame | None, learned=None, player_level: int = 15,
                    capital: int = 1_000_000, risk_tolerance: str = "medium", use_trends: bool = True,
                    row_key=("item_id",), anomalies: bool = True, clusters: bool = True) -> DataFrame:
    """Recommended rows (accessible, within risk, profitable, reliable volume), best first.

    ``learned`` is ``(item_stats, category_perf, trader_reliability)`` or None.
    """
    f = snapshot
    if learned is not None:
        f = SC.enrich_learned(f, *learned)
    # Stage boundaries cut lineage into the shared checkpoint folder: the
    # snapshot is one row per item, and every later stage (forest sampling,
    # k scan, rank sketch) runs several jobs over it.
    f = M.prepare_features(f).checkpoint(eager=True)
    if use_trends:
        f = SC.trend_enhanced_score(f, trends)
        base = F.col("trend_enhanced_score")
    else:
        f = SC.opportunity_ml(f)
        base = F.col("ml_opportunity_score")
    f = f.checkpoint(eager=True)
    if anomalies:
        f = IF.isolation_forest(f, row_key=row_key)
        f = SC.anomaly_type(f)
    f = SC.risk_score(f).checkpoint(eager=True)
    if clusters:
        f = CL.cluster_items(f)
    else:
        f = f.withColumn("cluster_confidence", F.lit(0.5))

    def col_or(name, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in f.columns else F.lit(default)

    if player_level < S.FLEA_MARKET_UNLOCK_LEVEL:
        accessible = F.lit(False)
    else:
        accessible = col_or("trader_level_required", 1) <= 4
        if "flea_level_required" in f.columns:
            accessible = accessible & (F.col("flea_level_required") <= player_level)
    max_risk = S.RISK_TOLERANCE.get(risk_tolerance, 70)
    direction = col_or("trend_direction", "Unknown")
    dir_bonus = F.when(direction == "Improving", 5).when(direction == "Declining", -5).otherwise(0)
    score = (F.coalesce(base, F.lit(50.0)) * 0.30
             + (100 - F.col("risk_score")) * 0.20
             + F.col("cluster_confidence") * 100 * 0.08
             + col_or("liquidity_score", 50.0) * 0.12
             + col_or("consistency_score", 50.0) / 100 * 12
             + dir_bonus
             + col_or("learned_score_adjustment", 0.0)
             + (col_or("category_weight", 1.0) - 1) * 10
             + (col_or("trader_reliability", 0.5) - 0.5) * 10)
    units = F.when(F.col("flea_price") > 0,
                   F.greatest(F.floor(F.lit(capital) / F.col("flea_price")), F.lit(0))).cast("bigint")
    f = f.withColumns({
        "accessible": accessible,
        "within_risk": F.col("risk_score") <= max_risk,
        "max_units": units,
        "potential_profit": units * F.col("profit"),
        "rec_score": clip(score, 0, 100),
    })
    reliable = col_or("volume_reliable", True)
    out = f.filter(F.col("accessible") & F.col("within_risk") & (F.col("profit") > 0) & reliable)
    out = out.withColumns({
        "rec_tier": rec_tier("rec_score"),
        "trend_indicator": trend_indicator(direction),
        "has_learned_data": col_or("learned_data_points", 0) >= S.TREND_MIN_DATA_POINTS,
    })
    return out.orderBy(F.desc("rec_score"), *[F.col(c) for c in row_key])
