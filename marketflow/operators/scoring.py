"""#31, 62, 70-77, 45, 79: scores, risk and trend adjustments.

Global statistics (min, max, sample std per feature) are one aggregate row,
cross-joined as a broadcast (its size is fixed: one row), so every score stays
a per-row projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.columns import clip, finite_or, interval_label, learned_trend_icon, trend_direction
from .ranking import average_rank

VOLUME_OPTIONAL = ("liquidity_score", "volume_adjusted_profit", "profit_per_offer", "buy_feasibility")
OTHER_OPTIONAL = ("price_position", "momentum", "trader_accessibility", "market_saturation")


def opportunity_ml(df: DataFrame, rank: bool = True, place: str | None = None) -> DataFrame:
    """#62: stability-weighted min-max score (0-100); null when fewer than 10 rows.

    ``place`` is a helper column for the ranks (see ``average_rank``), which the result does not have.

    weight_f ∝ base_f / (std_f + .01) with the sample std (null/0 -> .01);
    scaled_f = (x - min)/(max - min), 0 on a constant column; price position and
    saturation are inverted after scaling.
    """
    feats = ["profit", "capital_efficiency", "profit_per_slot", "profit_density"]
    feats += [f for f in VOLUME_OPTIONAL + OTHER_OPTIONAL if f in df.columns]
    base = dict(S.OPPORTUNITY_WEIGHTS)
    x = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in feats}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(feats):
        aggs += [F.min(x[f]).alias(f"_mn{i}"), F.max(x[f]).alias(f"_mx{i}"),
                 F.stddev_samp(x[f]).alias(f"_sd{i}")]
    stats = df.agg(*aggs)
    raw = []
    for i, f in enumerate(feats):
        sd = F.col(f"_sd{i}")
        sd = F.when(sd.isNull() | (sd == 0) | F.isnan(sd), F.lit(0.01)).otherwise(sd)
        raw.append((F.lit(base.get(f, 0.05)) / (sd + 0.01)).alias(f"_w{i}"))
    stats = stats.select("*", *raw)
    total = sum(F.col(f"_w{i}") for i in range(len(feats)))
    stats = stats.select("*", total.alias("_wsum"))
    if rank:       # ranks are joined on scores, which another order of sums would change in the last bit
        stats = stats.checkpoint(eager=True)
    j = df.crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i, f in enumerate(feats):
        mn, mx = F.col(f"_mn{i}"), F.col(f"_mx{i}")
        scaled = F.when(mx > mn, (x[f] - mn) / (mx - mn)).otherwise(F.lit(0.0))
        if f in S.OPPORTUNITY_INVERTED:
            scaled = 1 - scaled
        score = score + scaled * (F.col(f"_w{i}") / F.col("_wsum"))
    out = j.withColumn("ml_opportunity_score",
                       F.when(F.col("_n") >= S.MIN_ITEMS_FOR_ANALYSIS, clip(score * 100, 0, 100)))
    out = out.drop(*[c for c in stats.columns])
    if rank:
        out = average_rank(out, "ml_opportunity_score", "opportunity_rank",
                           pct_out="opportunity_percentile", place=place)
    return out.drop(place) if place else out


def trend_features(df: DataFrame, trends: DataFrame | None) -> DataFrame:
    """#75 (+#44): join per-item window aggregates (#24) and derive trend features.

    No history at all (None, or a frame without rows) gives the neutral defaults.
    """
    if trends is None:
        return df.withColumns({"profit_trend": F.lit(0.0), "historical_volatility": F.lit(0.0),
                               "consistency_score": F.lit(50.0), "trend_confidence": F.lit(0.0),
                               "trend_direction": F.lit("Unknown")})
    avg_abs = F.abs(F.col("avg_profit"))
    vol = finite_or(F.when(avg_abs > 1, (F.col("max_profit") - F.col("min_profit")) / avg_abs)
                    .otherwise(F.lit(0.0)))
    t = trends.select(
        "item_id",
        F.col("avg_profit").cast("double").alias("historical_avg_profit"),
        vol.alias("historical_volatility"),
        ((F.col("min_profit") > 0).cast("double") * 30 + (1 - clip(vol, 0, 1)) * 40
         + clip(F.col("data_points") / S.TREND_MIN_DATA_POINTS, 0, 1) * 30).alias("consistency_score"),
        (clip(F.col("data_points") / (S.TREND_MIN_DATA_POINTS * 2), 0, 1) * 100).alias("trend_confidence"),
        F.col("data_points").alias("historical_data_points"),
        F.col("min_profit").alias("historical_min_profit"),
        F.col("max_profit").alias("historical_max_profit"))
    some = F.coalesce(trends.select((F.count(F.lit(1)) > 0).alias("some")).scalar(), F.lit(False))
    j = df.join(t, "item_id", "left")
    hist = F.coalesce(F.col("historical_avg_profit"), F.col("profit").cast("double"))
    j = j.withColumns({
        "historical_volatility": F.coalesce("historical_volatility", F.when(some, F.lit(0.5)).otherwise(F.lit(0.0))),
        "consistency_score": F.coalesce("consistency_score", F.lit(50.0)),
        "trend_confidence": F.coalesce("trend_confidence", F.lit(0.0)),
        "historical_data_points": F.coalesce("historical_data_points", F.lit(0)).cast("bigint"),
        "historical_avg_profit": hist,
    })
    pt = finite_or(F.when(F.abs(hist) > 1, (F.col("profit") - hist) / F.abs(hist)).otherwise(F.lit(0.0)))
    th = S.TREND_IMPROVEMENT_THRESHOLD
    j = j.withColumn("profit_trend", F.when(some, pt).otherwise(F.lit(0.0)))
    return j.withColumns({
        "trend_direction": F.when(some, trend_direction("profit_trend")).otherwise(F.lit("Unknown")),
        "trend_bonus": F.when(F.abs(F.col("profit_trend")) > th, F.col("profit_trend") * 0.20 * 100)
                        .otherwise(F.lit(0.0)),
        "consistency_bonus": (F.col("consistency_score") - 50) / 50 * 0.25 * 100,
        "volatility_penalty": clip("historical_volatility", 0, 1) * 0.15 * 100,
    })


def trend_enhanced_score(df: DataFrame, trends: DataFrame | None) -> DataFrame:
    """#76: blend of the learned score and trend adjustments, with rank (avg ties)."""
    f = trend_features(opportunity_ml(df), trends)
    b = F.col("ml_opportunity_score")
    w = F.col("trend_confidence") / 100
    bonus = (F.coalesce(F.col("trend_bonus"), F.lit(0.0)) if "trend_bonus" in f.columns else F.lit(0.0))
    cons = (F.col("consistency_bonus") if "consistency_bonus" in f.columns else F.lit(0.0))
    pen = (F.col("volatility_penalty") if "volatility_penalty" in f.columns else F.lit(0.0))
    raw = b * (1 - w * 0.3) + (b + bonus + cons - pen) * (w * 0.3)
    f = f.withColumn("trend_enhanced_score", clip(raw, 0, 100))
    return average_rank(f, "trend_enhanced_score", "trend_rank")


def risk_score(df: DataFrame) -> DataFrame:
    """#77 (+#71): weighted risk over the components whose inputs exist, and its level."""
    comps = []
    if "price_spread_pct" in df.columns:
        comps.append((clip(F.coalesce("price_spread_pct", F.lit(0.0)) / 50, 0, 1), 0.25))
    if "last_offer_count" in df.columns:
        comps.append((1 - clip(F.coalesce("last_offer_count", F.lit(0)) / 100, 0, 1), 0.20))
    if "momentum_abs" in df.columns:
        comps.append((clip(F.coalesce("momentum_abs", F.lit(0.0)) / 30, 0, 1), 0.20))
    if "profit_margin" in df.columns:
        comps.append((1 - clip(F.coalesce("profit_margin", F.lit(0.0)) / 30, 0, 1), 0.20))
    if "trader_level_required" in df.columns:
        comps.append(((F.coalesce("trader_level_required", F.lit(1)) - 1) / 3, 0.15))
    if comps:
        tw = sum(w for _, w in comps)
        score = sum(c * (w / tw) for c, w in comps) * 100
    else:
        score = F.lit(50.0)
    df = df.withColumn("risk_score", score.cast("double"))
    return df.withColumn("risk_level", interval_label("risk_score", S.RISK_LEVELS))


def anomaly_type(df: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    """#79: ordered rule labels for flagged rows; 'Normal' otherwise."""
    def c(name, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
    offers, profit = c("last_offer_count", 0), c("profit", 0)
    label = (F.when((profit > 10000) & (offers < S.VOLUME_LOW), "High Profit Low Volume (Risky)")
             .when((profit > 5000) & (offers > S.VOLUME_HIGH), "High Profit High Volume (Opportunity!)")
             .when(profit > c("flea_price", 1) * 0.5, "High Profit Opportunity")
             .when(c("capital_efficiency", 0) > 0.5, "High ROI")
             .when(c("price_position", 0.5) < 0.1, "Price Dip")
             .when(c("flea_premium", 0) < -30, "Undervalued")
             .otherwise("Unusual Pattern"))
    return df.withColumn("anomaly_type", F.when(F.col(flag) == 1, label).otherwise("Normal"))


def enrich_learned(df: DataFrame, items: DataFrame | None, categories: DataFrame | None,
                   traders: DataFrame | None) -> DataFrame:
    """#45: item / category / trader learned statistics as three left joins.

    Item stats are used only with >= 6 samples; missing lookups fall back to
    current profit / consistency 50 / weight 1.0 / reliability 0.5.
    """
    mp = S.TREND_MIN_DATA_POINTS
    out = df
    if items is not None:
        it = items.filter(F.col("count") >= mp).select(
            "item_id", F.col("profit_mean").alias("_lp"), F.col("consistency_score").alias("_lc"),
            F.col("count").alias("_ln"))
        out = out.join(it, "item_id", "left")
    else:
        out = out.withColumns({"_lp": F.lit(None).cast("double"), "_lc": F.lit(None).cast("double"),
                               "_ln": F.lit(None).cast("bigint")})
    cat_key = F.coalesce(F.col("category"), F.lit("Unknown")) if "category" in df.columns else F.lit("Unknown")
    tr_key = F.coalesce(F.col("trader_name"), F.lit("Unknown")) if "trader_name" in df.columns else F.lit("Unknown")
    out = out.withColumns({"_ck": cat_key, "_tk": tr_key})
    if categories is not None:
        out = out.join(categories.select(F.col("category").alias("_ck"), F.col("weight").alias("_cw")), "_ck", "left")
    else:
        out = out.withColumn("_cw", F.lit(None).cast("double"))
    if traders is not None:
        out = out.join(traders.select(F.col("trader").alias("_tk"), F.col("reliability").alias("_tr")), "_tk", "left")
    else:
        out = out.withColumn("_tr", F.lit(None).cast("double"))
    has = F.coalesce(F.col("_ln"), F.lit(0)) >= mp
    lp = F.coalesce(F.col("_lp"), F.col("profit").cast("double"))
    lc = F.coalesce(F.col("_lc"), F.lit(50.0))
    out = out.withColumns({
        "learned_profit_mean": lp, "learned_consistency": lc,
        "learned_data_points": F.coalesce(F.col("_ln"), F.lit(0)).cast("bigint"),
        "category_weight": F.coalesce(F.col("_cw"), F.lit(1.0)),
        "trader_reliability": F.coalesce(F.col("_tr"), F.lit(0.5)),
        "learned_score_adjustment": F.when(has, (lc - 50) / 50 * 20).otherwise(F.lit(0.0)),
        "profit_vs_learned": F.when(has & (F.abs(lp) > 1), (F.col("profit") - lp) / F.abs(lp))
                              .otherwise(F.lit(0.0)),
    })
    out = out.withColumn("learned_trend_icon",
                         learned_trend_icon("learned_score_adjustment", "learned_data_points"))
    return out.drop("_lp", "_lc", "_ln", "_ck", "_tk", "_cw", "_tr")
