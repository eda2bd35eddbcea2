"""#30-35: per-row metrics and features (pure projections, whole-stage codegen).

Missing optional input columns are tolerated the way the dashboard tolerates
them: required numerics default to 0, optional feature groups are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.columns import clip, gdiv, liquidity_tier
from .small import small_side


def _ensure(df: DataFrame, cols, default=0) -> DataFrame:
    missing = {c: F.lit(default) for c in cols if c not in df.columns}
    return df.withColumns(missing) if missing else df


def trade_metrics(df: DataFrame) -> DataFrame:
    """#30: roi, slots, per-slot, discount, per-kg, base ratio, 24 h range, liquidity tier."""
    df = _ensure(df, ["profit", "flea_price", "width", "height", "avg_24h_price",
                      "low_24h_price", "weight"])
    p, flea, avg24 = F.col("profit"), F.col("flea_price"), F.col("avg_24h_price")
    slots = F.col("width") * F.col("height")
    disc = avg24 - flea
    cols = {
        "roi": gdiv(p, flea) * 100,
        "slots": slots,
        "profit_per_slot": gdiv(p, slots),
        "discount_from_avg": disc,
        "discount_percent": gdiv(disc, avg24) * 100,
        "profit_per_kg": gdiv(p, F.col("weight")),
    }
    if "base_price" in df.columns:
        cols["base_price"] = F.coalesce(F.col("base_price"), F.lit(0))
        cols["flea_to_base_ratio"] = gdiv(flea, F.coalesce(F.col("base_price"), F.lit(0)))
    if "high_24h_price" in df.columns:
        rng = F.coalesce(F.col("high_24h_price"), F.lit(0)) - F.col("low_24h_price")
        cols["high_24h_price"] = F.coalesce(F.col("high_24h_price"), F.lit(0))
        cols["price_range_24h"] = rng
        cols["price_range_percent"] = gdiv(rng, avg24) * 100
    if "last_offer_count" in df.columns:
        offers = F.coalesce(F.col("last_offer_count"), F.lit(0))
        cols["last_offer_count"] = offers
        cols["liquidity_tier"] = liquidity_tier(offers)
    if "trader_level_required" in df.columns:
        cols["trader_level_required"] = F.coalesce(F.col("trader_level_required"), F.lit(1)).cast("int")
    return df.withColumns(cols)


def opportunity_score(df: DataFrame) -> DataFrame:
    """#31: weighted 0-100 score against the frame's max profit and max roi.

    The two maxima are one global aggregate (a single tiny row) joined back as
    a scalar subquery — no shuffle of the rows themselves.
    """
    if "liquidity_score" not in df.columns or "price_velocity" not in df.columns:
        return df
    df = df.withColumns({"liquidity_score": F.coalesce("liquidity_score", F.lit(0.0)),
                         "price_velocity": F.coalesce("price_velocity", F.lit(0.0))})
    maxima = df.agg(F.max("profit").alias("mp"), F.max("roi").alias("mr"))
    mp = maxima.select(F.when(F.col("mp") > 0, F.col("mp")).otherwise(1).cast("double")).scalar()
    mr = maxima.select(F.when(F.col("mr") > 0, F.col("mr")).otherwise(1).cast("double")).scalar()
    score = (clip("profit", lo=0) / mp * 0.30
             + clip("roi", lo=0) / mr * 0.25
             + clip("liquidity_score", 0, 100) / 100 * 0.20
             + clip("price_velocity", 0, 100) / 100 * 0.15
             + clip("discount_percent", 0, 50) / 50 * 0.10) * 100
    return df.withColumn("opportunity_score", score)


def flip_features(df: DataFrame) -> DataFrame:
    """#32: margin, efficiency, density, spread, position, momentum, premiums, access."""
    p, flea, trader = F.col("profit"), F.col("flea_price"), F.col("trader_price")
    slots = F.col("width") * F.col("height")
    w = F.col("weight")
    cols = {
        "profit_margin": F.when(trader > 0, p / trader * 100).otherwise(F.lit(0.0)),
        "capital_efficiency": F.when(flea > 0, p / flea).otherwise(F.lit(0.0)),
        "slots": slots,
        "profit_per_slot": F.when(slots > 0, p / slots).otherwise(F.lit(0.0)),
        "density": F.when(slots > 0, w / slots).otherwise(F.lit(0.0)),
    }
    df = df.withColumns(cols)
    df = df.withColumn("profit_density", F.when(
        F.col("slots") * w > 0, p / (F.col("slots") * F.greatest(w, F.lit(0.1))))
        .otherwise(F.col("profit_per_slot")))
    more = {}
    if "high_24h_price" in df.columns and "low_24h_price" in df.columns:
        spread = F.col("high_24h_price") - F.col("low_24h_price")
        more["price_spread"] = spread
        more["price_spread_pct"] = F.when(F.col("avg_24h_price") > 0,
                                          spread / F.col("avg_24h_price") * 100).otherwise(F.lit(0.0))
        more["price_position"] = F.when(spread > 0, (flea - F.col("low_24h_price")) / spread) \
                                  .otherwise(F.lit(0.5))
    if "change_last_48h" in df.columns:
        m = F.coalesce(F.col("change_last_48h"), F.lit(0.0))
        more.update({"momentum": m, "momentum_abs": F.abs(m),
                     "is_declining": (m < -5).cast("int"), "is_rising": (m > 5).cast("int")})
    if "base_price" in df.columns:
        b = F.coalesce(F.col("base_price"), F.lit(0))
        more.update({"base_price": b,
                     "flea_premium": F.when(b > 0, (flea - b) / b * 100).otherwise(F.lit(0.0)),
                     "trader_premium": F.when(b > 0, (trader - b) / b * 100).otherwise(F.lit(0.0))})
    if "trader_level_required" in df.columns:
        lvl = F.coalesce(F.col("trader_level_required"), F.lit(1))
        more.update({"trader_level_required": lvl, "trader_accessibility": 5 - lvl})
    return df.withColumns(more) if more else df


def volume_features(df: DataFrame) -> DataFrame:
    """#33: volume-driven features; overwrites ``liquidity_score`` (as the scorer does)."""
    if "last_offer_count" not in df.columns:
        return df
    o = F.coalesce(F.col("last_offer_count"), F.lit(0))
    df = df.withColumn("last_offer_count", o)
    o = F.col("last_offer_count")
    lo, med, hi = S.VOLUME_MIN_FOR_RECOMMENDATION, S.VOLUME_MEDIUM, S.VOLUME_HIGH
    from ..functions.columns import volume_tier
    liq = F.when(o < lo, (o * 2).cast("double")).otherwise(
        F.least(o / med * 100, F.lit(float(S.MAX_LIQUIDITY_SCORE))))
    mult = F.when(o < lo, F.lit(0.1)).otherwise(clip(o / med, 0.2, 2.0))
    cols = {
        "log_offers": F.log1p(o),
        "liquidity_score": liq,
        "volume_tier": volume_tier(o),
        "volume_reliable": o >= lo,
        "market_saturation": F.when(o > hi, F.lit(1.0)).otherwise(o / hi),
        "volume_adjusted_profit": F.col("profit") * mult,
        "profit_per_offer": F.when(o > 0, F.col("profit") / F.log1p(o))
                             .otherwise(F.col("profit").cast("double")),
    }
    df = df.withColumns(cols)
    if "price_position" in df.columns:
        df = df.withColumn("buy_feasibility", F.when(o < lo, F.lit(10.0)).otherwise(
            F.col("liquidity_score") * 0.6 + (1 - F.col("price_position")) * 100 * 0.4))
    return df


def prepare_features(df: DataFrame) -> DataFrame:
    """#32 + #33 + #34 in the order the scorer applies them."""
    return category_target_encoding(volume_features(flip_features(df)))


def category_target_encoding(df: DataFrame, category: str = "category",
                             value: str = "profit", out: str = "category_avg_profit") -> DataFrame:
    """#34: mean profit of the row's category; null category -> 0.

    Partial per-category aggregation (skew-safe map-side combine), written once
    and broadcast to the rows if it is small, so that no row is moved to its
    category's task.
    """
    if category not in df.columns:
        return df
    means = (df.filter(F.col(category).isNotNull()).groupBy(category)
             .agg(F.avg(value).alias("_cat_mean")))
    j = df.join(small_side(means), category, "left")
    return j.withColumn(out, F.coalesce("_cat_mean", F.lit(0.0))).drop("_cat_mean")


def listing_fee(df: DataFrame, base: str = "base_price", sell: str = "flea_price",
                center_level=0, out: str = "listing_fee") -> DataFrame:
    """#35: flea listing fee as a column, plus profit net of the fee.

    base/sell <= 0 -> 0; sell >= base: base*.05*4^min(sell/base-1, 10), else
    base*.05; times the intel-center discount (level clamped 0..3); truncated;
    capped at 2e9.
    """
    b, s = F.col(base).cast("double"), F.col(sell).cast("double")
    ratio = F.least(s / b - 1, F.lit(float(S.FEE_MAX_RATIO_EXPONENT)))
    raw = F.when(s >= b, b * S.FEE_RATE * F.pow(F.lit(S.FEE_EXPONENT_BASE), ratio)) \
           .otherwise(b * S.FEE_RATE)
    lvl = F.lit(center_level) if not hasattr(center_level, "_jc") else center_level
    lvl = F.least(F.greatest(lvl.cast("int"), F.lit(0)), F.lit(3))
    disc = F.element_at(F.array(*[F.lit(x) for x in S.FEE_LEVEL_DISCOUNT]), lvl + 1)
    fee = F.least(F.floor(raw * disc), F.lit(S.FEE_CAP)).cast("bigint")
    fee = F.when((b <= 0) | (s <= 0) | b.isNull() | s.isNull(), F.lit(0).cast("bigint")).otherwise(fee)
    return df.withColumn(out, fee).withColumn("net_profit_after_fee", F.col("profit") - F.col(out))
