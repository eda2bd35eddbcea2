"""#19-28: queries anchored at the newest timestamp *of the data*.

The anchor is a scalar subquery (``max(ts)``): Spark runs it once and feeds the
value into the filter.  Readers bound their scans from below by the window
(``sources.store.recent``, ``last_minutes`` of the test-data reader), which does
not change the anchor.  An empty table falls back to the session's local time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.columns import gdiv, ts_literal


def anchor(prices: DataFrame, ts: str = "ts") -> Column:
    """Newest timestamp in the data as a scalar-subquery column (now() when empty)."""
    return F.coalesce(prices.select(F.max(ts)).scalar(), F.localtimestamp())


def _minutes(n) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(n)), F.lit(0))


def _hours(n) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(int(n)), F.lit(0), F.lit(0))


def _valid_hours(hours, default):
    return hours if isinstance(hours, int) and not isinstance(hours, bool) and hours > 0 else default


def window_rows(prices: DataFrame, hours: int, ts: str = "ts") -> DataFrame:
    """Rows strictly newer than ``anchor - hours``."""
    return prices.filter(F.col(ts) > anchor(prices, ts) - _hours(hours))


def latest_prices(prices: DataFrame, lookback_minutes: int = S.LOOKBACK_WINDOW_MINUTES,
                  ts: str = "ts", order: bool = False) -> DataFrame:
    """#19: newest row(s) per item inside ``[anchor - lookback, anchor]``.

    All ties on the newest timestamp are kept.  Physically: partial
    ``max(ts)`` per item (map-side combined, skew-safe) and a left-semi join of
    the window back to it — AQE broadcasts the per-item side when it is small
    and splits skewed partitions otherwise.  No row_number: ties must survive.
    """
    recent = prices.filter(F.col(ts) >= anchor(prices, ts) - _minutes(lookback_minutes))
    newest = recent.groupBy("item_id").agg(F.max(ts).alias("_max_ts"))
    out = recent.join(newest, (recent["item_id"] == newest["item_id"])
                      & (recent[ts] == newest["_max_ts"]), "left_semi")
    return out.orderBy(F.desc("profit"), "item_id") if order else out


def latest_timestamp(prices: DataFrame, ts: str = "ts") -> DataFrame:
    """#20: ``max(ts)`` (null on an empty table)."""
    return prices.agg(F.max(ts).alias("latest_ts"))


def _clean_ids(item_ids):
    if item_ids is None:
        return None
    out = [str(i).strip() for i in item_ids if i is not None and str(i).strip()]
    return out or None


def _restrict(prices: DataFrame, item_ids) -> DataFrame:
    """Semi-join the prices with an id list (DataFrame or Python list)."""
    if item_ids is None:
        return prices
    if isinstance(item_ids, DataFrame):
        ids = item_ids.select(F.trim(F.col(item_ids.columns[0]).cast("string")).alias("_id")) \
                      .filter(F.col("_id") != "")
        return prices.join(ids, prices["item_id"] == ids["_id"], "left_semi")
    ids = _clean_ids(item_ids)
    if ids is None:
        return prices
    return prices.filter(F.col("item_id").isin(ids))


def item_history(prices: DataFrame, item_ids=None, ts: str = "ts") -> DataFrame:
    """#21: (item_id, ts, flea, trader, profit) ordered by item and time.

    The reference takes one id; here any id set (or all items) is served in
    one pass.  A blank id list means no rows, like a blank id.
    """
    if item_ids is not None and not isinstance(item_ids, DataFrame) and _clean_ids(item_ids) is None:
        return prices.limit(0).select("item_id", ts, "flea_price", "trader_price", "profit")
    return _restrict(prices, item_ids).select("item_id", ts, "flea_price", "trader_price", "profit")


def item_history_clean(history: DataFrame, ts: str = "ts") -> DataFrame:
    """#22: drop rows whose timestamp did not parse, for items that keep >1 rows.

    Items with a single raw row, or a single valid row, produce nothing (the
    chart needs at least two points).
    """
    per_item = history.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("_raw"), F.count(ts).alias("_valid"))
    keep = per_item.filter((F.col("_raw") > 1) & (F.col("_valid") > 1)).select("item_id")
    return history.filter(F.col(ts).isNotNull()).join(keep, "item_id", "left_semi")


def market_trends(prices: DataFrame, hours: int = 6, ts: str = "ts") -> DataFrame:
    """#23: per-item profit avg/min/max/count in the strict window (bad hours -> 6)."""
    h = _valid_hours(hours, 6)
    return (window_rows(prices, h, ts).groupBy("item_id")
            .agg(F.avg("profit").alias("avg_profit"), F.min("profit").alias("min_profit"),
                 F.max("profit").alias("max_profit"), F.count(F.lit(1)).alias("data_points")))


def item_trend_data(prices: DataFrame, item_ids=None, hours: int = 24, ts: str = "ts") -> DataFrame:
    """#24: ten aggregates per item in the strict window, items with >= 2 points."""
    h = _valid_hours(hours, 24)
    rows = _restrict(window_rows(prices, h, ts), item_ids)
    return (rows.groupBy("item_id")
            .agg(F.count(F.lit(1)).alias("data_points"),
                 F.avg("profit").alias("avg_profit"),
                 F.min("profit").alias("min_profit"),
                 F.max("profit").alias("max_profit"),
                 F.avg("flea_price").alias("avg_flea_price"),
                 F.avg("trader_price").alias("avg_trader_price"),
                 F.avg("last_offer_count").alias("avg_offers"),
                 F.min(ts).alias("first_seen"),
                 F.max(ts).alias("last_seen"))
            .filter(F.col("data_points") >= 2))


def profit_statistics(prices: DataFrame, hours: int = 24, ts: str = "ts",
                      approx_distinct: bool = False) -> DataFrame:
    """#25: one row of window statistics; nulls become 0 (bad hours -> 24).

    ``approx_distinct`` swaps the exact distinct count (a second shuffle by
    item) for HyperLogLog++ when only an estimate is needed at scale.
    """
    hours = _valid_hours(hours, 24)
    rows = window_rows(prices, hours, ts)
    distinct = (F.approx_count_distinct("item_id") if approx_distinct
                else F.count_distinct("item_id"))
    agg = rows.agg(distinct.alias("unique_items"),
                   F.count(F.lit(1)).alias("total_records"),
                   F.avg("profit").alias("avg_profit"),
                   F.min("profit").alias("min_profit"),
                   F.max("profit").alias("max_profit"),
                   F.avg("flea_price").alias("avg_flea_price"),
                   F.avg("last_offer_count").alias("avg_offers"))
    return agg.select(
        F.col("unique_items").cast("bigint").alias("unique_items"),
        F.col("total_records").cast("bigint").alias("total_records"),
        F.coalesce("avg_profit", F.lit(0.0)).alias("avg_profit"),
        F.coalesce("min_profit", F.lit(0)).cast("bigint").alias("min_profit"),
        F.coalesce("max_profit", F.lit(0)).cast("bigint").alias("max_profit"),
        F.coalesce("avg_flea_price", F.lit(0.0)).alias("avg_flea_price"),
        F.coalesce("avg_offers", F.lit(0.0)).alias("avg_offers"),
        F.lit(int(hours)).alias("data_hours"))


def table_health(prices: DataFrame, now, ts: str = "ts",
                 stale_hours: float = S.HEALTH_STALE_HOURS) -> DataFrame:
    """#26: counts, time range, age in hours and a status (healthy/warning)."""
    now_c = ts_literal(now)
    agg = prices.agg(F.count(F.lit(1)).alias("total_records"),
                     F.count_distinct("item_id").alias("unique_items"),
                     F.min(ts).alias("oldest_record"), F.max(ts).alias("newest_record"))
    age = F.when(F.col("newest_record").isNull(), F.lit(0.0)).otherwise(
        (F.unix_micros(now_c.cast("timestamp")) - F.unix_micros(F.col("newest_record").cast("timestamp")))
        .cast("double") / 3.6e9)
    return agg.select(
        "total_records", "unique_items", "oldest_record", "newest_record",
        age.alias("data_age_hours"),
        F.when(F.col("total_records") == 0, "warning")
         .when(age > stale_hours, "warning").otherwise("healthy").alias("status"),
        age_label(age).alias("age_label"))


def age_label(age_hours: Column) -> Column:
    """'just now' / 'Nm ago' / 'Hh Mm ago' (dashboard freshness text)."""
    mins = F.floor(age_hours * 60).cast("bigint")
    return (F.when(mins < 1, "just now")
            .when(mins < 60, F.format_string("%dm ago", mins))
            .otherwise(F.format_string("%dh %dm ago", F.floor(mins / 60).cast("bigint"),
                                       (mins % 60).cast("bigint"))))


def trend_volatility(trends: DataFrame, limit: int | None = None) -> DataFrame:
    """#27: ``(max - min) / |avg|``, 0 when avg is 0, on top of #23; ``limit`` keeps that many rows, None all."""
    out = trends.withColumn(
        "volatility", gdiv(F.col("max_profit") - F.col("min_profit"), F.abs(F.col("avg_profit"))))
    return out if limit is None else out.orderBy("item_id").limit(int(limit))


def market_with_trends(latest: DataFrame, trends: DataFrame) -> DataFrame:
    """#28: latest snapshot ⟕ 168 h trends with the dashboard's fills."""
    t = trends.select("item_id", F.col("avg_profit").alias("trend_avg"),
                      F.col("min_profit").alias("trend_min"),
                      F.col("max_profit").alias("trend_max"), "data_points")
    j = latest.join(t, "item_id", "left")
    return j.withColumns({
        "volatility": F.coalesce(F.coalesce("trend_max", "profit") - F.coalesce("trend_min", "profit"),
                                 F.lit(0)).cast("bigint"),
        "data_points": F.coalesce("data_points", F.lit(0)).cast("bigint"),
    })
