"""#84 profit forecast for every item at once.

Per item the history is indexed 0..n-1 in time order (skew-safe index), and a
ridge line (alpha=1, free intercept) is fitted from moment sums.  The sums of
integer profits are taken as exact decimals, so the centred moments carry no
cancellation error; everything after that is a per-item projection.  Nothing
leaves Spark and no group is materialised in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ... import settings as S
from ..ranking import direction_of
from ..sequence import sequence_index


def forecast_summary(history: DataFrame, ts: str = "ts", value: str = "profit", alpha: float = 1.0,
                     min_points: int = S.MIN_ITEMS_FOR_ANALYSIS, tiebreak=()) -> DataFrame:
    """Per item: n, slope, intercept, r2, volatility, confidence, trend, recent_avg.

    Items with fewer than ``min_points`` rows get trend 'unknown' and zeros.
    """
    y = F.coalesce(F.col(value), F.lit(0)).cast("decimal(38,0)")
    narrow = history.select("item_id", ts, value, *(c for c in tiebreak if c not in (ts, value)))
    idx = sequence_index(narrow, "item_id", ts, tiebreak, out="_x", with_count="_n")     # one sort for the line and the direction
    m = idx.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).alias("_sy"),
        F.sum(y * y).alias("_syy"),
        F.sum(F.col("_x").cast("decimal(38,0)") * y).alias("_sxy"))
    n = F.col("n").cast("double")
    nd = F.col("n").cast("decimal(38,0)")
    sxx = n * (n * n - 1) / 12
    # centred sums, exact until the final cast
    c_yy = ((nd * F.col("_syy") - F.col("_sy") * F.col("_sy")).cast("double")) / n
    c_xy = ((2 * F.col("_sxy") - (nd - 1) * F.col("_sy")).cast("double")) / 2
    m = m.select("item_id", "n", (F.col("_sy").cast("double") / n).alias("_mean"),
                 sxx.alias("_sxx"), c_yy.alias("_cyy"), c_xy.alias("_cxy"))
    slope = F.col("_cxy") / (F.col("_sxx") + F.lit(alpha))
    m = m.withColumn("slope", slope)
    m = m.withColumn("intercept", F.col("_mean") - F.col("slope") * (F.col("n") - 1) / 2)
    ss_res = F.col("_cyy") - 2 * F.col("slope") * F.col("_cxy") + F.col("slope") * F.col("slope") * F.col("_sxx")
    r2 = F.when(F.col("_cyy") != 0, 1 - ss_res / F.col("_cyy")) \
          .otherwise(F.when(F.abs(ss_res) < 1e-9, F.lit(1.0)).otherwise(F.lit(0.0)))
    r2 = F.least(F.greatest(r2, F.lit(0.0)), F.lit(1.0))
    std = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("_cyy"), F.lit(0.0)) / (F.col("n") - 1)))
    std = F.when(std.isNull() | (std == 0), F.lit(1.0)).otherwise(std)
    vol = std / F.greatest(F.abs(F.col("_mean")) + 1, F.lit(1.0))
    m = m.withColumns({"r2": r2, "volatility": vol})
    conf = F.least(F.greatest(F.col("r2") * 100 * (1 - F.least(F.col("volatility"), F.lit(1.0))),
                              F.lit(0.0)), F.lit(100.0))
    m = m.withColumn("confidence", conf)
    d = direction_of(idx, value)
    j = m.join(d, "item_id")
    ok = F.col("n") >= min_points
    return j.select(
        "item_id", "n",
        F.when(ok, F.col("slope")).alias("slope"),
        F.when(ok, F.col("intercept")).alias("intercept"),
        F.when(ok, F.col("r2")).alias("r2"),
        F.when(ok, F.col("confidence")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(ok, F.col("trend")).otherwise(F.lit("unknown")).alias("trend"),
        F.when(ok, F.col("recent_avg")).otherwise(F.lit(0.0)).alias("recent_avg"),
        F.when(ok, F.col("volatility")).otherwise(F.lit(0.0)).alias("volatility"))


def profit_forecast(history: DataFrame, periods: int = 12, ts: str = "ts", value: str = "profit",
                    tiebreak=()) -> DataFrame:
    """Predicted profit for the next ``periods`` polls of every item with enough history.

    Long form: one row per (item, step); invalid ``periods`` falls back to 12.
    """
    if not isinstance(periods, int) or isinstance(periods, bool) or periods <= 0:
        periods = 12
    s = forecast_summary(history, ts, value, tiebreak=tiebreak).filter(F.col("slope").isNotNull())
    step = F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step")
    out = s.select("*", step)
    pred = F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))
    return out.select("item_id", "step", pred.alias("predicted_profit"), "confidence", "trend",
                      "recent_avg", "volatility")
