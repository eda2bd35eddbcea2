"""#13, #50-59, #66-69: aggregates, pivots, rollups, histograms over a snapshot.

All are one-pass ``groupBy``/``agg`` plans (map-side partial aggregation, so a
hot key costs one small partial row per task, not a skewed shuffle).  Null
group keys are dropped where the dashboard's group-by drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantile import exact_quantile, grouped_quantiles
from .query import top_k
from .sequence import numbered

MAX_TRADERS = 10_000


def market_overview(df: DataFrame) -> DataFrame:
    """#50: total, profitable count and share, best profit, mean roi / sum of profitable."""
    prof = F.col("profit") > 0
    a = df.agg(F.count(F.lit(1)).alias("total_items"),
               F.count_if(prof).alias("profitable_count"),
               F.max("profit").alias("best_profit"),
               F.avg(F.when(prof, F.col("roi"))).alias("avg_roi"),
               F.sum(F.when(prof, F.col("profit"))).alias("total_potential"))
    return a.select(
        "total_items", "profitable_count",
        F.when(F.col("total_items") > 0, F.col("profitable_count") / F.col("total_items") * 100)
         .otherwise(F.lit(0.0)).alias("profitable_pct"),
        F.coalesce("best_profit", F.lit(0)).cast("bigint").alias("best_profit"),
        F.coalesce("avg_roi", F.lit(0.0)).alias("avg_roi"),
        F.coalesce("total_potential", F.lit(0)).cast("bigint").alias("total_potential"))


def category_stats(df: DataFrame) -> DataFrame:
    """#51 (+#46): per category count/mean/sum profit and profitable count (one pass)."""
    return (df.filter(F.col("category").isNotNull()).groupBy("category")
            .agg(F.count(F.lit(1)).alias("item_count"), F.avg("profit").alias("avg_profit"),
                 F.sum("profit").cast("bigint").alias("total_profit"),
                 F.count_if(F.col("profit") > 0).alias("profitable_count")))


def trader_stats(df: DataFrame) -> DataFrame:
    """#52: per trader count/mean/sum profit."""
    return (df.filter(F.col("trader_name").isNotNull()).groupBy("trader_name")
            .agg(F.count(F.lit(1)).alias("item_count"), F.avg("profit").alias("avg_profit"),
                 F.sum("profit").cast("bigint").alias("total_profit")))


def category_summary(df: DataFrame) -> DataFrame:
    """#53: per category totals / means / max, mean roi and price, item count."""
    return (df.filter(F.col("category").isNotNull()).groupBy("category")
            .agg(F.sum("profit").cast("bigint").alias("total_profit"),
                 F.avg("profit").alias("avg_profit"), F.max("profit").alias("max_profit"),
                 F.avg("roi").alias("avg_roi"), F.avg("flea_price").alias("avg_price"),
                 F.count(F.lit(1)).alias("items")))


def trader_summary(df: DataFrame) -> DataFrame:
    """#54: per trader stats plus profitable-only total and count."""
    prof = F.col("profit") > 0
    return (df.filter(F.col("trader_name").isNotNull()).groupBy("trader_name")
            .agg(F.avg("profit").alias("avg_profit"), F.max("profit").alias("best_profit"),
                 F.sum("profit").cast("bigint").alias("total_profit"),
                 F.avg("roi").alias("avg_roi"), F.avg("trader_price").alias("avg_payout"),
                 F.count(F.lit(1)).alias("items"),
                 F.coalesce(F.sum(F.when(prof, F.col("profit"))), F.lit(0)).cast("bigint")
                  .alias("profitable_total_profit"),
                 F.count_if(prof).alias("profitable_items")))


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """#67: counts per non-null value, most frequent first (ties by value)."""
    vc = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    if n is None:
        return vc
    return vc.orderBy(F.desc("count"), F.asc(column)).limit(int(n))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """#68: sorted distinct non-null values."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def profit_pivot(df: DataFrame, top: int = 10, traders=None, max_traders: int = MAX_TRADERS) -> DataFrame:
    """#55: top categories by count × trader -> mean profit, missing cells 0.

    The pivot values are listed up front (one small distinct job when not
    given) so Spark does not plan an extra discovery pass inside the pivot.  More than ``max_traders`` columns are
    refused: list the ones to show.
    """
    cats = value_counts(df, "category", top).select("category")
    sub = df.join(cats, "category", "left_semi").filter(F.col("trader_name").isNotNull())
    if traders is None:
        traders = [r[0] for r in sub.select("trader_name").distinct().orderBy("trader_name").limit(max_traders + 1).collect()]
        if len(traders) > max_traders:
            raise ValueError(f"more than {max_traders} traders; list those that the pivot shows")
    pv = sub.groupBy("category").pivot("trader_name", list(traders)).agg(F.avg("profit"))
    return pv.fillna(0.0, subset=[str(t) for t in traders])


def profit_hierarchy(df: DataFrame, top: int = 100) -> DataFrame:
    """#56: top profitable items rolled up category -> trader -> item.

    ``profit`` is the node sum; ``color`` the profit-weighted mean profit.
    """
    best = top_k(df.filter(F.col("profit") > 0), [("profit", True)], top)
    return (best.rollup("category", "trader_name", "name")
            .agg(F.sum("profit").cast("bigint").alias("profit"),
                 (F.sum(F.col("profit") * F.col("profit")) / F.sum("profit")).alias("color"),
                 F.grouping_id().alias("level_id")))


def histogram(df: DataFrame, column: str, bins: int = 50, below_quantile: float | None = None) -> DataFrame:
    """#57: equal-width bins between the column's min and max (last bin closed).

    ``below_quantile`` first keeps values strictly under that (linear) quantile.
    Bounds come from one global aggregate used as a scalar subquery.
    """
    src = df.filter(F.col(column).isNotNull())
    if below_quantile is not None:
        q = exact_quantile(src, column, below_quantile)
        src = src.filter(F.lit(False) if q is None else F.col(column) < F.lit(q))
    bounds = src.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    lo = bounds.select("lo").scalar()
    hi = bounds.select("hi").scalar()
    width = (hi - lo) / bins
    v = F.col(column).cast("double")
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((v - lo) / width), F.lit(bins - 1))).cast("int")
    return (src.select(b.alias("bin"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
            .select("bin", (lo + F.col("bin") * width).alias("bin_start"),
                    (lo + (F.col("bin") + 1) * width).alias("bin_end"), "count"))


def box_stats(df: DataFrame, value: str = "flea_price", group: str = "category", top: int = 8,
              approx: bool = False) -> DataFrame:
    """#58: quartiles, 1.5·IQR whiskers and outlier counts for the top groups.

    Quartiles are exact at any group size; ``approx=True`` switches to the ``percentile_approx`` sketch.
    """
    groups = value_counts(df, group, top).select(group)
    sub = df.join(groups, group, "left_semi").filter(F.col(value).isNotNull())
    qs = (0.25, 0.5, 0.75)
    if approx:
        sketch = F.percentile_approx(value, F.array(*map(F.lit, qs)), 10000)
        quart = sub.groupBy(group).agg(sketch.alias("q"), F.count(F.lit(1)).alias("n"))
    else:
        quart = grouped_quantiles(sub, group, value, qs)
    quart = quart.select(group, "n", *(F.col("q")[i].cast("double").alias(c) for i, c in enumerate(("q1", "median", "q3"))))
    j = sub.join(quart, group)
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    v = F.col(value)
    return (j.groupBy(group, "n", "q1", "median", "q3")
            .agg(F.min(F.when(v >= lo_f, v)).alias("whisker_low"),
                 F.max(F.when(v <= hi_f, v)).alias("whisker_high"),
                 F.count_if((v < lo_f) | (v > hi_f)).alias("outliers")))


def restriction_summary(df: DataFrame, unlock_level: int = 15) -> DataFrame:
    """#59: flag totals, counts by level, restricted (category, level) counts, type split.

    Long form ``(section, label, level, item_count)``; each section is its own
    small aggregate, unioned.
    """
    lvl = F.col("flea_level_required")
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.sum("no_flea").alias("nf"),
                    F.sum("marked_only").alias("mo"), F.count_if(lvl > unlock_level).alias("rs"))
    flags = totals.select(F.explode(F.array(
        F.struct(F.lit("no_flea").alias("label"), F.col("nf").cast("bigint").alias("c")),
        F.struct(F.lit("marked_only").alias("label"), F.col("mo").cast("bigint").alias("c")),
        F.struct(F.lit("level_restricted").alias("label"), F.col("rs").cast("bigint").alias("c")))).alias("s"))
    flags = flags.select(F.lit("flags").alias("section"), "s.label", F.lit(None).cast("int").alias("level"),
                         F.col("s.c").alias("item_count"))
    types = totals.select(F.explode(F.array(
        F.struct(F.lit("Flea Allowed").alias("label"), (F.col("n") - F.col("nf") - F.col("mo")).cast("bigint").alias("c")),
        F.struct(F.lit("No Flea").alias("label"), F.col("nf").cast("bigint").alias("c")),
        F.struct(F.lit("Marked Only").alias("label"), F.col("mo").cast("bigint").alias("c")))).alias("s"))
    types = types.filter(F.col("s.c") > 0).select(
        F.lit("types").alias("section"), "s.label", F.lit(None).cast("int").alias("level"),
        F.col("s.c").alias("item_count"))
    by_level = df.groupBy(lvl.alias("level")).agg(F.count(F.lit(1)).alias("item_count")).select(
        F.lit("by_level").alias("section"), F.lit(None).cast("string").alias("label"),
        F.col("level").cast("int"), "item_count")
    by_cat = (df.filter((lvl > unlock_level) & F.col("category").isNotNull())
              .groupBy("category", lvl.alias("level")).agg(F.count(F.lit(1)).alias("item_count"))
              .select(F.lit("restricted_by_category").alias("section"), F.col("category").alias("label"),
                      F.col("level").cast("int"), "item_count"))
    return flags.unionByName(types).unionByName(by_level).unionByName(by_cat)


def roi_price_points(df: DataFrame) -> DataFrame:
    """#69: profitable points of the ROI-vs-price chart."""
    return df.filter(F.col("profit") > 0).select("item_id", "name", "flea_price", "roi", "profit")


def price_trader_points(df: DataFrame) -> DataFrame:
    """#69: flea-vs-trader points with the break-even bound (max of both maxima)."""
    bound = df.select(F.greatest(F.max("flea_price"), F.max("trader_price"))).scalar()
    return df.select("item_id", "name", "flea_price", "trader_price", "profit",
                     bound.alias("break_even_max"))


def risk_opportunity_points(df: DataFrame) -> DataFrame:
    """#69: points of the risk-against-opportunity chart."""
    extra = [c for c in ("cluster_label",) if c in df.columns]
    return df.select("item_id", "name", "profit", "risk_score", "ml_opportunity_score", *extra)


def market_summary(df: DataFrame) -> DataFrame:
    """#13: report data as ``(section, ord, label, value)`` rows."""
    p = F.col("profit")
    ov = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(p > 0).alias("prof"),
                F.avg(F.when(p > 0, p)).alias("avgp"), F.max(p).alias("maxp"))
    overview = ov.select(F.explode(F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("total_items").alias("label"), F.col("total").cast("double").alias("value")),
        F.struct(F.lit(2).alias("ord"), F.lit("profitable_items").alias("label"), F.col("prof").cast("double").alias("value")),
        F.struct(F.lit(3).alias("ord"), F.lit("avg_profit").alias("label"), F.coalesce("avgp", F.lit(0.0)).alias("value")),
        F.struct(F.lit(4).alias("ord"), F.lit("max_profit").alias("label"), F.coalesce(F.col("maxp").cast("double"), F.lit(0.0)).alias("value")),
    )).alias("s")).select(F.lit("overview").alias("section"), "s.*")

    def ranked(frame, label_col, value_col, section, order):
        w = Window.orderBy(*order)
        return frame.select(F.lit(section).alias("section"), F.row_number().over(w).alias("ord"),
                            F.col(label_col).cast("string").alias("label"),
                            F.col(value_col).cast("double").alias("value"))

    cats = ranked(value_counts(df, "category", 10), "category", "count", "top_categories",
                  [F.desc("count"), F.asc("category")])
    traders = (numbered(value_counts(df, "trader_name"), [F.desc("count"), F.asc("trader_name")], out="_at")   # all of them
               .select(F.lit("traders").alias("section"), (F.col("_at") + 1).cast("int").alias("ord"),
                       F.col("trader_name").alias("label"), F.col("count").cast("double").alias("value")))
    items = top_k(df, [("profit", True)], 10)
    items = ranked(items, "name", "profit", "top_items", [F.desc("profit"), F.asc("item_id"), F.asc("ts"),
                                                          F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_suppkey")])
    return overview.unionByName(cats).unionByName(traders).unionByName(items)
