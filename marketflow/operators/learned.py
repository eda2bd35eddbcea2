"""#94-105: statistics that outlive data retention, as keyed state tables.

The reference folds every polled row into per-item / per-category / per-trader
running statistics.  Over a table of polls that fold is an ordinary grouped
aggregation (Welford's running mean/variance equals the batch mean/sample
variance), and incremental maintenance is a merge of two partial states by
Chan's parallel formula — the form a ``foreachBatch`` upsert uses.  Every
aggregate is partial (map-side combined), so a hot item costs one partial row
per task.  Per-cycle series (sessions, calibration) are aggregated to one row
per poll first; that table is ordered by a prefix scan over range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.columns import clip, finite_or, ts_literal
from .quantile import grouped_quantiles
from .scan import AFFINE, prefix_scan
from .small import small_side

SEQ = ("l_orderkey", "l_linenumber", "l_suppkey")


def _order_key(df: DataFrame, ts: str, seq=SEQ) -> Column:
    """Processing order of a row: poll time, then position inside the poll."""
    return F.struct(F.col(ts).alias("t"), *[F.col(c).alias(f"s{i}")
                                           for i, c in enumerate(c for c in seq if c in df.columns)])


def _clean_text(c: str, default: str) -> Column:
    t = F.trim(F.col(c))
    return F.when(t.isNull() | (t == ""), F.lit(default)).otherwise(t)


def item_statistics(prices: DataFrame, ts: str = "ts", seq=SEQ, keep_key: bool = False) -> DataFrame:
    """#94 (+#95): one state row per item.

    Blank ids are skipped; NaN/inf numbers count as 0; blank category/trader
    become 'Unknown'; the last non-empty name wins.  ``profit_m2`` is the sum of
    squared deviations (the state Welford carries), so states can be merged.
    """
    df = prices.withColumn("_id", F.trim(F.col("item_id"))).filter(
        F.col("_id").isNotNull() & (F.col("_id") != ""))
    p = finite_or("profit")
    roi = finite_or(F.when(F.col("flea_price") > 0, F.col("profit") / F.col("flea_price") * 100)
                    .otherwise(F.lit(0.0)))
    key = _order_key(df, ts, seq)
    name = F.when(F.trim(F.col("name")) != "", F.trim(F.col("name")))
    st = df.groupBy(F.col("_id").alias("item_id")).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(p).alias("profit_mean"),
        (F.coalesce(F.var_samp(p), F.lit(0.0)) * (F.count(F.lit(1)) - 1)).alias("profit_m2"),
        F.min(p).alias("profit_min"), F.max(p).alias("profit_max"),
        F.avg(finite_or("flea_price")).alias("flea_price_mean"),
        F.avg(finite_or("last_offer_count")).alias("offers_mean"),
        F.avg(roi).alias("roi_mean"),
        F.avg(finite_or("liquidity_score")).alias("liquidity_mean"),
        F.count_if(p > 0).alias("profitable_count"),
        F.max_by(_clean_text("category", "Unknown"), key).alias("category"),
        F.max_by(_clean_text("trader_name", "Unknown"), key).alias("trader"),
        F.coalesce(F.max_by(name, F.when(name.isNotNull(), key)), F.lit("")).alias("item_name"),
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
        F.max(key).alias("last_key"), F.max(F.when(name.isNotNull(), key)).alias("name_key"))
    st = with_consistency(st)
    return st if keep_key else st.drop("last_key", "name_key")


def with_consistency(st: DataFrame) -> DataFrame:
    """#95: 100·(1 − std/|mean|) clipped to 0..100 with ≥2 samples and |mean| > 1, else 50."""
    n = F.col("count")
    std = F.sqrt(F.greatest(F.col("profit_m2") / (n - 1), F.lit(0.0)))
    cons = F.when((n >= 2) & (F.abs(F.col("profit_mean")) > 1),
                  clip(100 * (1 - std / F.abs(F.col("profit_mean"))), 0, 100)).otherwise(F.lit(50.0))
    return st.withColumns({"profit_std": F.when(n >= 2, std).otherwise(F.lit(0.0)),
                           "consistency_score": cons})


def merge_item_statistics(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Fold a batch's item statistics into a stored state (Chan et al. pairwise merge).

    Both inputs are ``item_statistics(..., keep_key=True)`` states; the result
    equals the statistics over the union of the underlying rows whatever the
    order the batches arrive in (the "latest" fields compare order keys).  A
    full outer join by item (both sides one row per item, so no key is hot).
    """
    a = state.alias("a")
    b = batch.alias("b")
    j = a.join(b, F.col("a.item_id") == F.col("b.item_id"), "full_outer")

    def side(c):
        return F.col(f"a.{c}"), F.col(f"b.{c}")

    na, nb = F.coalesce(F.col("a.count"), F.lit(0)), F.coalesce(F.col("b.count"), F.lit(0))
    n = na + nb

    def wmean(c):
        x, y = side(c)
        return (F.coalesce(x, F.lit(0.0)) * na + F.coalesce(y, F.lit(0.0)) * nb) / n

    ma, mb = side("profit_mean")
    delta = F.coalesce(mb, F.lit(0.0)) - F.coalesce(ma, F.lit(0.0))
    m2a, m2b = side("profit_m2")
    m2 = (F.coalesce(m2a, F.lit(0.0)) + F.coalesce(m2b, F.lit(0.0))
          + delta * delta * na * nb / n)
    ka, kb = side("last_key")
    newer = kb.isNotNull() & (ka.isNull() | (kb > ka))

    def latest(c):
        x, y = side(c)
        return F.when(newer, y).otherwise(x)

    na_, nb_ = side("item_name")
    nka, nkb = side("name_key")
    name_newer = nkb.isNotNull() & (nka.isNull() | (nkb > nka))
    out = j.select(
        F.coalesce(F.col("a.item_id"), F.col("b.item_id")).alias("item_id"),
        n.alias("count"),
        wmean("profit_mean").alias("profit_mean"),
        m2.alias("profit_m2"),
        F.least(*side("profit_min")).alias("profit_min"),
        F.greatest(*side("profit_max")).alias("profit_max"),
        wmean("flea_price_mean").alias("flea_price_mean"),
        wmean("offers_mean").alias("offers_mean"),
        wmean("roi_mean").alias("roi_mean"),
        wmean("liquidity_mean").alias("liquidity_mean"),
        (F.coalesce(F.col("a.profitable_count"), F.lit(0))
         + F.coalesce(F.col("b.profitable_count"), F.lit(0))).alias("profitable_count"),
        latest("category").alias("category"),
        latest("trader").alias("trader"),
        F.when(name_newer, nb_).otherwise(F.coalesce(na_, nb_, F.lit(""))).alias("item_name"),
        F.least(*side("first_seen")).alias("first_seen"),
        F.greatest(*side("last_seen")).alias("last_seen"),
        F.greatest(ka, kb).alias("last_key"), F.greatest(nka, nkb).alias("name_key"))
    return with_consistency(out)


def category_totals(prices: DataFrame) -> DataFrame:
    """#96 as a mergeable state: per category (blank skipped) count, profitable count and sum of profits."""
    c = F.trim(F.col("category"))
    return (prices.filter(c.isNotNull() & (c != "")).groupBy(c.alias("category"))
            .agg(F.count(F.lit(1)).alias("total_items"), F.count_if(F.col("profit") > 0).alias("profitable_items"),
                 F.sum(finite_or("profit")).alias("profit_sum")))


def weighted_categories(totals: DataFrame) -> DataFrame:
    """#96: mean profit, and weight .5 + profitable rate once 5 samples exist."""
    return totals.select("category", "total_items", "profitable_items", (F.col("profit_sum") / F.col("total_items")).alias("avg_profit"),
                         F.when(F.col("total_items") >= 5, 0.5 + F.col("profitable_items") / F.col("total_items"))
                         .otherwise(F.lit(1.0)).alias("weight"))


def category_performance(prices: DataFrame) -> DataFrame:
    """#96: per category count, profitable count, mean profit, weight."""
    return weighted_categories(category_totals(prices))


def trader_totals(prices: DataFrame) -> DataFrame:
    """#97 as a mergeable state: per trader (blank skipped) count and sum of profits."""
    t = F.trim(F.col("trader_name"))
    return (prices.filter(t.isNotNull() & (t != "")).groupBy(t.alias("trader"))
            .agg(F.count(F.lit(1)).alias("count"), F.sum(finite_or("profit")).alias("profit_sum")))


def reliable_traders(totals: DataFrame) -> DataFrame:
    """#97: mean profit, and reliability .5 + mean/20000 (clipped) once 10 samples exist."""
    avg = F.col("profit_sum") / F.col("count")
    return totals.select("trader", "count", avg.alias("avg_profit"),
                         F.when(F.col("count") >= 10, clip(0.5 + avg / 20000, 0, 1)).otherwise(F.lit(0.5)).alias("reliability"))


def trader_reliability(prices: DataFrame) -> DataFrame:
    """#97: per trader count, mean profit, reliability."""
    return reliable_traders(trader_totals(prices))


def merge_totals(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Sum two states of counts and sums by their key, the first column."""
    key, *sums = state.columns
    return state.unionByName(batch).groupBy(key).agg(*[F.sum(c).alias(c) for c in sums])


def newest_of(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the batch in place of the state's of the same key, the first column."""
    return state.join(batch.select(state.columns[0]), state.columns[0], "left_anti").unionByName(batch)


def cycle_stats(prices: DataFrame, ts: str = "ts") -> DataFrame:
    """Per poll: items processed, profitable, mean profit, and calibration inputs.

    One row per cycle (poll timestamp); the winsorisation bounds are exact
    per-cycle percentiles (linear interpolation) joined back by cycle.
    """
    valid_id = F.trim(F.col("item_id")).isNotNull() & (F.trim(F.col("item_id")) != "")
    roi = F.when(F.col("flea_price") > 0, F.col("profit") / F.col("flea_price") * 100).otherwise(F.lit(0.0))
    base = prices.select(F.col(ts).alias("cycle"), F.col("profit").cast("double").alias("_p"),
                         clip(roi, -200, 200).alias("_r"), valid_id.alias("_ok"))
    q = grouped_quantiles(base, "cycle", "_p", (0.05, 0.95)).select("cycle", F.col("q").alias("_q"))
    j = base.join(small_side(q), "cycle")     # a row a poll: never the rows to the polls
    wp = F.least(F.greatest(F.col("_p"), F.col("_q")[0]), F.col("_q")[1])
    agg = j.groupBy("cycle").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_ok")).alias("items_processed"),
        F.count_if(F.col("_ok") & (F.col("_p") > 0)).alias("profitable_count"),
        F.avg("_p").alias("avg_profit"),
        F.avg(wp).alias("_pm"), F.stddev_samp(wp).alias("_ps"),
        F.avg("_r").alias("_rm"), F.stddev_samp("_r").alias("_rs"))

    def fix_std(c):
        return F.when((F.col("rows") <= 1) | F.col(c).isNull() | F.isnan(F.col(c)) | (F.col(c) == 0),
                      F.lit(1.0)).otherwise(F.col(c))

    return agg.select(
        "cycle", "items_processed", "profitable_count",
        (F.col("profitable_count") / F.greatest(F.col("items_processed"), F.lit(1))).alias("profitable_rate"),
        finite_or("avg_profit").alias("avg_profit"),
        finite_or("_pm").alias("profit_mean"), fix_std("_ps").alias("profit_std"),
        finite_or("_rm").alias("roi_mean"), fix_std("_rs").alias("roi_std"))


MEASURES = ("profit_mean", "profit_std", "roi_mean", "roi_std")


def calibration_pairs(cycles: DataFrame, alpha: float = S.CALIBRATION_ALPHA) -> DataFrame:
    """#98 as a mergeable state: one row per poll, the map ``x -> decay * x + add`` that its smoothing step is.

    A row stands for a stretch of ``n`` polls, from ``cycle`` to ``last``; stretches that follow one another compose
    (``merged_pairs``) in any grouping.
    """
    return cycles.select("cycle", F.col("cycle").alias("last"), F.lit(1).cast("long").alias("n"), F.lit(1 - alpha).alias("decay"),
                         *[(F.lit(alpha) * F.col(k)).alias(f"add_{k}") for k in MEASURES])


def _after(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the decay of all stretches after each, as a logarithm."""
    known = pairs.withColumn("_log", F.log("decay"))
    total = known.agg(F.sum("_log").alias("_all"))
    upto = prefix_scan(known, ["cycle"], ["_log"], ["_upto"])
    return upto.crossJoin(F.broadcast(total)).withColumn("_rest", F.exp(F.col("_all") - F.col("_upto")))   # one row


def merged_pairs(pairs: DataFrame, before=None) -> DataFrame:
    """All stretches (those that end before ``before``) as one; the others stay."""
    old = pairs if before is None else pairs.filter(F.col("last") < ts_literal(before))
    one = _after(old).agg(F.min("cycle").alias("cycle"), F.max("last").alias("last"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                          F.exp(F.coalesce(F.sum("_log"), F.lit(0.0))).alias("decay"),
                          *[F.coalesce(F.sum(F.col(f"add_{k}") * F.col("_rest")), F.lit(0.0)).alias(f"add_{k}") for k in MEASURES])
    if before is None:
        return one
    return one.filter(F.col("n") > 0).unionByName(pairs.filter(~(F.col("last") < ts_literal(before))))


def smoothed(pairs: DataFrame, init=(0.0, 1.0, 0.0, 1.0)) -> DataFrame:
    """#98: the smoothed values after all polls, from (0, 1, 0, 1) on."""
    return merged_pairs(pairs).select(F.col("n").alias("cycles"), *[
        (F.lit(v) * F.col("decay") + F.col(f"add_{k}")).alias(k) for k, v in zip(MEASURES, init)])


def calibration_ema(cycles: DataFrame, alpha: float = S.CALIBRATION_ALPHA, init=(0.0, 1.0, 0.0, 1.0)) -> DataFrame:
    """#98: exponential smoothing over polls in time order."""
    return smoothed(calibration_pairs(cycles, alpha), init)


def calibration_path(cycles: DataFrame, alpha: float = S.CALIBRATION_ALPHA, init=(0.0, 1.0, 0.0, 1.0)) -> DataFrame:
    """#98: the smoothed values after each poll: a prefix scan of the polls' maps."""
    adds, sums = [f"add_{k}" for k in MEASURES], [f"_{k}" for k in MEASURES]
    run = prefix_scan(calibration_pairs(cycles, alpha), ["cycle"], ["decay", *adds], ["_d", *sums], AFFINE)
    return run.select("cycle", *[(F.lit(v) * F.col("_d") + F.col(f"_{k}")).alias(k) for k, v in zip(MEASURES, init)])


def training_sessions(cycles: DataFrame, keep: int | None = S.TRAINING_SESSION_CAP) -> DataFrame:
    """#99: the last ``keep`` sessions (None: all) with cumulative totals (one row per cycle)."""
    c = cycles.select("cycle", "items_processed", "profitable_count", "profitable_rate", "avg_profit", F.lit(1).alias("_one"))
    run = prefix_scan(c, ["cycle"], ["items_processed", "profitable_count", "_one"],
                      ["total_items_seen", "total_profitable_items", "_at"]).drop("_one")
    if keep is not None:
        last = cycles.agg(F.count(F.lit(1)).alias("_polls"))
        run = run.crossJoin(F.broadcast(last)).filter(F.col("_at") > F.col("_polls") - keep).drop("_polls")   # one row
    return run.drop("_at")


def daily_summary(prices: DataFrame, ts: str = "ts", keep: int | None = S.DAILY_SUMMARY_CAP) -> DataFrame:
    """#100: one summary per day (replaced by key), the latest ``keep`` days (None: all)."""
    d = (prices.groupBy(F.to_date(ts).alias("date"))
         .agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("profit") > 0).alias("profitable"),
              F.avg("profit").alias("avg_profit"), F.max("profit").alias("max_profit")))
    return d if keep is None else d.orderBy(F.desc("date")).limit(keep)


def top_learned_items(stats: DataFrame, n: int = 20, min_points: int = S.TREND_MIN_DATA_POINTS) -> DataFrame:
    """#101: items with enough samples, by consistency-weighted mean profit."""
    s = stats.filter(F.col("count") >= min_points).withColumns({
        "profitable_rate": F.col("profitable_count") / F.col("count") * 100,
        "_key": F.col("profit_mean") * (F.col("consistency_score") / 100)})
    return s.orderBy(F.desc("_key"), "item_id").limit(int(n)).drop("_key")


def category_trends(perf: DataFrame, min_items: int = 5) -> DataFrame:
    """#102: categories with >= 5 samples, profitable rate, by mean profit."""
    return (perf.filter(F.col("total_items") >= min_items)
            .withColumn("profitable_rate", F.col("profitable_items") / F.col("total_items"))
            .orderBy(F.desc("avg_profit"), "category"))


def learning_progress(stats: DataFrame, perf: DataFrame, traders: DataFrame,
                      cycles: DataFrame, accuracy: DataFrame | None = None, recent: int = 10) -> DataFrame:
    """#103: data-volume quality scores (items / sessions / samples) and their mean.

    ``accuracy`` (ts, accuracy) is the accuracy history; ``recent_accuracy`` is the mean of its newest ``recent``
    entries that have a value, null without any.
    """
    a = stats.agg(F.count(F.lit(1)).alias("unique_items_learned"))
    b = perf.agg(F.count(F.lit(1)).alias("categories_tracked"))
    c = traders.agg(F.count(F.lit(1)).alias("traders_tracked"))
    d = cycles.agg(F.count(F.lit(1)).alias("total_sessions"),
                   F.coalesce(F.sum("items_processed"), F.lit(0)).alias("total_samples"))
    j = a.crossJoin(b).crossJoin(c).crossJoin(d)   # four one-row aggregates
    last = (F.lit(None).cast("double") if accuracy is None else
            accuracy.orderBy(F.desc("ts")).limit(recent).select(F.avg("accuracy")).scalar())
    iq = F.least(F.lit(100.0), F.col("unique_items_learned") / 50 * 100)
    sq = F.least(F.lit(100.0), F.col("total_sessions") / 100 * 100)
    mq = F.least(F.lit(100.0), F.col("total_samples") / 10000 * 100)
    return j.select("*", iq.alias("items_quality"), sq.alias("sessions_quality"),
                    mq.alias("samples_quality"), ((iq + sq + mq) / 3).alias("overall_quality"),
                    last.alias("recent_accuracy"))


def trend_learning_status(trends: DataFrame, min_points: int = S.TREND_MIN_DATA_POINTS) -> DataFrame:
    """#104: coverage of the windowed per-item trend table (#24)."""
    a = trends.agg(F.count(F.lit(1)).alias("items_with_history"),
                   F.coalesce(F.sum("data_points"), F.lit(0)).cast("bigint").alias("total_data_points"),
                   F.coalesce(F.avg("data_points"), F.lit(0.0)).alias("avg_data_points"),
                   F.count_if(F.col("data_points") >= min_points * 2).alias("_good"))
    q = F.floor(F.col("_good") / F.greatest(F.col("items_with_history"), F.lit(1)) * 100)
    return a.select((F.col("items_with_history") > 0).alias("enabled"), "items_with_history",
                    "total_data_points", "avg_data_points",
                    F.least(F.lit(100), q.cast("int")).alias("learning_quality"))


def item_trend_summary(trends: DataFrame, item_ids: DataFrame) -> DataFrame:
    """#105: trend rows for the requested ids plus the profit range."""
    ids = item_ids.select(F.col(item_ids.columns[0]).cast("string").alias("item_id")).distinct()
    return (trends.join(ids, "item_id", "left_semi")
            .withColumn("profit_range", (F.col("max_profit") - F.col("min_profit")).cast("double")))


def learned_retention(stats: DataFrame, now, days: int = 30) -> DataFrame:
    """#18: keep learned items seen within ``days`` of ``now`` (days <= 0: keep all)."""
    if days <= 0:
        return stats
    cutoff = ts_literal(now) - F.make_dt_interval(F.lit(int(days)))
    return stats.filter(~(F.col("last_seen") < cutoff))


def learned_item_score(stats: DataFrame, item_ids: DataFrame | None = None) -> DataFrame:
    """#105: learned statistics of the requested items (all without ``item_ids``); untracked items give no row."""
    if item_ids is not None:
        ids = item_ids.select(F.trim(F.col(item_ids.columns[0]).cast("string")).alias("item_id")).distinct()
        stats = stats.join(ids, "item_id", "left_semi")
    return stats.select("item_id", F.col("profit_mean").alias("learned_profit_mean"),
                        F.col("consistency_score").alias("learned_consistency"), F.col("count").alias("data_points"),
                        "first_seen", "last_seen")
