"""#86-93: threshold alerts with cooldown over market batches.

Rules are matched by shape.  Rules that name an item or a category meet their
rows in an equi-join, so there may be as many as there are items; the "first
matching item per rule" of a batch is a ``min_by`` over the batch sequence (partial
aggregation, so a rule that matches a third of all rows is one partial row per
task).  The first match of rules over all items comes from record highs
(``first_match``), without a pair of rule and item.  Cooldown over many batches is a
greedy walk per rule over its candidate *poll times*, seeded with the rule's last
firing — one row per rule and poll, not per item.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.columns import finite_or, ts_literal
from .first_match import first_matches, placed, replayed_matches
from .small import small_side

# Rule types and priorities as the alert engine names them.
PROFIT_THRESHOLD = "profit_threshold"
HIGH_ROI = "high_roi"
ITEM_WATCHLIST = "item_watchlist"
ARBITRAGE = "arbitrage_opportunity"
CATEGORY_ALERT = "category_alert"
ARBITRAGE_PROFIT = 5000

RULE_SCHEMA = ("id string, alert_type string, item_id string, item_name string, category string, "
               "threshold_value double, threshold_type string, priority string, enabled boolean, "
               "created_at timestamp_ntz, last_triggered timestamp_ntz, trigger_count int, "
               "cooldown_minutes int, message string")


def rule(id, alert_type, item_id=None, item_name=None, category=None, threshold_value=0.0,
         threshold_type="above", priority="medium", enabled=True, created_at=None, last_triggered=None,
         trigger_count=0, cooldown_minutes=S.ALERT_DEFAULT_COOLDOWN_MINUTES, message=None):
    return (id, alert_type, item_id, item_name, category, float(threshold_value), threshold_type, priority,
            bool(enabled), created_at, last_triggered, int(trigger_count), int(cooldown_minutes), message)


def default_rules() -> list[tuple]:
    """#92: the three rules created on first start."""
    return [rule(i, kind, threshold_value=v, priority=p, message=m) for i, kind, v, p, m in S.DEFAULT_ALERTS]


def watchlist_rule(item_id: str, item_name: str, profit_threshold: float = 5000) -> tuple:
    return rule(f"watchlist_{item_id}", ITEM_WATCHLIST, item_id=item_id, item_name=item_name,
                threshold_value=profit_threshold, priority="medium",
                cooldown_minutes=S.ALERT_DEFAULT_COOLDOWN_MINUTES,
                message=f"Watchlist item {item_name} reached profit threshold")


def rules_frame(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), RULE_SCHEMA)


def upsert_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """#92: add or replace rules by id (anti-join + union)."""
    return rules.join(new.select("id"), "id", "left_anti").unionByName(new)


def _ids(rules: DataFrame, ids) -> DataFrame:
    """Rule ids as a frame; a list is for a few of them."""
    if not isinstance(ids, DataFrame):
        ids = rules.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    return ids.select(F.col(ids.columns[0]).cast("string").alias("_id")).distinct()


def remove_rules(rules: DataFrame, ids) -> DataFrame:
    """#92: the rules but for those of ``ids``, a list or a frame."""
    return rules.join(_ids(rules, ids), F.col("id") == F.col("_id"), "left_anti")


def set_enabled(rules: DataFrame, ids, enabled: bool = True) -> DataFrame:
    """#92: switch the rules of ``ids``, a list or a frame, on or off."""
    named = rules.join(_ids(rules, ids), F.col("id") == F.col("_id"), "left")
    return named.withColumn("enabled", F.when(F.col("_id").isNotNull(), F.lit(enabled)).otherwise(F.col("enabled"))).drop("_id")


def watchlist_rules(items: DataFrame, profit_threshold: float = 5000) -> DataFrame:
    """#92: a watchlist rule for each (item_id, name) row."""
    sample = items.sparkSession.createDataFrame([watchlist_rule("", "", profit_threshold)], RULE_SCHEMA)
    text = {"id": F.concat(F.lit("watchlist_"), "_i"), "item_id": F.col("_i"), "item_name": F.col("_n"),
            "message": F.concat(F.lit("Watchlist item "), F.coalesce("_n", F.lit("None")), F.lit(" reached profit threshold"))}
    rows = items.select(F.col("item_id").cast("string").alias("_i"), F.col("name").alias("_n"))
    return rows.crossJoin(F.broadcast(sample.drop(*text))).select(*[text.get(c, F.col(c)).alias(c) for c in sample.columns])   # one row


def _item_value(items: DataFrame, name: str, default) -> Column:
    return finite_or(name, default) if name in items.columns else F.lit(default).cast("double")


def _prefixed(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("enabled")).select(*[F.col(c).alias(f"r_{c}") for c in rules.columns])


def _of_named() -> Column:
    return F.coalesce(F.col("r_item_id").isNotNull() & (F.col("r_item_id") != ""), F.lit(False))


def _of_all() -> Column:
    """Rules that look at every item: global thresholds, returns and arbitrage."""
    t = F.col("r_alert_type")
    return ((t == PROFIT_THRESHOLD) & ~_of_named()) | t.isin(HIGH_ROI, ARBITRAGE)


def _is_anomaly(items: DataFrame) -> Column:
    return F.coalesce(F.col("is_anomaly").cast("boolean"), F.lit(False)) if "is_anomaly" in items.columns else F.lit(False)


def alert_matches(items: DataFrame, rules: DataFrame) -> DataFrame:
    """#86: every (enabled rule, item row) pair that satisfies the rule, ignoring cooldown; rule columns are ``r_*``."""
    r = _prefixed(rules)
    return _keyed_matches(items, r, small_side).unionByName(_all_matches(items, r.filter(_of_all())))


def keyed_matches(items: DataFrame, rules: DataFrame) -> DataFrame:
    """The matches of enabled rules that name an item or a category; rule columns are ``r_*``."""
    return _keyed_matches(items, _prefixed(rules))


def thresholds(rules: DataFrame) -> DataFrame:
    """Enabled rules over all items with a cooldown as ``r_*`` columns, the number ``k`` of their measure and its least value ``v``."""
    return _thresholds(_prefixed(rules))


def _beyond(prof: Column) -> Column:
    thr = F.col("r_threshold_value")
    return (((F.col("r_threshold_type") == "above") & (prof >= thr)) | ((F.col("r_threshold_type") == "below") & (prof <= thr)))


def _keyed_matches(items: DataFrame, r: DataFrame, side: Callable[[DataFrame], DataFrame] = lambda r: r) -> DataFrame:
    """Matches of the rules that name an item or a category, by equi-joins; ``side`` prepares the rules of a join.

    With ``small_side`` rules that are few are broadcast, so a category's rows stay where they are.
    """
    prof = _item_value(items, "profit", 0.0)
    cat = F.col("category") if "category" in items.columns else F.lit(None).cast("string")
    t, thr = F.col("r_alert_type"), F.col("r_threshold_value")
    by_item = items.join(side(r.filter((t == ITEM_WATCHLIST) | ((t == PROFIT_THRESHOLD) & _of_named()))),
                         (F.trim(F.col("item_id").cast("string")) == F.col("r_item_id"))
                         & F.when(t == ITEM_WATCHLIST, prof >= thr).otherwise(_beyond(prof)))
    by_category = items.join(side(r.filter(t == CATEGORY_ALERT)), (cat == F.col("r_category")) & (prof >= thr))
    return by_item.unionByName(by_category)


def _all_matches(items: DataFrame, r: DataFrame) -> DataFrame:
    """All pairs of the rules over every item; only ``alert_matches`` and rules without cooldown need them."""
    prof, roi, t = _item_value(items, "profit", 0.0), _item_value(items, "roi", 0.0), F.col("r_alert_type")
    return items.join(r, F.when(t == PROFIT_THRESHOLD, _beyond(prof)).when(t == HIGH_ROI, roi >= F.col("r_threshold_value"))
                      .otherwise(_is_anomaly(items) & (prof > ARBITRAGE_PROFIT)))


def measures(items: DataFrame) -> list[Column]:
    """What rules over all items compare: profit, loss, return, and whether a row is an arbitrage."""
    prof = _item_value(items, "profit", 0.0)
    arbitrage = F.when(_is_anomaly(items) & (prof > ARBITRAGE_PROFIT), 1.0).otherwise(0.0)
    return [prof, -prof, _item_value(items, "roi", 0.0), arbitrage]


def _thresholds(r: DataFrame) -> DataFrame:
    """Rules over all items with a cooldown, as (measure, least value); a NaN threshold or another type matches nothing."""
    t, side, thr = F.col("r_alert_type"), F.col("r_threshold_type"), F.col("r_threshold_value")
    k = (F.when((t == PROFIT_THRESHOLD) & (side == "above"), 0).when((t == PROFIT_THRESHOLD) & (side == "below"), 1)
         .when(t == HIGH_ROI, 2).when(t == ARBITRAGE, 3))
    value = F.when(k == 1, -thr).when(k == 3, F.lit(1.0)).otherwise(thr)
    return (r.filter(_of_all() & (F.col("r_cooldown_minutes") > 0)).withColumns({"k": k, "v": value})
            .filter(F.col("k").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v")))


_PAYLOAD = ("item_id", "name", "profit", "roi")


def _payload_frame(items: DataFrame) -> DataFrame:
    return items if "roi" in items.columns else items.withColumn("roi", F.lit(None).cast("double"))


def notification_fields() -> list[Column]:
    """#89: the fields of a fired alert but its time."""
    return [F.col("r_id").alias("alert_id"), F.col("r_alert_type").alias("alert_type"),
            F.col("r_priority").alias("priority"), F.col("item_id"), F.col("name").alias("item_name"),
            F.col("profit"), F.col("roi"),
            F.coalesce(F.col("r_message"), F.concat(F.lit("Alert triggered for "),
                                                    F.coalesce(F.col("name"), F.lit("None")))).alias("message")]


def _notification(now_col: Column) -> list[Column]:
    """#89: the nine fields of a fired alert."""
    return [*notification_fields(), now_col.alias("triggered_at")]


def alert_fire(items: DataFrame, rules: DataFrame, now, seq=("l_orderkey", "l_linenumber", "l_suppkey")) -> DataFrame:
    """#87: notifications fired by one batch at time ``now``.

    A rule may fire only when enabled and ``now > last_triggered + cooldown``.
    With a positive cooldown it fires once, for the first matching item in
    batch order; with cooldown <= 0 it fires for every matching item.
    """
    now_c = ts_literal(now)
    ready = rules.filter(F.col("enabled") & (
        F.col("last_triggered").isNull()
        | (now_c > F.col("last_triggered") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("cooldown_minutes")))))
    r = _prefixed(ready).withColumn("_rule", F.monotonically_increasing_id()).checkpoint(eager=True)
    rcols = [c for c in r.columns if c.startswith("r_")]
    items = _payload_frame(items)
    order = [c for c in seq if c in items.columns] + ["item_id"]
    named = _keyed_matches(items, r, small_side)
    once = (named.filter(F.col("r_cooldown_minutes") > 0).groupBy(*rcols, "_rule")
            .agg(F.min_by(F.struct(*_PAYLOAD), F.struct(*order)).alias("_it")).select(*rcols, "_it.*"))
    first = first_matches(items, _thresholds(r).select("_rule", "k", "v"), measures(items), order, _PAYLOAD)
    once = once.unionByName(first.join(r, "_rule").select(*once.columns))
    free = _prefixed(ready).filter(F.col("r_cooldown_minutes") <= 0)     # as it came: its size is known, so it can be broadcast
    every = (_keyed_matches(items, free, small_side).unionByName(_all_matches(items, free.filter(_of_all())))).select(*once.columns)
    return once.unionByName(every).select(*_notification(now_c))


def rule_state_after(rules: DataFrame, fired: DataFrame, now) -> DataFrame:
    """#87: rule table after a batch: trigger_count += firings, last_triggered = now."""
    counts = fired.groupBy(F.col("alert_id").alias("id")).agg(F.count(F.lit(1)).alias("_fired"))
    j = rules.join(counts, "id", "left")
    fired_any = F.coalesce(F.col("_fired"), F.lit(0)) > 0
    return j.withColumns({
        "trigger_count": (F.col("trigger_count") + F.coalesce(F.col("_fired"), F.lit(0))).cast("int"),
        "last_triggered": F.when(fired_any, ts_literal(now)).otherwise(F.col("last_triggered")),
    }).drop("_fired")


def alert_cooldown_replay(history: DataFrame, rules: DataFrame, ts: str = "ts",
                          seq=("l_orderkey", "l_linenumber", "l_suppkey")) -> DataFrame:
    """#88: replay every poll of a price history through the rules, honouring cooldowns.

    Each poll is a batch stamped with its own time.  Per rule, the poll times
    with at least one match are walked in time order, keeping a time when it is
    strictly later than the last kept time plus the cooldown (cooldown <= 0 keeps
    every matching item of every poll, from the rule's last firing on).  The walk
    starts at the rule's ``last_triggered``.  The fired item of a kept poll is its
    first match in batch order.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    r = _prefixed(rules).withColumn("_rule", F.monotonically_increasing_id()).checkpoint(eager=True)
    rcols = [c for c in r.columns if c.startswith("r_")]
    history = _payload_frame(history)
    order = [c for c in seq if c in history.columns] + ["item_id"]
    gap = (F.col("r_cooldown_minutes") * F.lit(60_000_000).cast("long")).alias("gap")
    last = micros(F.col("r_last_triggered")).alias("last")

    # Every row has its place by time and batch order, so a first match is a least number; its fields are looked up at the end.
    more = [c for c in ("category",) if c in history.columns]
    values = measures(history)
    g = placed(history, values, ts, order, _PAYLOAD, *more)

    # Rules that name an item or a category: their polls with a match, walked rule by rule.
    named = _keyed_matches(g, r.filter(F.col("r_cooldown_minutes") > 0), small_side).select("_rule", "_t", "_g", last, gap)
    firsts = named.groupBy("_rule", "_t", "last", "gap").agg(F.min("_g").alias("_g")).checkpoint(eager=True)
    polls = firsts.select("_rule", F.col("_t").alias("t"), "last", "gap")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        gap, last = int(pdf["gap"].iloc[0]), pdf["last"].iloc[0]
        last, kept = None if pd.isna(last) else int(last), []
        for t in pdf["t"].sort_values():
            if last is None or t > last + gap:
                kept.append(t)
                last = t
        return pd.DataFrame({"k_rule": [pdf["_rule"].iloc[0]] * len(kept), "k_t": pd.Series(kept, dtype="int64")}).astype({"k_rule": "int64"})

    kept = polls.groupBy("_rule").applyInPandas(walk, "k_rule long, k_t long")
    once = (firsts.join(kept, (F.col("_rule") == F.col("k_rule")) & (F.col("_t") == F.col("k_t")), "left_semi")
            .select("_rule", "_t", "_g"))

    # Rules over all items: from firing to firing over the maxima of the polls.
    asked = _thresholds(r).select("_rule", "k", "v", gap, last).checkpoint(eager=True)
    once = once.unionByName(replayed_matches(g, asked, len(values)))
    time = F.timestamp_micros("_t").cast("timestamp_ntz").alias("_t")
    # Firings are few beside the rows, which stay where they are.
    once = g.select("_g", *_PAYLOAD).join(small_side(once), "_g").join(r, "_rule").select(*rcols, time, *_PAYLOAD)
    free = _prefixed(rules).filter(F.col("r_cooldown_minutes") <= 0)     # as it came: its size is known, so it can be broadcast
    m = _keyed_matches(history, free, small_side).unionByName(_all_matches(history, free.filter(_of_all())))
    every = (m.filter(F.col("r_last_triggered").isNull() | (
                F.col(ts) > F.col("r_last_triggered") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("r_cooldown_minutes"))))
             .select(*rcols, F.col(ts).alias("_t"), *_PAYLOAD))
    return once.unionByName(every).select(*_notification(F.col("_t")))


def alert_history(notifications: DataFrame, keep: int | None = S.ALERT_MAX_HISTORY) -> DataFrame:
    """#89: the newest ``keep`` notifications; None keeps all."""
    newest = notifications.orderBy(F.desc("triggered_at"), "alert_id", "item_id")
    return newest if keep is None else newest.limit(int(keep))


def recent_alerts(history: DataFrame, now, hours: int = 24) -> DataFrame:
    """#90: notifications newer than ``now - hours``, newest first."""
    cut = ts_literal(now) - F.make_dt_interval(F.lit(0), F.lit(int(hours)))
    return history.filter(F.col("triggered_at") > cut).orderBy(F.desc("triggered_at"), "alert_id", "item_id")


def alert_stats(rules: DataFrame, history: DataFrame) -> DataFrame:
    """#91: rule counts, total triggers and history size."""
    r = rules.agg(F.count(F.lit(1)).alias("total_alerts"),
                  F.count_if(F.col("enabled")).alias("enabled_alerts"),
                  F.coalesce(F.sum("trigger_count"), F.lit(0)).cast("bigint").alias("total_triggers"))
    h = history.agg(F.count(F.lit(1)).alias("history_count"))
    return r.crossJoin(h).select("total_alerts", "enabled_alerts",
                                 (F.col("total_alerts") - F.col("enabled_alerts")).alias("disabled_alerts"),
                                 "total_triggers", "history_count")
