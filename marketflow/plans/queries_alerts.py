"""Registered alert queries (#86-92) over the price history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ts_literal
from ..operators import alerts as AL
from ..operators import anchored as A
from ..operators import metrics as M
from ..sources.testdata import prices, read_table
from . import oracle_sql as O
from .registry import register

# Rules used by the registered queries: the three shipped defaults, one
# category alert per category of the item catalogue, and a loss watch with no
# cooldown (fires for every matching item).
CATEGORY_THRESHOLD = 1000.0
CATEGORY_COOLDOWN = 60
LOSS_THRESHOLD = -1500.0
STATE_RULE = "high_roi_auto"          # for alert_fire: triggered 10 minutes before the batch
STATE_AGO_MINUTES = 10


def config_rules():
    return AL.default_rules() + [
        AL.rule("loss_watch", AL.PROFIT_THRESHOLD, threshold_value=LOSS_THRESHOLD, threshold_type="below",
                priority="low", cooldown_minutes=0, message="Item is selling at a loss")]


def rules(spark, d):
    base = AL.rules_frame(spark, config_rules())
    cats = (read_table(spark, d, "part").select(F.col("p_type").alias("category")).distinct()
            .select(F.concat(F.lit("category_"), F.col("category")).alias("id"),
                    F.lit(AL.CATEGORY_ALERT).alias("alert_type"), F.lit(None).cast("string").alias("item_id"),
                    F.lit(None).cast("string").alias("item_name"), "category",
                    F.lit(CATEGORY_THRESHOLD).alias("threshold_value"), F.lit("above").alias("threshold_type"),
                    F.lit("low").alias("priority"), F.lit(True).alias("enabled"),
                    F.lit(None).cast("timestamp_ntz").alias("created_at"),
                    F.lit(None).cast("timestamp_ntz").alias("last_triggered"),
                    F.lit(0).alias("trigger_count"), F.lit(CATEGORY_COOLDOWN).alias("cooldown_minutes"),
                    F.lit(None).cast("string").alias("message")))
    return base.unionByName(cats)


def history(spark, d):
    return M.trade_metrics(prices(spark, d, with_levels=False))


def _sql_rules():
    vals = []
    for r in config_rules():
        (rid, typ, iid, iname, cat, thr, tt, prio, en, _c, _l, cnt, cd, msg) = r

        def q(v):
            return "CAST(NULL AS VARCHAR)" if v is None else "'" + str(v).replace("'", "''") + "'"
        vals.append(f"({q(rid)}, {q(typ)}, {q(iid)}, {q(cat)}, {thr!r}, {q(tt)}, {q(prio)}, {str(en).upper()}, "
                    f"{cnt}, {cd}, {q(msg)})")
    return f"""
rules AS (
  SELECT * FROM (VALUES {', '.join(vals)})
    v(r_id, r_alert_type, r_item_id, r_category, r_threshold_value, r_threshold_type, r_priority, r_enabled,
      r_trigger_count, r_cooldown_minutes, r_message)
  UNION ALL
  SELECT 'category_' || p_type, 'category_alert', NULL, p_type, {CATEGORY_THRESHOLD}, 'above', 'low', TRUE, 0,
         {CATEGORY_COOLDOWN}, NULL FROM (SELECT DISTINCT p_type FROM part)
)"""


MATCH_ON = """
  r_enabled AND (
    (r_alert_type = 'profit_threshold' AND (r_item_id IS NULL OR r_item_id = '' OR r_item_id = trim(h.item_id))
      AND ((r_threshold_type = 'above' AND h.profit >= r_threshold_value)
        OR (r_threshold_type = 'below' AND h.profit <= r_threshold_value)))
    OR (r_alert_type = 'high_roi' AND h.roi >= r_threshold_value)
    OR (r_alert_type = 'item_watchlist' AND r_item_id = trim(h.item_id) AND h.profit >= r_threshold_value)
    OR (r_alert_type = 'category_alert' AND r_category = h.category AND h.profit >= r_threshold_value))"""

HIST = (O.PRICES, O.PMETRICS.replace("pmetrics AS (", "hist AS (", 1))


def _match_cte(src="hist"):
    return f"m AS (SELECT * FROM {src} h JOIN rules r ON {MATCH_ON})"


@register("alert_matches", O.with_ctes(*HIST, _sql_rules(), _match_cte(), body="""
SELECT r_id AS alert_id, item_id, ts, l_orderkey, l_linenumber, l_suppkey, profit, roi FROM m"""), doubles=("roi",))
def q_alert_matches(spark, d):
    m = AL.alert_matches(history(spark, d), rules(spark, d))
    return m.select(F.col("r_id").alias("alert_id"), "item_id", "ts", "l_orderkey", "l_linenumber", "l_suppkey",
                    "profit", "roi")


_SEQ = "(l_orderkey, l_linenumber, l_suppkey, item_id)"
NOTIFY = """r_id AS alert_id, r_alert_type AS alert_type, r_priority AS priority, item_id, name AS item_name,
  profit, roi, COALESCE(r_message, 'Alert triggered for ' || COALESCE(name, 'None')) AS message"""

REPLAY_SQL = "WITH RECURSIVE " + ",\n".join(c.strip() for c in (*HIST, _sql_rules(), _match_cte(), f"""
firsts AS (
  SELECT r_id, r_alert_type, r_priority, r_message, r_cooldown_minutes, ts AS t,
    arg_min(item_id, {_SEQ}) AS item_id, arg_min(name, {_SEQ}) AS name,
    arg_min(profit, {_SEQ}) AS profit, arg_min(roi, {_SEQ}) AS roi
  FROM m GROUP BY r_id, r_alert_type, r_priority, r_message, r_cooldown_minutes, ts
)""", """
fires(r_id, t) AS (
  SELECT r_id, MIN(t) FROM firsts WHERE r_cooldown_minutes > 0 GROUP BY r_id
  UNION ALL
  SELECT f.r_id, (SELECT MIN(c.t) FROM firsts c
                  WHERE c.r_id = f.r_id AND c.t > f.t + to_minutes(CAST(c.r_cooldown_minutes AS BIGINT)))
  FROM fires f WHERE f.t IS NOT NULL
)""", f"""
notifications AS (
  SELECT {NOTIFY}, t AS triggered_at FROM firsts WHERE (r_id, t) IN (SELECT (r_id, t) FROM fires WHERE t IS NOT NULL)
  UNION ALL
  SELECT {NOTIFY}, ts AS triggered_at FROM m WHERE r_cooldown_minutes <= 0
)""")) + "\n"


def replay(spark, d):
    return AL.alert_cooldown_replay(history(spark, d), rules(spark, d))


@register("alert_cooldown_replay", REPLAY_SQL + "SELECT * FROM notifications", doubles=("roi",))
def q_alert_cooldown_replay(spark, d):
    return replay(spark, d)


@register("alert_history", REPLAY_SQL + """
SELECT * FROM notifications ORDER BY triggered_at DESC, alert_id, item_id LIMIT 500""", doubles=("roi",))
def q_alert_history(spark, d):
    return AL.alert_history(replay(spark, d))


@register("recent_alerts", REPLAY_SQL + f"""
SELECT * FROM notifications WHERE triggered_at > TIMESTAMP '{O.NOW}' - INTERVAL 24 HOUR""", doubles=("roi",))
def q_recent_alerts(spark, d):
    return AL.recent_alerts(replay(spark, d), O.NOW, 24)


@register("alert_stats", REPLAY_SQL + """
SELECT total_alerts, enabled_alerts, total_alerts - enabled_alerts AS disabled_alerts, total_triggers, history_count
FROM (SELECT COUNT(*) AS total_alerts, COUNT(*) FILTER (WHERE r_enabled) AS enabled_alerts FROM rules),
     (SELECT CAST(COUNT(*) AS BIGINT) AS total_triggers, COUNT(*) AS history_count FROM notifications)""")
def q_alert_stats(spark, d):
    r = rules(spark, d)
    n = replay(spark, d)
    after = AL.rule_state_after(r, n, O.NOW)
    return AL.alert_stats(after, n)


FIRE_SQL = O.with_ctes(O.PRICES, O.LATEST, O.METRICS, _sql_rules(), f"""
batch AS (SELECT * FROM metrics),
ready AS (SELECT * FROM rules WHERE r_enabled AND NOT (
  r_id = '{STATE_RULE}' AND NOT ((SELECT MAX(ts) FROM prices) >
      (SELECT MAX(ts) FROM prices) - INTERVAL {STATE_AGO_MINUTES} MINUTE + to_minutes(CAST(r_cooldown_minutes AS BIGINT)))))""",
                       f"m AS (SELECT * FROM batch h JOIN ready r ON {MATCH_ON})", body=f"""
SELECT r_id AS alert_id, r_alert_type AS alert_type, r_priority AS priority,
  arg_min(item_id, {_SEQ}) AS item_id, arg_min(name, {_SEQ}) AS item_name,
  arg_min(profit, {_SEQ}) AS profit, arg_min(roi, {_SEQ}) AS roi,
  COALESCE(r_message, 'Alert triggered for ' || COALESCE(arg_min(name, {_SEQ}), 'None')) AS message,
  (SELECT MAX(ts) FROM prices) AS triggered_at
FROM m WHERE r_cooldown_minutes > 0 GROUP BY r_id, r_alert_type, r_priority, r_message
UNION ALL
SELECT {NOTIFY}, (SELECT MAX(ts) FROM prices) AS triggered_at FROM m WHERE r_cooldown_minutes <= 0""")


@register("alert_fire", FIRE_SQL, doubles=("roi",))
def q_alert_fire(spark, d):
    """The latest snapshot as one batch at the data's newest time; one rule fired 10 minutes earlier."""
    p = prices(spark, d)
    now = p.agg(F.max("ts")).first()[0]
    import datetime as _dt
    r = rules(spark, d).withColumn(
        "last_triggered", F.when(F.col("id") == STATE_RULE,
                                 ts_literal(now - _dt.timedelta(minutes=STATE_AGO_MINUTES)))
        .otherwise(F.col("last_triggered")))
    return AL.alert_fire(M.trade_metrics(A.latest_prices(p)), r, now)


_PART_RULES = """
watched AS (
  SELECT 'watchlist_' || CAST(p_partkey AS VARCHAR) AS id, CAST(p_partkey AS VARCHAR) AS item_id, p_name AS item_name,
    CASE WHEN p_partkey % 4 = 0 THEN 9000.0 ELSE 5000.0 END AS threshold_value, p_partkey FROM part)"""


@register("alert_rules_upserted", f"""
WITH {_sql_rules()}, {_PART_RULES}
SELECT r_id AS id, r_alert_type AS alert_type, r_item_id AS item_id, CAST(NULL AS VARCHAR) AS item_name, r_threshold_value AS threshold_value,
  r_id <> 'loss_watch' AS enabled, r_cooldown_minutes AS cooldown_minutes, r_message AS message FROM rules
UNION ALL
SELECT id, 'item_watchlist', item_id, item_name, threshold_value, p_partkey % 3 <> 0, 30,
  'Watchlist item ' || item_name || ' reached profit threshold' FROM watched WHERE p_partkey % 7 <> 0""", doubles=("threshold_value",))
def q_alert_rules_upserted(spark, d):
    """#92: a watchlist rule for every item, some replaced, some switched off, some removed."""
    parts = read_table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("name"), "p_partkey")
    watched = AL.upsert_rules(rules(spark, d), AL.watchlist_rules(parts))
    watched = AL.upsert_rules(watched, AL.watchlist_rules(parts.where("p_partkey % 4 = 0"), 9000))
    names = lambda c: parts.where(c).select(F.concat(F.lit("watchlist_"), "item_id").alias("id"))
    watched = AL.set_enabled(AL.set_enabled(watched, names("p_partkey % 3 = 0"), False), ["loss_watch"], False)
    return AL.remove_rules(watched, names("p_partkey % 7 = 0")).select(
        "id", "alert_type", "item_id", "item_name", "threshold_value", "enabled", "cooldown_minutes", "message")
