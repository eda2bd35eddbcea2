"""Registered ingest / layout / timestamp / sink queries (#1-9, #11-16)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import anchored as A
from ..operators import metrics as M
from ..operators import sinks as SK
from ..operators import summary as SM
from ..sources import payload as P
from ..sources.testdata import prices
from . import oracle_sql as O
from .registry import register


def payload_from_prices(p):
    """The API payload each price row would have come from (nested offers).

    Sell offers: a flea-market listing (ignored by the reader), the trader's RUB
    offer when a trader exists (with a vendor, a task unlock on first lines),
    and a larger USD offer (ignored).  Buy offers: two flea listings, the
    cheapest being the row's flea price, and a non-flea one.
    """
    vendor = F.struct(F.col("trader_name").alias("name"),
                      F.col("trader_level_required").cast("long").alias("minTraderLevel"),
                      F.when(F.col("l_linenumber") == 1, F.struct(
                          F.col("l_suppkey").cast("string").alias("id"),
                          F.concat(F.lit("Task "), (F.col("l_suppkey") % 5).cast("string")).alias("name")))
                      .alias("taskUnlock"))
    no_vendor = F.lit(None).cast(P.VENDOR)

    def offer(price, source, currency, v):
        return F.struct(price.cast("long").alias("price"), source.alias("source"),
                        F.lit(currency).alias("currency"), v.alias("vendor"))

    sell = F.array_compact(F.array(
        offer(F.col("flea_price") * 3, F.lit("fleaMarket"), "RUB", no_vendor),
        F.when(F.col("trader_name").isNotNull(), offer(F.col("trader_price"), F.col("trader_name"), "RUB", vendor)),
        offer(F.col("trader_price") + 1000, F.lit("other dealer"), "USD", vendor)))
    buy = F.array(offer(F.col("flea_price") + 50, F.lit("fleaMarket"), "RUB", no_vendor),
                  offer(F.col("flea_price"), F.lit("fleaMarket"), "RUB", no_vendor),
                  offer(F.col("flea_price") - 1, F.lit("trader"), "RUB", no_vendor))
    types = F.array_compact(F.array(F.when(F.col("no_flea") == 1, F.lit("noFlea")),
                                    F.when(F.col("marked_only") == 1, F.lit("markedOnly")), F.lit("barter")))
    return p.select(
        F.col("item_id").alias("id"), "name", F.col("short_name").alias("shortName"),
        F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"),
        F.col("base_price").alias("basePrice"), F.col("avg_24h_price").alias("avg24hPrice"),
        F.col("low_24h_price").alias("low24hPrice"), F.col("high_24h_price").alias("high24hPrice"),
        F.col("change_last_48h").alias("changeLast48hPercent"), "weight",
        F.lit(None).cast("string").alias("iconLink"), F.lit("").alias("wikiLink"), types.alias("types"),
        F.col("last_offer_count").cast("long").alias("lastOfferCount"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("updated"),
        F.struct(F.col("category").alias("name")).alias("category"),
        F.array(F.struct(F.col("category").alias("name"))).alias("handbookCategories"),
        sell.alias("sellFor"), buy.alias("buyFor"))


INGEST_COLS = tuple(c for c in P.V4_COLUMNS)
INGEST_SQL = O.with_ctes(O.PRICES, body="""
SELECT item_id, name, ts, flea_price, trader_price, trader_name, trader_price - flea_price AS profit, '' AS icon_link,
  CASE WHEN width = 0 THEN 1 ELSE width END AS width, CASE WHEN height = 0 THEN 1 ELSE height END AS height,
  avg_24h_price, low_24h_price, change_last_48h, weight, category, base_price, high_24h_price, last_offer_count,
  short_name, '' AS wiki_link, trader_level_required,
  CASE WHEN l_linenumber = 1 THEN 'Task ' || CAST(l_suppkey % 5 AS VARCHAR) END AS trader_task_unlock,
  flea_level_required,
  CASE WHEN avg_24h_price > 0 THEN (avg_24h_price - flea_price) / avg_24h_price * 100 ELSE 0.0 END AS price_velocity,
  CASE WHEN last_offer_count > 0 THEN LEAST(last_offer_count / 50.0, 1.0) * 100 ELSE 0.0 END AS liquidity_score,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS api_updated, no_flea, marked_only
FROM prices WHERE trader_name IS NOT NULL AND trader_price > 0 AND flea_price > 0""")


@register("ingest_offers", INGEST_SQL, doubles=("change_last_48h", "weight", "price_velocity", "liquidity_score"))
def q_ingest_offers(spark, d):
    """Round trip: price rows → nested payload → flattened rows (stamped with the payload's update time)."""
    pay = payload_from_prices(prices(spark, d))
    return P.ingest_offers(pay, poll_time=P.normalize_timestamps(F.col("updated"))).select(*INGEST_COLS)


@register("scan_prices", O.with_ctes(O.PRICES, body=
          "SELECT item_id, name, flea_price, trader_price, trader_name, profit, ts FROM prices"))
def q_scan_prices(spark, d):
    return P.scan_prices(prices(spark, d, with_levels=False))


# Timestamp text in the forms the store has seen and in some that are not accepted: (Spark pattern or text,
# DuckDB pattern or text, accepted), chosen by line number and order.
TS_FORMS = (
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "%Y-%m-%dT%H:%M:%S.%f", True), ("yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f", True),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", True), ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", True),
    ("yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M", True), ("yyyyMMdd'T'HHmmss", "%Y%m%dT%H%M%S", True),
    ("yyyy-MM-dd'T'HH:mm:ss'+00:00'", "%Y-%m-%dT%H:%M:%S+00:00", True), ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ", True),
    ("yyyy", "%Y", False), ("yyyy-MM", "%Y-%m", False), ("yyyy-M-d", "%Y-%-m-%-d", False),
    ("yyyy-MM-dd HH:mm:ss 'UTC'", "%Y-%m-%d %H:%M:%S UTC", False), ("'not a time 'ss", "not a time %S", False),
    ("yyyy-'13'-dd", "%Y-13-%d", False), ("''", "", False))
TS_TEXT = "CASE (l_linenumber + l_orderkey) % {} {} END".format(
    len(TS_FORMS), " ".join(f"WHEN {i} THEN {f'strftime(ts, {duck!r})' if duck else repr('')}" for i, (_, duck, _) in enumerate(TS_FORMS)))
TS_OK = "(l_linenumber + l_orderkey) % {} IN ({})".format(len(TS_FORMS), ", ".join(str(i) for i, f in enumerate(TS_FORMS) if f[2]))


@register("normalize_timestamps", O.with_ctes(O.PRICES, f"""
txt AS (SELECT item_id, l_orderkey, l_linenumber, l_suppkey, ts AS t, {TS_TEXT} AS ts_text FROM prices)""", body=f"""
SELECT item_id, l_orderkey, l_linenumber, l_suppkey, ts_text, CASE WHEN {TS_OK} THEN t END AS ts FROM txt"""))
def q_normalize_timestamps(spark, d):
    p = prices(spark, d, with_levels=False)
    m = (F.col("l_linenumber") + F.col("l_orderkey")) % len(TS_FORMS)
    txt = F.lit("")
    for i, (form, duck, _) in enumerate(TS_FORMS):
        if duck:
            txt = F.when(m == i, F.date_format("ts", form)).otherwise(txt)
    t = p.select("item_id", "l_orderkey", "l_linenumber", "l_suppkey", txt.alias("ts_text"))
    return t.withColumn("ts", P.normalize_timestamps("ts_text"))


V_CUTS = ("2024-01-03 00:00:00", "2024-01-05 00:00:00", "2024-01-07 00:00:00")


@register("append_versioned", O.with_ctes(O.PRICES, """
p AS (SELECT *, '' AS icon_link, '' AS wiki_link, CAST(NULL AS VARCHAR) AS trader_task_unlock,
             strftime(ts, '%Y-%m-%dT%H:%M:%S') AS api_updated FROM prices)""", body=f"""
SELECT item_id, name, ts, flea_price, trader_price, trader_name, profit, icon_link, width, height, avg_24h_price,
  low_24h_price, change_last_48h, weight, category,
  CASE WHEN ts < TIMESTAMP '{V_CUTS[0]}' THEN 0 ELSE base_price END AS base_price,
  CASE WHEN ts < TIMESTAMP '{V_CUTS[0]}' THEN 0 ELSE high_24h_price END AS high_24h_price,
  CASE WHEN ts < TIMESTAMP '{V_CUTS[0]}' THEN 0 ELSE last_offer_count END AS last_offer_count,
  CASE WHEN ts < TIMESTAMP '{V_CUTS[0]}' THEN name ELSE short_name END AS short_name,
  CASE WHEN ts < TIMESTAMP '{V_CUTS[0]}' THEN '' ELSE wiki_link END AS wiki_link,
  CASE WHEN ts < TIMESTAMP '{V_CUTS[0]}' THEN 1 ELSE trader_level_required END AS trader_level_required,
  CASE WHEN ts < TIMESTAMP '{V_CUTS[0]}' THEN NULL ELSE trader_task_unlock END AS trader_task_unlock,
  CASE WHEN ts < TIMESTAMP '{V_CUTS[1]}' THEN 15 ELSE flea_level_required END AS flea_level_required,
  CASE WHEN ts < TIMESTAMP '{V_CUTS[0]}' THEN 0.0 ELSE price_velocity END AS price_velocity,
  CASE WHEN ts < TIMESTAMP '{V_CUTS[0]}' THEN 0.0 ELSE liquidity_score END AS liquidity_score,
  CASE WHEN ts < TIMESTAMP '{V_CUTS[0]}' THEN '' ELSE api_updated END AS api_updated,
  CASE WHEN ts < TIMESTAMP '{V_CUTS[2]}' THEN 0 ELSE no_flea END AS no_flea,
  CASE WHEN ts < TIMESTAMP '{V_CUTS[2]}' THEN 0 ELSE marked_only END AS marked_only
FROM p"""), doubles=("change_last_48h", "weight", "price_velocity", "liquidity_score"))
def q_append_versioned(spark, d):
    """History written by four schema generations (split by time), read back as one v4 table."""
    p = prices(spark, d).withColumns({
        "icon_link": F.lit(""), "wiki_link": F.lit(""), "trader_task_unlock": F.lit(None).cast("string"),
        "api_updated": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")})
    c = [F.lit(x).cast("timestamp_ntz") for x in V_CUTS]
    v1 = p.filter(F.col("ts") < c[0]).select(*P.V1_COLUMNS)
    v2 = p.filter((F.col("ts") >= c[0]) & (F.col("ts") < c[1])).select(*P.V2_COLUMNS)
    v3 = p.filter((F.col("ts") >= c[1]) & (F.col("ts") < c[2])).select(*P.V3_COLUMNS)
    v4 = p.filter(F.col("ts") >= c[2]).select(*P.V4_COLUMNS)
    return P.append_versioned(v1, v2, v3, v4)


@register("retention_filter", O.with_ctes(O.PRICES, body=f"""
SELECT item_id, ts, l_orderkey, l_linenumber, l_suppkey, profit FROM prices
WHERE ts IS NULL OR NOT (ts < TIMESTAMP '{O.NOW}' - INTERVAL 7 DAY)"""))
def q_retention_filter(spark, d):
    kept, _ = SK.retention_filter(prices(spark, d, with_levels=False), now=O.NOW, days=7)
    return kept.select("item_id", "ts", "l_orderkey", "l_linenumber", "l_suppkey", "profit")


@register("export_recommendations", O.with_ctes(O.PRICES, O.LATEST, O.METRICS, body="""
SELECT name,
  '₽' || format('{:,}', CAST(trunc(LEAST(GREATEST(CAST(profit AS DOUBLE), -999999999999), 999999999999)) AS BIGINT)) AS profit,
  CASE WHEN roi IS NULL OR isinf(roi) OR isnan(roi) THEN '0.0%' ELSE format('{:.1f}', roi) || '%' END AS roi,
  '₽' || format('{:,}', CAST(trunc(LEAST(GREATEST(CAST(flea_price AS DOUBLE), -999999999999), 999999999999)) AS BIGINT)) AS flea_price,
  '₽' || format('{:,}', CAST(trunc(LEAST(GREATEST(CAST(trader_price AS DOUBLE), -999999999999), 999999999999)) AS BIGINT)) AS trader_price,
  trader_name, category, flea_level_required, last_offer_count, no_flea, marked_only
FROM metrics"""))
def q_export_recommendations(spark, d):
    return SK.export_frame(M.trade_metrics(A.latest_prices(prices(spark, d))))


@register("sink_csv_roundtrip", O.with_ctes(O.PRICES, O.LATEST, O.METRICS, body="""
SELECT item_id, name, category, trader_name, profit, CAST(ts AS VARCHAR) AS ts FROM metrics"""))
def q_sink_csv_roundtrip(spark, d):
    """#11: snapshot written as CSV to the shared folder and read back."""
    snap = M.trade_metrics(A.latest_prices(prices(spark, d)))
    cols = snap.select("item_id", "name", "category", "trader_name", "profit",
                       F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    path = SK.write_csv(cols, SK.export_path(spark, "snapshot_csv"))
    schema = "item_id string, name string, category string, trader_name string, profit bigint, ts string"
    return spark.read.schema(schema).option("header", True).csv(path)


@register("sink_json_roundtrip", O.with_ctes(O.PRICES, O.LATEST, O.METRICS, body="""
SELECT item_id, name, roi, profit, ts FROM metrics"""), doubles=("roi",))
def q_sink_json_roundtrip(spark, d):
    """#12: snapshot written as JSON records to the shared folder and read back."""
    snap = M.trade_metrics(A.latest_prices(prices(spark, d))).select("item_id", "name", "roi", "profit", "ts")
    path = SK.write_json(snap, SK.export_path(spark, "snapshot_json"))
    schema = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("name", T.StringType()),
                           T.StructField("roi", T.DoubleType()), T.StructField("profit", T.LongType()),
                           T.StructField("ts", T.TimestampNTZType())])
    return spark.read.schema(schema).json(path)


_SUMMARY = "category string, total_profit bigint, avg_profit double, max_profit bigint, avg_roi double, avg_price double, items bigint"
_SUMMARY_SQL = O.with_ctes(O.PRICES, O.LATEST, O.METRICS, body="""
SELECT category, CAST(SUM(profit) AS BIGINT) AS total_profit, AVG(profit) AS avg_profit, MAX(profit) AS max_profit, AVG(roi) AS avg_roi,
  AVG(flea_price) AS avg_price, COUNT(*) AS items FROM metrics WHERE category IS NOT NULL GROUP BY category""")


def _category_export(spark, d):
    return SM.category_summary(M.trade_metrics(A.latest_prices(prices(spark, d))))


@register("sink_keyed_json", _SUMMARY_SQL, doubles=("avg_profit", "avg_roi", "avg_price"))
def q_sink_keyed_json(spark, d):
    """#12: the category summary as JSON keyed by category, written and read back."""
    path = SK.write_keyed_json(_category_export(spark, d), "category", SK.export_path(spark, "categories_json"))
    rest = _SUMMARY.split(", ", 1)[1]
    return (spark.read.text(path).select(F.explode(F.from_json("value", f"map<string, struct<{rest.replace(' ', ':').replace(',:', ', ')}>>")).alias("category", "r"))
            .select("category", "r.*"))


@register("sink_csv_lines", _SUMMARY_SQL, doubles=("avg_profit", "avg_roi", "avg_price"))
def q_sink_csv_lines(spark, d):
    """#12: the category summary as CSV lines, read back from the text."""
    return SK.lines_csv(_category_export(spark, d)).select(F.from_csv("line", _SUMMARY).alias("r")).select("r.*")
