"""Streams that lose nothing, replay from earlier state, time zones, skewed keys, pruned scans, exact quantiles."""

import datetime as dt
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from marketflow.operators import alerts as AL
from marketflow.operators import scoring as SC
from marketflow.operators import sequence as SQ
from marketflow.operators.quantile import exact_quantile
from marketflow.sources import payload as P
from marketflow.sources import store as ST
from marketflow.streaming import jobs as J

NOW = dt.datetime(2024, 3, 1, 12, 0, 0)


def _payload(spark, path, k):
    vendor = {"name": "t", "minTraderLevel": 1, "taskUnlock": None}
    rows = [{"id": f"i{k}-{j}", "name": "n", "sellFor": [{"price": 90, "source": "t", "currency": "RUB", "vendor": vendor}],
             "buyFor": [{"price": 50, "source": "fleaMarket", "currency": "RUB", "vendor": None}]} for j in range(10)]
    spark.createDataFrame(rows, P.ITEM).coalesce(1).write.json(f"{path}/{k}")


def test_ingest_keeps_every_file_and_replays_cleanly(spark, tmp_path):
    src, store, ckpt = (f"{tmp_path}/{n}" for n in ("in", "store", "ckpt"))
    for k in range(3):
        _payload(spark, src, k)
    seen = []
    run = lambda: J.stream_ingest(spark, f"{src}/*", store, ckpt, guard=False, on_batch=lambda df, i: seen.append(i))
    run().awaitTermination()
    assert ST.read_prices(spark, store).count() == 30 and seen == [0, 1, 2]
    last = max((f for f in os.listdir(f"{ckpt}/commits") if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):
        if os.path.exists(f"{ckpt}/commits/{f}"):
            os.remove(f"{ckpt}/commits/{f}")          # the batch ran, its commit was lost
    run().awaitTermination()
    assert seen == [0, 1, 2, 2] and ST.read_prices(spark, store).count() == 30
    assert J.stream_ingest(spark, f"{src}/*", store, ckpt) is None      # fresh store: the start is deferred


def test_retention_drops_days_and_rewrites_the_cut(spark, tmp_path):
    rows = [(i, NOW - dt.timedelta(hours=6 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, ts timestamp_ntz")
    path = f"{tmp_path}/s"
    ST.write_prices(df.filter("i % 2 = 0"), path, "a")
    ST.write_prices(df.filter("i % 2 = 1"), path, "b")
    assert ST.expire(spark, path, NOW, 7) == sum(NOW - t > dt.timedelta(days=7) for _, t in rows)
    assert sorted(r.i for r in ST.read_prices(spark, path).collect()) == list(range(29))
    assert ST.expire(spark, path, NOW, 0) == 0 and ST.newest(spark, path) == NOW
    assert sorted(r.i for r in ST.recent(spark, path, F.expr("INTERVAL 12 HOURS")).collect()) == [0, 1, 2]


def _history(spark, minutes):
    return spark.createDataFrame([("i", "n", 2000.0, 1.0, 1, NOW + dt.timedelta(minutes=t)) for t in minutes],
                                 "item_id string, name string, profit double, roi double, l_orderkey long, ts timestamp_ntz")


def test_replay_starts_from_the_last_firing(spark):
    for ago, want in ((3 * 24 * 60, [0, 35]), (10, [35])):
        r = AL.rules_frame(spark, [AL.rule("p", AL.PROFIT_THRESHOLD, threshold_value=1000, last_triggered=NOW - dt.timedelta(minutes=ago))])
        got = sorted(x.triggered_at for x in AL.alert_cooldown_replay(_history(spark, [0, 10, 35]), r).collect())
        assert got == [NOW + dt.timedelta(minutes=t) for t in want]


def test_rules_by_shape(spark):
    items = spark.createDataFrame([(" a ", "A", 6000.0, 5.0, "c1", True), ("b", "B", 900.0, 80.0, "c2", False), ("c", "C", -5.0, None, None, None)],
                                  "item_id string, name string, profit double, roi double, category string, is_anomaly boolean")
    rules = AL.rules_frame(spark, AL.default_rules() + [
        AL.watchlist_rule("a", "A"), AL.watchlist_rule("b", "B"), AL.rule("own", AL.PROFIT_THRESHOLD, item_id="b", threshold_value=500),
        AL.rule("loss", AL.PROFIT_THRESHOLD, item_id="", threshold_value=0, threshold_type="below"),
        AL.rule("cat", AL.CATEGORY_ALERT, category="c2", threshold_value=100), AL.rule("off", AL.HIGH_ROI, enabled=False),
        AL.rule("other", "price_drop", threshold_value=0)])
    got = {(r.r_id, r.name) for r in AL.alert_matches(items, rules).collect()}
    assert got == {("high_roi_auto", "B"), ("arbitrage_auto", "A"), ("watchlist_a", "A"), ("own", "B"), ("loss", "C"), ("cat", "B")}


def test_rule_upserts(spark):
    rules = AL.rules_frame(spark, AL.default_rules())
    new = AL.rules_frame(spark, [AL.rule("high_roi_auto", AL.HIGH_ROI, threshold_value=9), AL.watchlist_rule("x", "X")])
    out = AL.set_enabled(AL.remove_rules(AL.upsert_rules(rules, new), ["arbitrage_auto"]), ["watchlist_x"], False)
    assert {r.id: (r.threshold_value, r.enabled) for r in out.collect()} == {
        "high_profit_auto": (10000.0, True), "high_roi_auto": (9.0, True), "watchlist_x": (5000.0, False)}


def test_alert_stream_keeps_rule_state_and_survives_a_bad_callback(spark, tmp_path):
    t = str(tmp_path)
    schema = "item_id string, name string, profit double, roi double, l_orderkey long"
    for k in range(3):
        spark.createDataFrame([("i", "n", 2000.0, 1.0, k)], schema).coalesce(1).write.parquet(f"{t}/in/{k}")
    rules = AL.rules_frame(spark, [AL.rule("p", AL.PROFIT_THRESHOLD, threshold_value=1000)])
    ST.Versions(spark, f"{t}/rules").write(rules, "start", 0)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{t}/in/*")

    def fails(row):
        raise ValueError("bad hook")
    J.alert_stream(src, f"{t}/rules", f"{t}/history", f"{t}/ckpt", callback=fails, clock=lambda k: NOW + dt.timedelta(minutes=20 * k)).awaitTermination()
    state = J.read_rules(spark, f"{t}/rules").first()
    fired = sorted(r.triggered_at for r in spark.read.parquet(f"{t}/history/*").collect())
    assert fired == [NOW, NOW + dt.timedelta(minutes=40)] and state.trigger_count == 2 and state.last_triggered == fired[-1]
    assert len(ST.folders(spark, f"{t}/rules")) == 2


def test_state_of_a_second_stream_goes_on(spark, tmp_path):
    t = str(tmp_path)
    v = ST.Versions(spark, f"{t}/s")
    for run, batch, n in (("a", 0, 1), ("a", 1, 2), ("b", 0, 3)):
        assert not v.has(run, batch)
        v.write(spark.range(n), run, batch)
    assert v.has("b", 0) and v.current().count() == 3


def test_empty_history_gives_the_defaults(spark):
    items = spark.createDataFrame([("a", 100)], "item_id string, profit long")
    none = spark.createDataFrame([], "item_id string, avg_profit double, min_profit long, max_profit long, data_points long")
    r = SC.trend_features(items, none).first()
    assert (r.historical_volatility, r.trend_direction, r.profit_trend, r.consistency_score) == (0.0, "Unknown", 0.0, 50.0)


def test_timestamp_forms(spark):
    ok = {"2024-01-05": dt.datetime(2024, 1, 5), "20240101T000000": dt.datetime(2024, 1, 1), "2024-01-05 10:20": dt.datetime(2024, 1, 5, 10, 20),
          "2024-01-05T10:20:30.5+02:00": dt.datetime(2024, 1, 5, 8, 20, 30, 500000), "2024-01-05T10Z": dt.datetime(2024, 1, 5, 10)}
    bad = ["2024", "2024-01", "2024-1-5", "2024-01-01 00:00:00 UTC", "2024-13-01", " 2024-01-05", "", None, "x"]
    df = spark.createDataFrame([(s,) for s in [*ok, *bad]], "s string").withColumn("t", P.normalize_timestamps("s"))
    assert {r.s: r.t for r in df.collect()} == ok | dict.fromkeys(bad)


def test_one_key_with_nearly_all_rows_at_one_time_is_split(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(7).cast("string").alias("k"),
                                      F.lit(NOW.isoformat(sep=" ")).cast("timestamp_ntz").alias("ts"), "id")
    got = SQ.sequence_index(rows.repartition(8), "k", "ts", ["id"], with_count="n")
    bad = got.groupBy("k").agg(F.min("_x").alias("a"), F.max("_x").alias("b"), F.count_distinct("_x").alias("c"), F.max("n").alias("n"))
    assert bad.filter("a <> 0 OR b <> n - 1 OR c <> n").count() == 0
    part = SQ.numbered(rows, [F.col("k"), F.col("ts"), F.col("id")])
    assert part.select(F.max("_g")).first()[0] == 19_999
    sizes = rows.repartitionByRange(4, "k", "ts", "id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 10_000


@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 0.95, 1.0])
def test_exact_quantile(spark, q):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=6000), np.full(3000, 0.25), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert exact_quantile(df, "x", q) == pytest.approx(np.quantile(x, q), rel=1e-12)
    assert exact_quantile(df.limit(0), "x", q) is None


def test_window_bound_reaches_the_scan(spark, sf):
    df = E.queries()["latest_prices"](spark, sf)
    text = df._jdf.queryExecution().toString()
    scans = [x for x in text.split("== Physical Plan ==")[1].split("\n") if "FileScan" in x and "l_extendedprice" in x]
    assert scans and all("GreaterThanOrEqual(l_shipdate" in x for x in scans)


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_results_do_not_follow_the_driver_zone(zone):
    code = ("import datetime as dt\n"
            "from marketflow.session import get_session\n"
            "from marketflow.functions.columns import ts_literal\n"
            "s = get_session('local[1]', 1)\n"
            "now = dt.datetime(2024, 3, 1)\n"
            "print('GOT', s.range(1).select(ts_literal(now).cast('string'), ts_literal('2024-03-01 00:00:00').cast('string'),\n"
            "      ts_literal(now.replace(tzinfo=dt.timezone(dt.timedelta(hours=2)))).cast('string')).first()[0:3])")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"TZ": zone}, capture_output=True, text=True, timeout=300)
    assert "GOT ('2024-03-01 00:00:00', '2024-03-01 00:00:00', '2024-02-29 22:00:00')" in out.stdout, out.stderr[-2000:]
