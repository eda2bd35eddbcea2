"""Anchored windows, retention and learned statistics."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from marketflow.operators import anchored as A
from marketflow.operators import learned as L
from marketflow.operators import sinks as SK

NOW = dt.datetime(2024, 3, 1, 12, 0, 0)


def test_trend_window_is_strict_and_anchored(spark):
    df = spark.createDataFrame([("x", NOW - dt.timedelta(hours=10), 500), ("x", NOW - dt.timedelta(hours=2), 1500),
                                ("y", NOW, 10)], "item_id string, ts timestamp_ntz, profit long")
    r = {row.item_id: row for row in A.market_trends(df, hours=6).collect()}
    assert r["x"].avg_profit == 1500 and r["x"].data_points == 1


def test_retention(spark):
    df = spark.createDataFrame([("a", NOW - dt.timedelta(days=10)), ("b", NOW - dt.timedelta(days=1))],
                               "item_id string, ts timestamp_ntz")
    kept, deleted = SK.retention_filter(df, now=NOW, days=7)
    assert [r.item_id for r in kept.collect()] == ["b"] and deleted.first().deleted == 1
    kept0, deleted0 = SK.retention_filter(df, now=NOW, days=0)
    assert kept0.count() == 2 and deleted0.first().deleted == 0


def _updates(spark, profits, item="i1", category="Ammo", trader="T1"):
    rows = [(item, f"name{i}", category, trader, float(p), 100, 10, 20.0, NOW + dt.timedelta(minutes=5 * i), i, 1, 1)
            for i, p in enumerate(profits)]
    return spark.createDataFrame(rows, "item_id string, name string, category string, trader_name string, "
                                       "profit double, flea_price long, last_offer_count int, liquidity_score double, "
                                       "ts timestamp_ntz, l_orderkey long, l_linenumber int, l_suppkey long")


def test_item_statistics_exact(spark):
    st = L.item_statistics(_updates(spark, [1000, 2000, 3000, 4000, 5000])).first()
    assert st["count"] == 5 and st.profit_mean == 3000 and st.profit_min == 1000 and st.profit_max == 5000
    assert abs(st.profit_std - np.std([1000, 2000, 3000, 4000, 5000], ddof=1)) < 1e-9
    assert st.item_name == "name4"


def test_merge_equals_batch_in_any_order(spark):
    a = _updates(spark, [1000, 2500, 3000])
    b = _updates(spark, [4000, 8000]).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")) \
        .withColumn("category", F.lit("Gear"))
    full = L.item_statistics(a.unionByName(b)).first()
    for x, y in ((a, b), (b, a)):
        m = L.merge_item_statistics(L.item_statistics(x, keep_key=True), L.item_statistics(y, keep_key=True)).first()
        assert m["count"] == full["count"] and abs(m.profit_mean - full.profit_mean) < 1e-9
        assert abs(m.profit_std - full.profit_std) < 1e-9 and m.category == "Gear" == full.category


def test_consistency_constant_beats_varying(spark):
    c = L.item_statistics(_updates(spark, [5000] * 10)).first().consistency_score
    v = L.item_statistics(_updates(spark, [100, 9000, 50, 7000, 3000, 10, 8000, 200, 6000, 1])).first().consistency_score
    assert c > v


def test_category_weight_and_trader_reliability(spark):
    cat = _updates(spark, [100] * 8 + [-100] * 2)
    w = L.category_performance(cat).first().weight
    assert w > 1.0 and abs(w - 1.3) < 1e-12
    tr = L.trader_reliability(_updates(spark, [5000] * 15)).first().reliability
    assert tr > 0.5


def test_calibration_closed_form_equals_loop(spark):
    rows = [(NOW + dt.timedelta(minutes=5 * i), float(i), 1.0 + i, 2.0 * i, 3.0) for i in range(7)]
    cyc = spark.createDataFrame(rows, "cycle timestamp_ntz, profit_mean double, profit_std double, "
                                      "roi_mean double, roi_std double")
    got = L.calibration_ema(cyc).first()
    state = [0.0, 1.0, 0.0, 1.0]
    for _, pm, ps, rm, rs in rows:
        state = [0.1 * x + 0.9 * s for x, s in zip((pm, ps, rm, rs), state)]
    assert np.allclose([got.profit_mean, got.profit_std, got.roi_mean, got.roi_std], state, atol=1e-12)
