"""ML properties, ranks, forecast, alerts with cooldown, payload flattening."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marketflow.operators import alerts as AL
from marketflow.operators import ranking as R
from marketflow.operators.ml import cluster as CL
from marketflow.operators.ml import forecast as FC
from marketflow.operators.ml import iforest as IF
from marketflow.sources import payload as P

NOW = dt.datetime(2024, 3, 1, 12, 0, 0)


def test_average_rank_matches_pandas(spark):
    vals = [5.0, 3.0, 5.0, None, 1.0, 3.0, 3.0, 9.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, v double")
    out = R.average_rank(df, "v", "r", pct_out="p").orderBy("id").toPandas()
    s = pd.Series(vals)
    assert np.allclose(out["r"].fillna(-1), s.rank(ascending=False).fillna(-1))
    assert np.allclose(out["p"].fillna(-1), (s.rank(pct=True) * 100).fillna(-1))


def test_forecast_matches_ridge_closed_form(spark):
    rng = np.random.default_rng(0)
    y = (np.arange(20) * 37 + rng.integers(-50, 50, 20)).astype(int)
    df = spark.createDataFrame([("a", NOW + dt.timedelta(minutes=5 * i), int(v)) for i, v in enumerate(y)],
                               "item_id string, ts timestamp_ntz, profit long")
    s = FC.forecast_summary(df).first()
    x = np.arange(20.0)
    xc, yc = x - x.mean(), y - y.mean()
    slope = (xc @ yc) / (xc @ xc + 1.0)
    assert abs(s.slope - slope) < 1e-9 and abs(s.intercept - (y.mean() - slope * x.mean())) < 1e-9
    assert s.trend in ("increasing", "decreasing", "stable") and 0 <= s.confidence <= 100
    short = FC.forecast_summary(df.filter(F.col("profit") < y[5])).first()
    assert short.trend == "unknown" and short.confidence == 0.0
    preds = FC.profit_forecast(df, 12).orderBy("step").toPandas()
    assert len(preds) == 12 and abs(preds.predicted_profit.iloc[0] - (s.intercept + s.slope * 20)) < 1e-9


def test_isolation_forest_flags_planted_outliers(spark):
    rng = np.random.default_rng(1)
    n, k = 3000, 15
    x = rng.normal(0, 1, (n, 3))
    x[:k] = rng.normal(0, 1, (k, 3)) + 12.0
    pdf = pd.DataFrame({"item_id": [f"i{i}" for i in range(n)], "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})
    df = spark.createDataFrame(pdf)
    out = IF.isolation_forest(df, features=["a", "b", "c"], trees=50).toPandas()
    share = out.is_anomaly.mean()
    assert 0.04 <= share <= 0.06
    top = set(out.sort_values("anomaly_score", ascending=False).item_id.head(k))
    assert top == {f"i{i}" for i in range(k)}
    again = IF.isolation_forest(df, features=["a", "b", "c"], trees=50).toPandas()
    assert np.allclose(out.sort_values("item_id").anomaly_score, again.sort_values("item_id").anomaly_score)


def test_isolation_forest_small_frame(spark):
    df = spark.createDataFrame([(f"i{i}", float(i)) for i in range(10)], "item_id string, profit double")
    out = IF.isolation_forest(df, features=["profit"]).collect()
    assert all(r.is_anomaly == 0 and r.anomaly_score == 0.0 for r in out)


def test_clusters_labels_and_confidence(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c, centre in enumerate([0.0, 10.0, 20.0]):
        for i in range(20):
            v = centre + rng.normal(0, 0.5)
            rows.append((f"{c}-{i}", v * 100, v, v * 10))
    df = spark.createDataFrame(rows, "item_id string, profit double, capital_efficiency double, profit_per_slot double")
    out = CL.cluster_items(df, n_init=1).toPandas()
    assert out.cluster.nunique() >= 2
    assert ((out.cluster_confidence > 0) & (out.cluster_confidence <= 1)).all()
    top = out.groupby("cluster").profit.mean().idxmax()
    assert (out[out.cluster == top].cluster_label == "🥇 Elite Opportunities").all()


def _rules(spark, cooldown=30, enabled=True):
    return AL.rules_frame(spark, [AL.rule("p", AL.PROFIT_THRESHOLD, threshold_value=1000, enabled=enabled,
                                          cooldown_minutes=cooldown, message=None)])


def _batch(spark, profits):
    return spark.createDataFrame([(f"i{k}", f"item {k}", float(p), 1.0, k) for k, p in enumerate(profits)],
                                 "item_id string, name string, profit double, roi double, l_orderkey long")


def test_alert_fires_once_for_first_match(spark):
    fired = AL.alert_fire(_batch(spark, [500, 2000, 3000]), _rules(spark), NOW).collect()
    assert len(fired) == 1 and fired[0].item_id == "i1" and fired[0].message == "Alert triggered for item 1"


def test_alert_cooldown_and_disabled(spark):
    rules = _rules(spark)
    b = _batch(spark, [2000])
    fired = AL.alert_fire(b, rules, NOW)
    after = AL.rule_state_after(rules, fired, NOW)
    assert after.first().trigger_count == 1
    assert AL.alert_fire(b, after, NOW + dt.timedelta(minutes=29)).count() == 0
    assert AL.alert_fire(b, after, NOW + dt.timedelta(minutes=31)).count() == 1
    assert AL.alert_fire(_batch(spark, [2000, 3000]), _rules(spark, cooldown=0), NOW).count() == 2
    assert AL.alert_fire(b, _rules(spark, enabled=False), NOW).count() == 0
    assert AL.alert_fire(_batch(spark, [float("nan")]), _rules(spark), NOW).count() == 0


def test_cooldown_replay_greedy(spark):
    times = [0, 10, 20, 35, 40, 70]
    hist = spark.createDataFrame([("i", "n", 2000.0, 1.0, 1, NOW + dt.timedelta(minutes=t)) for t in times],
                                 "item_id string, name string, profit double, roi double, l_orderkey long, "
                                 "ts timestamp_ntz")
    got = sorted(r.triggered_at for r in AL.alert_cooldown_replay(hist, _rules(spark)).collect())
    assert got == [NOW + dt.timedelta(minutes=t) for t in (0, 35, 70)]


def _offer(price, source, currency="RUB", level=None, task=None):
    vendor = None if level is None else {"name": source, "minTraderLevel": level,
                                         "taskUnlock": None if task is None else {"id": "t", "name": task}}
    return {"price": price, "source": source, "currency": currency, "vendor": vendor}


def test_payload_flattening(spark):
    items = [
        {"id": "a", "name": "Alpha", "width": 0, "types": ["noFlea"],
         "sellFor": [_offer(100, "t1", level=2, task="Quest"), _offer(300, "t2"), _offer(300, "t3", level=4),
                     _offer(900, "x", currency="USD", level=1)],
         "buyFor": [_offer(80, "fleaMarket"), _offer(60, "fleaMarket"), _offer(10, "trader")]},
        {"id": "", "name": "NoId", "sellFor": [_offer(100, "t1")], "buyFor": [_offer(50, "fleaMarket")]},
        {"id": "c", "name": "NoSell", "sellFor": None, "buyFor": [_offer(50, "fleaMarket")]},
        {"id": "d", "name": "", "sellFor": [_offer(100, "t1")], "buyFor": []},
    ]
    df = spark.createDataFrame(items, P.ITEM)
    out = P.ingest_offers(df, poll_time=F.lit(NOW).cast("timestamp_ntz")).collect()
    assert [r.item_id for r in out] == ["a"]
    a = out[0]
    # 300 from t2 is the first best (strict >); t2 has no vendor, so the level/task of t1 carry over
    assert (a.trader_price, a.trader_name, a.trader_level_required, a.trader_task_unlock) == (300, "t2", 2, "Quest")
    assert a.flea_price == 60 and a.profit == 240 and a.width == 1 and a.no_flea == 1 and a.short_name == "Alpha"
