"""First matches of global rules against all pairs, with very many rules, over blocks of polls and odd values."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from marketflow.operators import alerts as AL
from marketflow.operators import first_match as FM

T0 = dt.datetime(2024, 1, 1)
ITEM = "item_id string, name string, category string, profit double, roi double, is_anomaly int, ts timestamp_ntz, no long"


def history(rng, polls, per):
    return [(f"i{rng.randrange(99)}", "n", "c", rng.choice([float(rng.randint(-9000, 9000)), 5.0, None, float("nan")]), float(rng.randint(-50, 200)),
             int(rng.random() < 0.1), T0 + dt.timedelta(minutes=5 * p), p * per + k) for p in range(polls) for k in range(per)]


def global_rules(rng, n, cooldown=lambda rng: rng.choice([10, 30, 61, 400])):
    out = []
    for k in range(n):
        kind = rng.choice([AL.PROFIT_THRESHOLD, AL.PROFIT_THRESHOLD, AL.HIGH_ROI, AL.ARBITRAGE])
        out.append(AL.rule(f"r{k}", kind, threshold_value=float(rng.randint(-9500, 9500)) if kind != AL.HIGH_ROI else float(rng.randint(0, 250)),
                           threshold_type=rng.choice(["above", "below", "sideways"]), cooldown_minutes=cooldown(rng), enabled=rng.random() < 0.95,
                           last_triggered=rng.choice([None, T0 + dt.timedelta(minutes=rng.randrange(-60, 90))])))
    return out


def pairs_firing(rows, rules, now):
    """All pairs, the slow way."""
    out = set()
    for r in rules:
        rid, kind, thr, side, enabled, last, cool = r[0], r[1], r[5], r[6], r[8], r[10], r[12]
        if not enabled or last is not None and not now > last + dt.timedelta(minutes=cool):
            continue
        for i, _, _, p, roi, anomaly, _, no in sorted(rows, key=lambda x: x[7]):
            p = 0.0 if p is None or p != p else p
            hit = {AL.PROFIT_THRESHOLD: p >= thr if side == "above" else p <= thr if side == "below" else False,
                   AL.HIGH_ROI: roi >= thr, AL.ARBITRAGE: anomaly and p > 5000}[kind]
            if hit:
                out.add((rid, no))
                break
    return out


def test_fire_equals_all_pairs(spark):
    rng = random.Random(1)
    rows, rules = history(rng, 1, 300), global_rules(rng, 200)
    now = T0 + dt.timedelta(minutes=45)
    items = spark.createDataFrame([(*r[:1], str(r[7]), *r[2:]) for r in rows], ITEM)     # the name tells the row
    got = AL.alert_fire(items, AL.rules_frame(spark, rules), now, seq=("no",)).collect()
    assert {(r.alert_id, int(r.item_name)) for r in got} == pairs_firing(rows, rules, now) and len(got) > 60


@pytest.mark.parametrize("block", [4, 1000])
def test_replay_equals_poll_by_poll(spark, monkeypatch, block):
    rng = random.Random(2)
    rows, rules = history(rng, 40, 12), global_rules(rng, 60)
    want, state = set(), {r[0]: r for r in rules}
    for p in range(40):
        now = T0 + dt.timedelta(minutes=5 * p)
        fired = pairs_firing(rows[12 * p:12 * p + 12], state.values(), now)
        want |= {(r, no, now) for r, no in fired}
        for r, _ in fired:
            state[r] = (*state[r][:10], now, *state[r][11:])
    monkeypatch.setattr(FM.replayed_matches, "__defaults__", (block,))
    items = spark.createDataFrame([(*r[:1], str(r[7]), *r[2:]) for r in rows], ITEM)
    got = AL.alert_cooldown_replay(items, AL.rules_frame(spark, rules), seq=("no",)).collect()
    assert {(r.alert_id, int(r.item_name), r.triggered_at) for r in got} == want and len(got) == len(want) > 100


def test_a_hundred_thousand_global_rules(spark):
    rng = random.Random(3)
    rules = AL.rules_frame(spark, [AL.rule("x", AL.PROFIT_THRESHOLD)]).drop("id", "threshold_value", "threshold_type").crossJoin(
        spark.range(100_000).select(F.concat(F.lit("r"), "id").alias("id"), ((F.col("id") * 7919) % 20_000 - 10_000).cast("double").alias("threshold_value"),
                                    F.when(F.col("id") % 2 == 0, "above").otherwise("below").alias("threshold_type"))).select(*AL.rules_frame(spark, []).columns)
    rows = [r for r in history(rng, 30, 400)]
    items = spark.createDataFrame(rows, ITEM).cache()
    items.count()
    began = time.time()
    fired = AL.alert_fire(items.where(F.col("ts") == T0), rules, T0, seq=("no",))
    assert "NestedLoop" not in fired._jdf.queryExecution().executedPlan().toString().split("r_cooldown_minutes")[0]
    prof = [0.0 if r[3] is None or r[3] != r[3] else r[3] for r in rows[:400]]
    want = sum(max(prof) >= (k * 7919) % 20_000 - 10_000 if k % 2 == 0 else min(prof) <= (k * 7919) % 20_000 - 10_000 for k in range(100_000))
    assert fired.count() == want
    replay = AL.alert_cooldown_replay(items, rules, seq=("no",))
    assert replay.where(F.col("triggered_at") == T0).count() == want
    assert time.time() - began < 120


def test_odd_input(spark):
    rules = AL.rules_frame(spark, [AL.rule("a", AL.PROFIT_THRESHOLD, threshold_value=float("nan")), AL.rule("b", AL.PROFIT_THRESHOLD, threshold_value=float("-inf")),
                                   AL.rule("c", AL.ARBITRAGE)])
    bare = spark.createDataFrame([("i", "n", None, T0), ("j", "n", 7.0, None)], "item_id string, name string, profit double, ts timestamp_ntz")
    assert {(r.alert_id, r.item_id) for r in AL.alert_fire(bare, rules, T0).collect()} == {("b", "i")}
    assert {(r.alert_id, r.item_id, r.triggered_at) for r in AL.alert_cooldown_replay(bare, rules).collect()} == {("b", "i", T0)}
    for empty in (bare.where("false"),):
        assert AL.alert_fire(empty, rules, T0).count() == AL.alert_cooldown_replay(empty, rules).count() == 0
    assert AL.alert_fire(bare, rules.where("false"), T0).count() == AL.alert_cooldown_replay(bare, rules.where("false")).count() == 0
