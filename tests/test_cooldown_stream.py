"""The stateful cooldown against the batch replay, over restarts, earlier firings, quiet rules and failing callbacks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketflow.operators import alerts as AL
from marketflow.streaming import cooldown as C

T0 = dt.datetime(2024, 1, 1)
POLL = "item_id string, name string, category string, profit double, roi double, ts timestamp_ntz, no long"


def polls(hours, seed=0):
    return [(f"i{k}", None if k == 2 else f"n{k}", "c", float((h * 7 + k * 13 + seed) % 40), 1.0, T0 + dt.timedelta(hours=h), 3 - k) for h in hours for k in range(4)]


RULES = [AL.rule("a", AL.PROFIT_THRESHOLD, threshold_value=20.0, cooldown_minutes=150),
         AL.rule("b", AL.PROFIT_THRESHOLD, threshold_value=30.0, cooldown_minutes=400, last_triggered=T0 + dt.timedelta(hours=9)),
         AL.rule("w", AL.ITEM_WATCHLIST, item_id="i2", threshold_value=0.0, cooldown_minutes=45),
         AL.rule("every", AL.PROFIT_THRESHOLD, threshold_value=38.0, cooldown_minutes=0)]


def played(spark, tmp_path, batches, callback=None):
    rules = AL.rules_frame(spark, RULES)
    for rows in batches:
        spark.createDataFrame(rows, POLL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        src = spark.readStream.schema(POLL).parquet(f"{tmp_path}/in")
        C.cooldown_stream(src, rules, f"{tmp_path}/h", f"{tmp_path}/c", seq=("no",), callback=callback).awaitTermination()
    return sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/h/*").select(sorted(AL_COLS)).collect()), key=str)


AL_COLS = ("alert_id", "alert_type", "priority", "item_id", "item_name", "profit", "roi", "message", "triggered_at")


@pytest.mark.parametrize("cuts", [(40,), (7, 8, 25, 40)])
def test_equals_the_batch_replay_over_restarts(spark, tmp_path, cuts):
    got = played(spark, tmp_path, [polls(range(a, b)) for a, b in zip((0, *cuts), cuts)])
    whole = AL.alert_cooldown_replay(spark.createDataFrame(polls(range(40)), POLL), AL.rules_frame(spark, RULES), seq=("no",))
    assert got == sorted((tuple(r) for r in whole.select(sorted(AL_COLS)).collect()), key=str)
    assert {r[0] for r in got} == {"a", "b", "w", "every"}


def test_quiet_rules_hold_no_state_and_fire_again(spark, tmp_path):
    late = [range(0, 3), range(500, 502), range(1000, 1002)]     # the watermark passes every cooldown in between
    got = played(spark, tmp_path, [polls(h) for h in late])
    whole = AL.alert_cooldown_replay(spark.createDataFrame([r for h in late for r in polls(h)], POLL), AL.rules_frame(spark, RULES), seq=("no",))
    assert got == sorted((tuple(r) for r in whole.select(sorted(AL_COLS)).collect()), key=str)


def test_callbacks_may_fail_and_odd_rows_match_nothing(spark, tmp_path):
    def callback(row):
        raise ValueError(row.alert_id)
    odd = [(None, None, None, None, None, T0, 1), ("i", "n", "c", float("nan"), None, T0, 2), ("i2", "n", "c", 50.0, 1.0, None, 3), ("i2", "n", "c", 50.0, 1.0, T0, 4)]
    got = played(spark, tmp_path, [odd], callback)
    assert {(r[0], r[2]) for r in got} == {("a", "i2"), ("w", "i2"), ("every", "i2")}     # b fired at nine o'clock
    assert spark.read.parquet(f"{tmp_path}/h/*").where(F.col("triggered_at") != T0).count() == 0
