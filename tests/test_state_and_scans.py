"""Bucketed states, mergeable calibration, prefix scans, grouped exact quantiles, deduplicated windows."""

import datetime as dt
import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketflow.operators import learned as L
from marketflow.operators import summary as SU
from marketflow.operators.quantile import exact_quantile, grouped_quantiles
from marketflow.operators.scan import AFFINE, LARGEST, SUM, prefix_scan
from marketflow.sources import store as ST
from marketflow.sources.buckets import Buckets
from marketflow.streaming import jobs as J

COUNTS = "category string, total_items long, profitable_items long, profit_sum double"


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-"))


def test_a_batch_writes_the_buckets_of_its_keys_only(spark, tmp_path):
    state = Buckets(spark, str(tmp_path / "s"), "category", n=32)
    whole = spark.createDataFrame([(f"c{i}", 1, 1, float(i)) for i in range(3000)], COUNTS)
    state.update(whole, L.merge_totals, "r", 0)
    few = spark.createDataFrame([("c1", 2, 0, 5.0), ("c2", 1, 1, 1.0), ("new", 1, 0, -1.0)], COUNTS)
    state.update(few, L.merge_totals, "r", 1)
    first, second = (size_of(tmp_path / "s" / v) for v in ("v00000000_r_0", "v00000001_r_1"))
    assert second < first / 8                                  # three of 32 buckets
    got = {r.category: tuple(r)[1:] for r in state.current().collect()}
    assert len(got) == 3001 and got["c1"] == (3, 1, 6.0) and got["c2"] == (2, 2, 3.0) and got["new"] == (1, 0, -1.0)
    state.update(few, L.merge_totals, "r", 1)                  # played again
    assert {r.category: tuple(r)[1:] for r in state.current().collect()} == got
    reader = state.current()
    state.update(few, L.merge_totals, "r", 2)
    assert reader.where("category = 'c1'").first().total_items == 3       # a reader that had begun keeps its version
    assert state.current().where("category = 'c1'").first().total_items == 5
    for k in range(3, 8):
        state.update(few, L.merge_totals, "r", k)
    held = [len([f for f in ST.folders(spark, f"{tmp_path}/s/{v}") if f.startswith("bucket=")]) for v in ST.folders(spark, f"{tmp_path}/s")]
    again = Buckets(spark, str(tmp_path / "s"), "category", n=7)      # another number of buckets is not taken up
    again.update(few, L.merge_totals, "other", 0)
    assert again.n == 32 and again.current().count() == 3001 and again.current().where("category = 'c2'").first().total_items == 9
    assert sum(held) <= 2 * 32 and state.current().count() == 3001


def test_a_write_that_fails_half_way_changes_nothing(spark, tmp_path, monkeypatch):
    parts = [J.CATEGORIES, J.TRADERS]
    rows = [("a", "x", "T1", 5.0), ("b", "y", "T2", -3.0)] * 6
    spark.createDataFrame(rows, "item_id string, category string, trader_name string, profit double").coalesce(1).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("item_id string, category string, trader_name string, profit double").parquet(f"{tmp_path}/in")
    real, calls = Buckets._write, []

    def failing(self, *a):
        calls.append(self.root)
        if len(calls) == 2:                                    # between the first state and the second
            raise RuntimeError("lost")
        return real(self, *a)
    monkeypatch.setattr(Buckets, "_write", failing)
    run = lambda: J.learned_state_stream(src, f"{tmp_path}/s", f"{tmp_path}/c", parts=parts).awaitTermination()
    with pytest.raises(Exception):
        run()
    assert J.read_state(spark, f"{tmp_path}/s", J.CATEGORIES).count() == 2 and not Buckets(spark, f"{tmp_path}/s/traders", "trader", 16).paths()
    run()
    assert sorted(tuple(r) for r in J.read_state(spark, f"{tmp_path}/s", J.CATEGORIES).collect()) == [("x", 6, 6, 5.0, 1.5), ("y", 6, 0, -3.0, 0.5)]
    assert {r.trader: r["count"] for r in J.read_state(spark, f"{tmp_path}/s", J.TRADERS).collect()} == {"T1": 6, "T2": 6}


def test_retention_empties_buckets_and_readers_go_on(spark, tmp_path):
    state = Buckets(spark, str(tmp_path / "s"), "item_id", n=4)
    rows = [(f"i{k}", dt.datetime(2024, 1, 1) + dt.timedelta(days=k % 2 * 20)) for k in range(40)] + [("lone", dt.datetime(2024, 1, 1))]
    state.update(spark.createDataFrame(rows, "item_id string, last_seen timestamp_ntz"), None, "r", 0)
    reader = state.current()
    gone = F.col("last_seen") < F.lit("2024-01-10").cast("timestamp_ntz")
    drop = lambda st: st.where(~gone)
    assert state.rewrite(drop, gone, "retention", 1) == 21 and state.rewrite(drop, gone, "retention", 1) == 0
    assert state.current().count() == 20 and reader.count() == 41
    assert state.rewrite(lambda st: st.limit(0), F.lit(True), "retention", 2) == 20
    assert state.current() is None or state.current().count() == 0


def test_price_retention_keeps_readers_and_survives_failures(spark, tmp_path, monkeypatch):
    path, t0 = str(tmp_path / "p"), dt.datetime(2024, 1, 20, 12)
    rows = [(k, t0 - dt.timedelta(hours=7 * k)) for k in range(60)] + [(99, None)]
    ST.write_prices(spark.createDataFrame(rows, "i int, ts timestamp_ntz"), path, "a")
    left = lambda now, days: sorted(k for k, t in rows if t is None or t >= now - dt.timedelta(days=days))
    held = lambda: sorted(r.i for r in ST.read_prices(spark, path).collect())
    reader = ST.read_prices(spark, path)
    assert ST.expire(spark, path, t0, 10) == 61 - len(left(t0, 10)) and ST.expire(spark, path, t0, 10) == 0
    assert held() == left(t0, 10) and reader.count() == 61      # its files are still there
    real, calls = ST.remove, []

    def failing(spark, p):
        calls.append(p)
        raise RuntimeError("lost")
    monkeypatch.setattr(ST, "remove", failing)
    with pytest.raises(RuntimeError):
        ST.expire(spark, path, t0, 5)                           # fails between the cut and the deletion
    assert held() == left(t0, 5) and calls
    monkeypatch.setattr(ST, "remove", real)
    days = len(ST.folders(spark, path))
    reader = ST.read_prices(spark, path)
    assert ST.expire(spark, path, t0, 2) == len(left(t0, 5)) - len(left(t0, 2)) and held() == left(t0, 2)
    assert len(ST.folders(spark, path)) < days and reader.count() == len(left(t0, 5))
    assert ST.newest(spark, path) == t0 and ST.expire(spark, path, t0 + dt.timedelta(days=9), 1) == len(left(t0, 2)) - 1
    assert ST.newest(spark, path) is None and held() == [99] and ST.expire(spark, path, t0, 0) == 0


def plain_ema(values, start, alpha=0.1):
    for v in values:
        start = (1 - alpha) * start + alpha * v
    return start


def test_calibration_merges_in_any_grouping(spark):
    rng = np.random.default_rng(2)
    cycles = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), *map(float, rng.normal(5, 2, 4))) for k in range(40)]
    frame = spark.createDataFrame(cycles, "cycle timestamp_ntz, profit_mean double, profit_std double, roi_mean double, roi_std double")
    want = [plain_ema([c[i + 1] for c in cycles], (0.0, 1.0, 0.0, 1.0)[i]) for i in range(4)]
    pairs = L.calibration_pairs(frame)
    assert [*L.smoothed(pairs).first()][1:] == pytest.approx(want, rel=1e-9)
    for cut, late in ((dt.datetime(2024, 1, 1, 7), None), (dt.datetime(2024, 1, 2, 3), dt.datetime(2024, 1, 2, 9))):
        some = L.merged_pairs(pairs, cut)
        some = some if late is None else L.merged_pairs(some, late)
        assert some.count() < 40 and [*L.smoothed(some).first()] == pytest.approx([40, *want], rel=1e-9)
    path = [tuple(r)[1:] for r in L.calibration_path(frame).orderBy("cycle").collect()]
    for k in (0, 1, 17, 39):
        assert path[k] == pytest.approx([plain_ema([c[i + 1] for c in cycles[:k + 1]], (0.0, 1.0, 0.0, 1.0)[i]) for i in range(4)], rel=1e-9)
    again = L.newest_of(pairs, L.calibration_pairs(frame.limit(5)))
    assert again.count() == 40


@pytest.mark.parametrize("n", [0, 1, 5, 4000])
def test_prefix_scans(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(k), int(v), float(d), float(a)) for k, v, d, a in zip(rng.permutation(n), rng.integers(-9, 9, n), rng.uniform(0.5, 1, n), rng.normal(size=n))]
    df = spark.createDataFrame(rows, "k long, v int, d double, a double").repartition(7)
    got = prefix_scan(df, ["k"], ["v"], ["s"], SUM)
    most = prefix_scan(got, ["k"], ["v"], ["m"], LARGEST)
    both = sorted(tuple(r) for r in prefix_scan(most, ["k"], ["d", "a"], ["p", "x"], AFFINE).collect())
    run, top, decay, x = 0, None, 1.0, 0.0
    for k, v, d, a, s, m, p, y in both:
        run, top, decay, x = run + v, v if top is None else max(top, v), decay * d, x * d + a
        assert (s, m) == (run, top) and p == pytest.approx(decay, abs=1e-12) and y == pytest.approx(x, abs=1e-9)
    assert len(both) == n


def test_sessions_and_smoothing_have_no_single_partition_window(spark):
    cycles = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), k, k // 2, 0.5, 1.0, 1.0, 1.0, 1.0, 1.0) for k in range(30)],
                                   "cycle timestamp_ntz, items_processed long, profitable_count long, profitable_rate double, avg_profit double, "
                                   "profit_mean double, profit_std double, roi_mean double, roi_std double")
    frame = L.training_sessions(cycles, keep=4)
    assert [(r.total_items_seen, r.total_profitable_items) for r in frame.orderBy("cycle").collect()] == [
        (sum(range(k + 1)), sum(j // 2 for j in range(k + 1))) for k in range(26, 30)]
    for f in (frame, L.calibration_ema(cycles), L.calibration_path(cycles)):
        assert "Window" not in f._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot", ["spread", "ties", "tiny", "huge"])
def test_quantiles_of_a_group_with_nearly_all_rows(spark, hot):
    rng = np.random.default_rng(7)
    big = {"spread": rng.lognormal(3, 4, 6000), "ties": rng.integers(0, 3, 6000).astype(float),
           "tiny": 1 + rng.integers(0, 900, 6000) * 2.0 ** -52, "huge": rng.choice([-1.7e308, 1.7e308, 1.0], 6000)}[hot]
    groups = {"a": big, "b": rng.normal(size=7), "c": np.array([4.0]), None: rng.normal(size=30)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: (r.n, r.q) for r in grouped_quantiles(df, "g", "x", (0.05, 0.25, 0.5, 0.95), small=20).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        s, want = np.sort(v), []
        for q in (0.05, 0.25, 0.5, 0.95):
            at = (len(s) - 1) * q
            a, b = s[int(np.floor(at))], s[int(np.ceil(at))]
            want.append(a if a == b else a + (at - np.floor(at)) * (b - a))
        assert got[g][0] == len(v) and got[g][1] == pytest.approx(want, rel=1e-12)


def test_quantiles_with_infinite_values_and_nan(spark):
    values = [float("nan")] * 300 + [float("inf")] * 200 + [float("-inf")] * 100 + [float(k) for k in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    at = lambda r: exact_quantile(df, "x", r / 1599, small=50)
    assert at(0) == at(99) == float("-inf") and at(1100) == at(1299) == float("inf") and np.isnan(at(1300)) and np.isnan(at(1599))
    assert at(100) == pytest.approx(0.0, abs=1e-9) and at(600) == pytest.approx(500.0, rel=1e-9)
    assert exact_quantile(df.where("isnan(x)"), "x", 0.3, small=50) != exact_quantile(df.where("x < 0"), "x", 0.3, small=50) == float("-inf")


def test_box_and_cycle_statistics_of_a_hot_group(spark, monkeypatch):
    from marketflow.operators import quantile
    rng = np.random.default_rng(1)
    rows = [("hot" if k % 100 else f"c{k % 300}", float(x), "i", 10, dt.datetime(2024, 1, 1)) for k, x in enumerate(rng.normal(100, 30, 5000))]
    df = spark.createDataFrame(rows, "category string, flea_price double, item_id string, profit long, ts timestamp_ntz")
    def box():
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in SU.box_stats(df).collect())
    want, cyc = box(), L.cycle_stats(df).first()
    monkeypatch.setattr(quantile.grouped_quantiles, "__defaults__", (100,))
    monkeypatch.setattr(quantile, "FEW", 16)
    assert box() == want and [*L.cycle_stats(df).first()][1:] == pytest.approx([*cyc][1:], rel=1e-9)


def test_lateness_and_windows_lose_nothing(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(0, "a", t0, 1.0), (0, "b", t0 + dt.timedelta(hours=10), 2.0), (1, "a", t0 + dt.timedelta(hours=3), 3.0),
            (1, "b", t0 + dt.timedelta(hours=10), 2.0), (2, "c", t0 + dt.timedelta(hours=30), 4.0), (2, None, None, 9.0)]
    df = spark.createDataFrame(rows, "delivery int, user_id string, ts timestamp_ntz, value double")
    assert J.lateness(df) == f"{10 * 3600 + 1} seconds"          # 00:00 may be read after 10:00 of its own delivery
    assert J.lateness(df.where("delivery > 0")) == f"{7 * 3600 + 1} seconds" and J.lateness(df.limit(0)) == "1 seconds"
    for k, (_, own) in enumerate(itertools.groupby(rows, lambda r: r[0])):
        spark.createDataFrame(list(own), df.schema).drop("delivery").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for n, name in enumerate(f for f in os.listdir(f"{tmp_path}/in") if f.endswith(".parquet")):
            if os.path.getmtime(f"{tmp_path}/in/{name}") > 1e9 + 1000:
                os.utime(f"{tmp_path}/in/{name}", (1e9 + k, 1e9 + k))
    src = spark.readStream.schema("user_id string, ts timestamp_ntz, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    J.windowed_trends_stream(J.deduplicated(src, J.lateness(df)), f"{tmp_path}/out", f"{tmp_path}/c", window="4 hours", slide="2 hours", mode="append").awaitTermination()
    got = {(r.window_start, r.user_id): r.data_points for r in J.read_windowed_trends(spark, f"{tmp_path}/out").collect()}
    h = lambda k: t0 + dt.timedelta(hours=k)
    assert got == {(h(-2), "a"): 1, (h(0), "a"): 2, (h(2), "a"): 1, (h(8), "b"): 1, (h(10), "b"): 1}   # c's windows are still open


def test_start_guard(spark, tmp_path, monkeypatch):
    """A fresh store defers the start and no file is taken; an old one lets it begin."""
    from test_round2 import _payload
    src, store, ckpt = (f"{tmp_path}/{n}" for n in ("in", "store", "ckpt"))
    _payload(spark, src, 0)
    assert J.stream_ingest(spark, f"{src}/*", store, ckpt, guard=True) is not None     # an empty store is not fresh
    for q in spark.streams.active:
        q.awaitTermination()
    assert ST.read_prices(spark, store).count() == 10
    _payload(spark, src, 1)
    assert J.stream_ingest(spark, f"{src}/*", store, ckpt, guard=True) is None
    assert ST.read_prices(spark, store).count() == 10
    monkeypatch.setattr(J, "utc_now", lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) + dt.timedelta(minutes=30))
    J.stream_ingest(spark, f"{src}/*", store, ckpt, guard=True).awaitTermination()
    assert ST.read_prices(spark, store).count() == 20


def test_errors_inside_a_clock_are_seen(spark, tmp_path):
    ST.Versions(spark, f"{tmp_path}/rules").write(J.AL.rules_frame(spark, [J.AL.rule("a", J.AL.PROFIT_THRESHOLD)]), "start", 0)
    spark.createDataFrame([("i", "n", 5.0)], "item_id string, name string, profit double").write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("item_id string, name string, profit double").parquet(f"{tmp_path}/in")

    def clock(batch_id):
        return None + batch_id
    with pytest.raises(Exception, match="unsupported operand"):
        J.alert_stream(src, f"{tmp_path}/rules", f"{tmp_path}/h", f"{tmp_path}/c", clock=clock, seq=()).awaitTermination()
