"""Tests of the fourth round's findings, on rows of their own."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketflow.operators import ranking as R
from marketflow.operators import scoring as SC
from marketflow.operators.ml import iforest as IF
from marketflow.operators.quantile import exact_quantile, grouped_quantiles
from marketflow.plans import queries as _queries  # noqa: F401  (registers the queries)
from marketflow.plans.registry import run
from marketflow.session import ALL_KEYS, FREED, prepare


@pytest.fixture
def setting(spark):
    """Settings for one test."""
    had = {}

    def put(name, value):
        had.setdefault(name, spark.conf.get(name, None))
        spark.conf.set(name, value)
    yield put
    for name, value in had.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of lines and parts; parts 3 and 4 come twice, some keys are null or have no part."""
    part = spark.range(60).select(
        F.when(F.col("id") % 29 != 28, F.col("id") % 55 + F.when(F.col("id") == 57, 2).otherwise(0)).alias("p_partkey"), F.concat(F.lit("hot plate "), F.col("id")).alias("p_name"),
        F.concat(F.lit("TYPE"), F.col("id") % 5).alias("p_type"), (F.col("id") % 50 + 1).cast("int").alias("p_size"), (F.col("id") * 1.1 + 900).alias("p_retailprice"))
    line = spark.range(3000).select(
        (F.col("id") % 700).alias("l_orderkey"), F.when(F.col("id") % 31 != 30, F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 62)).alias("l_partkey"),
        (F.col("id") % 90).alias("l_suppkey"), (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"), (F.col("id") % 50 + 1).cast("double").alias("l_quantity"),
        (F.col("id") * 37 % 90_001 + 900).cast("double").alias("l_extendedprice"), F.element_at(F.split(F.lit("R A N"), " "), (F.col("id") % 3 + 1).cast("int")).alias("l_returnflag"),
        F.when(F.col("id") % 2 == 0, "O").otherwise("F").alias("l_linestatus"),
        (F.lit("1995-01-02").cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 900).cast("int"))).alias("l_shipdate"))
    for name, df in (("part", part), ("lineitem", line)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("descending", [True, False])
def test_ranks_by_place_are_those_of_all_rows(spark, setting, descending):
    setting("spark.sql.execution.arrow.maxRecordsPerBatch", "7")        # values cross batches and partitions
    value = (F.when(F.col("id") % 3 == 0, 50.0).when(F.col("id") % 41 == 0, float("nan")).when(F.col("id") % 37 == 0, F.when(F.col("id") % 2 == 0, 0.0).otherwise(-0.0))
             .when(F.col("id") % 29 != 0, (F.col("id") * 7919 % 97).cast("double") - 20))
    df = spark.range(4000).select("id", (F.col("id") * 31 % 301).alias("place"), value.alias("v"))
    want = {r["id"]: (r["r"], r["p"]) for r in R.average_rank(df, "v", "r", descending, "p").collect()}
    for place in (F.col("place"), F.col("id") % 9):
        got = R.average_rank(df.withColumn("place", place), "v", "r", descending, "p", place="place").collect()
        assert len(got) == 4000 and {r["id"]: (r["r"], r["p"]) for r in got} == want
    none = R.average_rank(df.where("v is null"), "v", "r", pct_out="p", place="place")
    assert {(r["r"], r["p"]) for r in none.collect()} == {(None, None)} and none.columns == ["id", "place", "v", "r", "p"]


def test_opportunity_ml_moves_ranks_and_not_its_wide_rows(spark, setting, tables):
    from marketflow.plans.queries_scoring import full_features
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting(ALL_KEYS, "true")
    prepare(spark, wide=True, placed=True)
    out = run("opportunity_ml", spark, tables)
    plan = plan_of(out)
    assert spark.conf.get(FREED, "false") == "false"
    keys = [line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert sorted(keys) == ["_rp", "l_partkey", "p_partkey"]       # a row was moved by its score, with all of its columns
    prepare(spark)
    assert spark.conf.get(ALL_KEYS) == "true"
    for own in ("true", "false"):                                  # what the session has set itself stays
        spark.conf.set(ALL_KEYS, own)
        prepare(spark)
        assert spark.conf.get(ALL_KEYS) == own
    spark.conf.set(ALL_KEYS, "true")
    plain = SC.opportunity_ml(full_features(spark, tables))
    assert out.columns == plain.columns
    id_ = ("item_id", "name", "l_orderkey", "l_linenumber", "l_suppkey", "ts", "flea_price", "trader_price", "no_flea", "marked_only")
    three = ("ml_opportunity_score", "opportunity_rank", "opportunity_percentile")
    a, b = (sorted([tuple(str(r[c]) for c in id_) + tuple(r[c] for c in three) for r in x.collect()]) for x in (out, plain))
    assert len(a) == len(b) > 2500
    for x, y in zip(a, b):
        assert x[:-3] == y[:-3] and x[-3:] == pytest.approx(y[-3:], abs=1e-6)


def test_finished_jobs_of_opportunity_ml_leave_no_shuffle_files(spark, setting, tables):
    before = shuffles(spark)
    out = run("opportunity_ml", spark, tables)
    assert shuffles(spark) <= before
    assert out.count() == out.count() > 0


def shuffles(spark):
    """Ids of the shuffles that have map outputs."""
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    return {int(k) for k in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(tracker.shuffleStatuses().keySet())}


def grown(x, trees, seed=0):
    """A forest over the rows ``x`` as ``isolation_forest`` holds it."""
    out = []
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        nodes = np.array(IF._grow(x[rng.choice(len(x), 256)], rng, 8), dtype=object)
        out.append({k: nodes[:, i].astype(float if k == "threshold" else int) for i, k in enumerate(("feature", "threshold", "left", "right", "size", "depth"))} | {"max_depth": 8})
    return out


def walked(x, forest):
    h = np.zeros(len(x))
    for t in forest:
        h += IF._path_lengths(x, t)
    return h


@pytest.mark.parametrize("kind", ["normal", "few values", "one feature", "constant", "skewed"])
def test_forest_tables_equal_the_walks_bit_for_bit(kind):
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(size=(3000, 5)), "few values": rng.integers(-2, 3, (3000, 4)).astype(float), "one feature": rng.normal(size=(3000, 1)),
         "constant": np.ones((3000, 3)), "skewed": rng.lognormal(0, 3, (3000, 3))}[kind]
    forest = grown(x, 30)
    odd = np.array([np.nan, np.inf, -np.inf, 0.0, -0.0, 1e300])
    rows = np.vstack([x * 1.5, x[:len(odd)] * 0 + odd[:, None], rng.choice(odd, (500, x.shape[1]))])
    on_cuts = rng.choice(np.concatenate([t["threshold"] for t in forest]), (1000, x.shape[1]))
    rows = np.vstack([rows, on_cuts, np.nextafter(on_cuts, -np.inf)])
    assert (IF._summed_paths(rows, *IF._tables(forest, x.shape[1])) == walked(rows, forest)).all()
    assert len(IF._summed_paths(rows[:0], *IF._tables(forest, x.shape[1]))) == 0


def test_a_row_takes_less_than_a_walk_down_each_tree():
    x = np.random.default_rng(4).normal(size=(20_000, 7))
    forest = grown(x, 100)
    tables, took = IF._tables(forest, 7), []
    for f in (lambda: walked(x, forest), lambda: IF._summed_paths(x, *tables)):
        began = time.process_time()
        f()
        took.append(time.process_time() - began)
    assert took[1] < took[0] / 2


def test_the_forest_draws_arrays_for_few_rows(spark, monkeypatch):
    """Every row had an array of all its draws."""
    plans, frame = [], type(spark.range(1))
    taken = frame.persist
    monkeypatch.setattr(frame, "persist", lambda self, *a: plans.append(plan_of(self)) or taken(self, *a))
    df = spark.range(60_000).select(F.col("id").cast("string").alias("item_id"), (F.col("id") * 7919 % 10_007).cast("double").alias("a"), F.rand(1).alias("b"))
    out = IF.isolation_forest(df, features=["a", "b"], trees=4).collect()
    assert len(out) == 60_000 and 0.04 < sum(r.is_anomaly for r in out) / 60_000 < 0.06
    assert any("least(" in p and "xxhash64" in p for p in plans)


def test_the_rows_of_a_quantile_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x * 37 % 5003) / 7
    got = exact_quantile(spark.range(4000).select(counted("id").alias("x")), "x", 0.95, small=50)
    assert got == pytest.approx(np.quantile(np.arange(4000) * 37 % 5003 / 7, 0.95), rel=1e-12) and seen.value == 4000


def test_quantiles_equal_those_of_the_groups(spark):
    rng = np.random.default_rng(6)
    ends = [float("nan")] * 40 + [float("inf")] * 30 + [float("-inf")] * 20
    for values in (rng.lognormal(3, 4, 3000), rng.integers(0, 3, 3000), 1 + rng.integers(0, 900, 3000) * 2.0 ** -52, rng.choice([-1.7e308, 1.7e308, 1.0], 3000), ends * 20,
                   [*ends, *rng.normal(size=3000)], np.full(3000, 7.5)):
        df = spark.createDataFrame([(0, float(v)) for v in values] + [(0, None)], "g int, x double").repartition(3).checkpoint(eager=True)
        qs = [0.0, 0.005, 0.00667, 0.3, 0.5, 0.9777, 0.978, 0.99, 1.0]
        want = grouped_quantiles(df, "g", "x", qs, small=20).first()["q"]
        assert [repr(exact_quantile(df, "x", q, small=20)) for q in qs] == [repr(v) for v in want]
