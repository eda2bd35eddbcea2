"""Tests of the third round's findings, on rows of their own."""

import math

from pyspark.sql import functions as F

from marketflow.operators import levels as LV
from marketflow.plans.registry import round_binary
from marketflow.session import COMPILED_BYTES, prepare
from marketflow.sources import payload as P


def test_rounding_is_that_of_round_bit_for_bit(spark):
    values = [0.0, -0.0, 0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.49999999999999994, -0.3, 2.0578125, 1e15 + 0.5, -1e15 - 0.5,
              4503599627370495.5, 4503599627370497.0, 1e300, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(2)
    for digits in (0, 4, 6):
        scale = float(10 ** digits)
        rows = df.select("v", round_binary(F.col("v"), digits).alias("got"), (F.round(F.col("v") * scale, 0) / scale).alias("want")).collect()
        for r in rows:
            assert repr(r["got"]) == repr(r["want"]), (digits, r)
    made = df.select(round_binary(F.col("v"), 6).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in made.lower()         # decimal text took longer than the columns it rounded
    assert math.isnan(df.where("isnan(v)").select(round_binary(F.col("v"), 6)).first()[0])


class _Session:
    """A session as ``prepare`` sees one: its settings and the options of its JVMs."""

    def __init__(self, options: str = "", limit: int = 65535):
        from types import SimpleNamespace
        self.set = {"spark.checkpoint.dir": "/tmp/x", "spark.sql.codegen.hugeMethodLimit": str(limit)}
        self.conf = SimpleNamespace(get=lambda k, d=None: self.set.get(k, d), set=self.set.__setitem__)
        self.sparkContext = SimpleNamespace(setCheckpointDir=lambda p: None, master="local", getConf=lambda: {"spark.driver.extraJavaOptions": options})


def test_generated_code_stays_within_what_is_compiled():
    for options, limit, wide, want in (("", 65535, True, COMPILED_BYTES), ("", COMPILED_BYTES, False, 65535), ("", 65535, False, 65535),
                                       ("-XX:-DontCompileHugeMethods", 65535, True, 65535), ("", 20_000, True, 20_000)):
        s = _Session(options, limit)
        prepare(s, wide)
        assert int(s.set["spark.sql.codegen.hugeMethodLimit"]) == want


def test_a_large_group_is_not_moved_into_one_task(spark, monkeypatch):
    from marketflow.operators import quantile as Q
    plans = []
    holding = Q._holding
    monkeypatch.setattr(Q, "_holding", lambda counts, order: plans.append(counts._jdf.queryExecution().executedPlan().toString()) or holding(counts, order))
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"))
    got = {r["g"]: r["q"] for r in Q.grouped_quantiles(df, "g", "x", [0.0, 0.5, 1.0], small=100).collect()}
    assert got == {0: [0.0, 9999.0, 19998.0], 1: [1.0, 10000.0, 19999.0]}
    assert plans and all("SortMergeJoin" not in p and "BroadcastHashJoin" in p for p in plans)


def test_only_rows_that_reach_a_threshold_are_searched(spark, monkeypatch):
    from marketflow.operators import first_match as M
    seen = []
    earliest = M._earliest
    monkeypatch.setattr(M, "_earliest", lambda rows, rules, poll: seen.append(rows.count()) or earliest(rows, rules, poll))
    rows = [(t, i, t * 100 + i, [float(i), -float(i)]) for t in range(5) for i in range(100)]
    g = spark.createDataFrame(rows, "_t long, i long, _g long, _meas array<double>")
    rules = spark.createDataFrame([(1, 0, 97.0, 1, None), (2, 1, -1.0, 1, 0), (3, 0, 500.0, 0, None)], "_rule long, k int, v double, gap long, last long")
    got = {tuple(r) for r in M.replayed_matches(g, rules, 2).select("_rule", "_t", "_g").collect()}
    assert got == {(1, 0, 97), (1, 2, 297), (1, 4, 497), (2, 2, 200), (2, 4, 400)}
    assert seen == [3 * 3 + 2 * 2]


def test_a_pass_takes_all_fits_together(spark):
    import numpy as np

    from marketflow.operators.ml import cluster as C
    rng = np.random.default_rng(7)
    x, keys = rng.normal(size=(300, 3)), rng.integers(-2**62, 2**62, 300)
    points = spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(x, keys)], "z array<double>, key long").repartition(3)
    fits = {0: x[:2].copy(), 3: x[5:10].copy()}
    got = C._pass(points, fits, None).groupBy("fit", "cluster").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum(F.col("v")[1]).alias("v")).collect()
    for r in got:
        d = ((x[:, None, :] - fits[r["fit"]][None]) ** 2).sum(axis=2)
        mine = d.argmin(axis=1) == r["cluster"]
        assert r["n"] == mine.sum() and np.isclose(r["w"], d.min(axis=1)[mine].sum()) and np.isclose(r["v"], x[mine, 1].sum())
    assert len(got) == 7
    drawn = {r["fit"]: r for r in C._pass(points, fits | {5: np.zeros((0, 3))}, 11).groupBy("fit").agg(F.min(F.struct("w", "n", "v")).alias("m")).collect()}
    for fit, centres in fits.items():
        least = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        with np.errstate(divide="ignore"):
            race = np.where(least > 0, -np.log(C._uniform(keys.astype(np.uint64), fit, 11)) / np.where(least > 0, least, 1), np.inf)
        assert drawn[fit]["m"]["v"] == x[race.argmin()].tolist()
    assert set(drawn) == {0, 3, 5}
    assert not hasattr(C, "pd")              # points come as Arrow arrays, not as pandas rows


def test_the_reference_table_makes_each_row_once(spark):
    made = spark.sparkContext.accumulator(0)

    def named(i):
        made.add(1)
        return f"Thing {i % 7}"

    offer = lambda price, dealer: F.struct(F.lit(price).cast("long").alias("price"), F.lit("x").alias("source"), F.lit("RUB").alias("currency"),
                                           F.struct(F.lit(dealer).alias("name"), F.lit(1).cast("long").alias("minTraderLevel"), F.lit(None).cast(P.TASK).alias("taskUnlock")).alias("vendor"))
    items = spark.range(0, 400, 1, 4).select(
        F.col("id").cast("string").alias("id"), F.udf(named, "string")("id").alias("name"), F.lit("t").alias("shortName"), F.col("id").alias("basePrice"),
        F.array(F.lit("noFlea")).alias("types"), F.struct(F.when(F.col("id") % 3 == 0, "PROMO").otherwise("other").alias("name")).alias("category"),
        F.lit(None).cast("array<struct<name:string>>").alias("handbookCategories"),
        F.array(offer(900, "Flea Market"), offer(5, "A"), offer(None, "B"), offer(8, "C"), offer(8, "D")).alias("sellFor"))
    out = LV.lock_reference_table(items).collect()
    assert made.value == 400
    assert [(-r["flea_level_required"], r["name"]) for r in out] == sorted((-r["flea_level_required"], r["name"]) for r in out)
    assert len({r["item_id"] for r in out}) == len(out) == 400
    assert {(r["best_trader"], r["trader_price"], r["flea_level_required"]) for r in out} == {("C", 8, 25), ("C", 8, 15)}


def test_pages_are_small_on_disk(spark, tmp_path):
    items = spark.range(3000).withColumnRenamed("id", "n").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in P.ITEM if f.name not in ("id", "sellFor")],
                                     F.sha2(F.col("n").cast("string"), 256).alias("id"),
                                     F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.struct(
                                         (F.col("n") * i).alias("price"), F.lit("fleaMarket").alias("source"), F.lit("RUB").alias("currency"), F.lit(None).cast(P.VENDOR).alias("vendor"))).alias("sellFor"))
    P.write_pages(items, str(tmp_path / "pages"))
    items.write.json(str(tmp_path / "plain"))
    size = lambda name: sum(f.stat().st_size for f in (tmp_path / name).glob("part-*"))
    assert size("pages") < size("plain") / 3
    assert P.read_payload(spark, str(tmp_path / "pages")).select("id", "sellFor").exceptAll(items.select("id", "sellFor")).count() == 0
    assert P.read_payload(spark, str(tmp_path / "pages")).count() == 3000
