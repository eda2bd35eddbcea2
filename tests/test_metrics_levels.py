"""Per-row metrics, fees, level rules, timestamps (exact expectations)."""

import datetime as dt

from pyspark.sql import functions as F

from marketflow.operators import levels as LV
from marketflow.operators import metrics as M
from marketflow.sources import payload as P


def test_zero_guards(spark):
    df = spark.createDataFrame(
        [("1", 1000, 10000, 1, 1, 1.0, 11000), ("2", 500, 0, 2, 0, 0.0, 0), ("3", 0, 5000, 1, 1, 0.5, 5000)],
        "item_id string, profit long, flea_price long, width int, height int, weight double, avg_24h_price long")
    r = {row.item_id: row for row in M.trade_metrics(df).collect()}
    assert r["1"].roi == 10.0 and r["1"].profit_per_slot == 1000.0 and r["1"].profit_per_kg == 1000.0
    assert r["2"].roi == 0 and r["2"].profit_per_slot == 0 and r["2"].profit_per_kg == 0
    assert r["2"].discount_percent == 0


def test_listing_fee_example(spark):
    df = spark.createDataFrame([(10000, 15000, 0)], "base_price long, flea_price long, profit long")
    fee = M.listing_fee(df, center_level=2).first().listing_fee
    assert fee == 900            # 10000 * .05 * 4 ** 0.5 * 0.9 (intel-center level 2)


def test_listing_fee_guards(spark):
    df = spark.createDataFrame([(0, 100, 0), (100, 0, 0), (100, 50, 0)], "base_price long, flea_price long, profit long")
    fees = [r.listing_fee for r in M.listing_fee(df).collect()]
    assert fees == [0, 0, 5]


LEVEL_CASES = [
    (None, None, 15), ("", "", 15),
    ("red hot plate warmer", "STANDARD", 35),        # long item pattern, substring
    ("Widget", "PROMO", 40),                         # item rule beats category rule
    ("copper rod", "SMALL", 30),                     # short pattern, delimiter-bounded
    ("rodent trap", "SMALL", 15),                    # short pattern inside a word: no match
    ("plain box", "PROMO", 25),                      # exact category
    ("plain box", "promo", 25),                      # case-insensitive category
    ("plain box", "Economy", 20),
    ("plain box", "LARGE", 30),                      # plural rule LARGES matches LARGE
    ("plain box", "promos", 25),                     # plural of a category rule
    ("plain box", "MEDIUM", 15),
]


def test_level_rules(spark):
    df = spark.createDataFrame([(n, c) for n, c, _ in LEVEL_CASES], "name string, category string")
    got = [r.lvl for r in df.select(LV.level_requirement_expr("name", "category").alias("lvl")).collect()]
    assert got == [lvl for _, _, lvl in LEVEL_CASES]


def test_level_table_form_matches_expression(spark):
    df = spark.createDataFrame([(n, c) for n, c, _ in LEVEL_CASES], "name string, category string")
    tab = LV.level_requirement(df, LV.rules_frame(spark))
    expr = df.withColumn("e", LV.level_requirement_expr("name", "category"))
    a = sorted((r.name or "", r.category or "", r.flea_level_required) for r in tab.collect())
    b = sorted((r.name or "", r.category or "", r.e) for r in expr.collect())
    assert a == b


def test_normalize_timestamps(spark):
    rows = [("2024-01-15T10:30:00.123456",), ("2024-01-15 10:30:00.123456",), ("2024-01-15 10:30:00",),
            (None,), ("",), ("garbage",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r.ts for r in df.select(P.normalize_timestamps("t").alias("ts")).collect()]
    assert got[0] == dt.datetime(2024, 1, 15, 10, 30, 0, 123456)
    assert got[1] == dt.datetime(2024, 1, 15, 10, 30, 0, 123456)
    assert got[2] == dt.datetime(2024, 1, 15, 10, 30, 0)
    assert got[3:] == [None, None, None]


def test_volume_tier_quirk(spark):
    df = spark.createDataFrame([(5,), (6,), (201,)], "last_offer_count int").withColumn("profit", F.lit(1))
    out = M.volume_features(df).collect()
    assert [r.volume_tier for r in out] == ["Unreliable", "Very Low", "Very High"]
    assert out[0].volume_reliable is True        # 5 offers: reliable yet in the lowest tier
