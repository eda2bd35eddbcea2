"""The canonical ``prices`` table derived from the shared test tables.

One ship-day becomes one 5-minute polling cycle; an item is a part, its trader a
supplier bucket.  This is the reader every query starts from; the ingested
table with the same columns is ``sources.store``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import gdiv
from ..operators.levels import level_requirement_expr

EPOCH_DAY = "1995-01-01"
CYCLE_BASE = "2024-01-01 00:00:00"
MINUTES_PER_DAY = 5   # a ship day is one poll


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str, with_levels: bool = True, last_minutes: int | None = None,
           place: str | None = None) -> DataFrame:
    """``lineitem ⋈ part`` mapped to the snapshot schema (see FIXTURES.md §B).

    ``last_minutes`` bounds the raw ship day from below by the newest one, so that the scan itself skips what lies
    before the window; the bound is one scalar subquery over that column (every line has its part, so it is also
    the newest poll).  Operators still apply their own exact window.

    ``place`` names a helper column: the part key, by which the rows are then partitioned whatever the join.

    The join is a plain equi-join on the part key; Catalyst broadcasts ``part``
    while it is under the broadcast threshold and sort-merges beyond it.
    Only the columns the mapping needs are read (pruned at the scan).
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_shipdate",
        # numbers before the join: half the bytes of the flags' text in a shuffle
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("int").alias("no_flea"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7), 1).otherwise(0)
         .cast("int").alias("marked_only"))
    if last_minutes is not None:
        days = F.make_dt_interval(F.lit(math.ceil(last_minutes / MINUTES_PER_DAY)))
        newest = read_table(spark, sf_dir, "lineitem").select(F.max("l_shipdate") - days)
        li = li.filter(F.col("l_shipdate") >= newest.scalar())
    if place:
        li = li.repartition("l_partkey")
    pt = read_table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    if with_levels:
        # The level depends on the item's name and category only: derive it on the
        # item catalogue (the small, broadcast side), not once per price row.
        pt = pt.withColumn("_lvl", level_requirement_expr("p_name", "p_type"))
    j = li.join(pt, li.l_partkey == pt.p_partkey)

    flea = F.floor(F.col("p_retailprice") * 2).cast("bigint")
    trader = F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("bigint")
    minutes = F.datediff(F.to_date("l_shipdate"), F.lit(EPOCH_DAY).cast("date")) * MINUTES_PER_DAY
    ts = F.lit(CYCLE_BASE).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), minutes, F.lit(0))

    out = j.select(
        F.col("l_partkey").cast("string").alias("item_id"),
        F.col("p_name").alias("name"),
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("short_name"),
        F.col("p_type").alias("category"),
        F.when(F.col("l_suppkey") % 29 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("T"), (F.col("l_suppkey") % 8).cast("string"))).alias("trader_name"),
        ts.alias("ts"),
        flea.alias("flea_price"),
        trader.alias("trader_price"),
        (trader - flea).alias("profit"),
        F.when(F.col("l_partkey") % 50 == 0, F.lit(0).cast("bigint"))
         .otherwise(flea + F.col("l_orderkey") % 401 - 100).cast("bigint").alias("avg_24h_price"),
        (flea - F.when(F.col("l_partkey") % 40 == 0, 0).otherwise(F.col("l_orderkey") % 300))
        .cast("bigint").alias("low_24h_price"),
        (flea + F.when(F.col("l_partkey") % 40 == 0, 0).otherwise((F.col("l_suppkey") * 7) % 350))
        .cast("bigint").alias("high_24h_price"),
        F.when(F.col("l_partkey") % 33 == 0, 0).otherwise(F.floor("p_retailprice"))
         .cast("bigint").alias("base_price"),
        ((F.col("l_orderkey") % 81 - 40).cast("double") / 2).alias("change_last_48h"),
        (F.col("p_size") % 4).cast("int").alias("width"),
        (F.col("p_size") % 3 + 1).cast("int").alias("height"),
        ((F.col("p_size") % 10).cast("double") / 4).alias("weight"),
        ((F.col("l_quantity") - 1) * 5).cast("int").alias("last_offer_count"),
        (F.col("l_linenumber") % 4 + 1).cast("int").alias("trader_level_required"),
        "no_flea", "marked_only", "l_orderkey", "l_linenumber", "l_suppkey",
        *([F.col("_lvl").alias("flea_level_required")] if with_levels else []),
        *([F.col("l_partkey").alias(place)] if place else []),
    )
    return derive_quote(out)


def derive_quote(df: DataFrame) -> DataFrame:
    """#4: price velocity and liquidity score from the raw quote columns."""
    avg24 = F.col("avg_24h_price")
    return df.withColumns({
        "price_velocity": F.when(avg24 > 0, gdiv(avg24 - F.col("flea_price"), avg24) * 100)
                           .otherwise(F.lit(0.0)),
        "liquidity_score": F.least(F.greatest(F.col("last_offer_count"), F.lit(0)).cast("double") / 50,
                                   F.lit(1.0)) * 100,
    })
