"""#1-9: market API payloads (nested JSON) → flat price rows; versioned layouts; timestamps.

The payload is read with an explicit schema (no inference pass over the
files); each page of the API is one file, so a multi-file read is the page
union.  Offer arrays are reduced with higher-order functions inside the row —
no explode, no shuffle — and the best-sell fold keeps the array order, so
ties and the carry-over of vendor details behave as the sequential loop does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import gdiv
from ..operators.levels import level_requirement_expr

TASK = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())])
VENDOR = T.StructType([T.StructField("name", T.StringType()), T.StructField("minTraderLevel", T.LongType()),
                       T.StructField("taskUnlock", TASK)])
OFFER = T.StructType([T.StructField("price", T.LongType()), T.StructField("source", T.StringType()),
                      T.StructField("currency", T.StringType()), T.StructField("vendor", VENDOR)])
NAMED = T.StructType([T.StructField("name", T.StringType())])
ITEM = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("shortName", T.StringType()), T.StructField("width", T.LongType()),
    T.StructField("height", T.LongType()), T.StructField("basePrice", T.LongType()),
    T.StructField("avg24hPrice", T.LongType()), T.StructField("low24hPrice", T.LongType()),
    T.StructField("high24hPrice", T.LongType()), T.StructField("changeLast48hPercent", T.DoubleType()),
    T.StructField("weight", T.DoubleType()), T.StructField("iconLink", T.StringType()),
    T.StructField("wikiLink", T.StringType()), T.StructField("types", T.ArrayType(T.StringType())),
    T.StructField("lastOfferCount", T.LongType()), T.StructField("updated", T.StringType()),
    T.StructField("category", NAMED), T.StructField("handbookCategories", T.ArrayType(NAMED)),
    T.StructField("sellFor", T.ArrayType(OFFER)), T.StructField("buyFor", T.ArrayType(OFFER)),
])

# v4 row layout, in order (28 columns).
V4_COLUMNS = ("item_id", "name", "ts", "flea_price", "trader_price", "trader_name", "profit", "icon_link",
              "width", "height", "avg_24h_price", "low_24h_price", "change_last_48h", "weight", "category",
              "base_price", "high_24h_price", "last_offer_count", "short_name", "wiki_link",
              "trader_level_required", "trader_task_unlock", "flea_level_required", "price_velocity",
              "liquidity_score", "api_updated", "no_flea", "marked_only")
V1_COLUMNS = V4_COLUMNS[:15]
V2_COLUMNS = V1_COLUMNS + ("base_price", "high_24h_price", "last_offer_count", "short_name", "wiki_link",
                           "trader_level_required", "trader_task_unlock", "price_velocity",
                           "liquidity_score", "api_updated")
V3_COLUMNS = V2_COLUMNS[:22] + ("flea_level_required",) + V2_COLUMNS[22:]

# Defaults filled when an older layout lacks a column (fixed values).
LAYOUT_DEFAULTS = {
    "width": 1, "height": 1, "base_price": 0, "high_24h_price": 0, "last_offer_count": 0,
    "trader_level_required": 1, "flea_level_required": 15, "price_velocity": 0.0,
    "liquidity_score": 0.0, "no_flea": 0, "marked_only": 0, "category": "Unknown",
    "icon_link": "", "wiki_link": "", "api_updated": "",
}


def read_payload(spark: SparkSession, paths) -> DataFrame:
    """#5: every page file of a poll, one item object per JSON record."""
    return spark.read.schema(ITEM).option("mode", "PERMISSIVE").json(paths)


#: Items of a page file at most; a compressed file is read by one task.
PAGE_ITEMS = 250_000


def write_pages(items: DataFrame, path: str, least: int = 1, page_items: int = PAGE_ITEMS) -> None:
    """#5: items as compressed JSON page files, where they are: ``least`` pages or more, of up to ``page_items`` each."""
    if least > 1:
        page_items = max(1, min(page_items, items.count() // least))
    items.write.option("maxRecordsPerFile", page_items).option("compression", "gzip").json(path)


def union_pages(*pages: DataFrame) -> DataFrame:
    """#5: pages fetched separately, appended in page order."""
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _or(c: Column, default) -> Column:
    """Python's ``x or default``: null and falsy (0, '', 0.0) take the default."""
    lit = F.lit(default)
    if isinstance(default, str):
        return F.when(c.isNull() | (c == ""), lit).otherwise(c)
    return F.when(c.isNull() | (c == 0), lit).otherwise(c)


def best_sell_offer(sell: Column) -> Column:
    """#2: first highest RUB non-flea offer; vendor level/task carry over from earlier bests."""
    usable = F.filter(F.coalesce(sell, F.array().cast(T.ArrayType(OFFER))),
                      lambda o: (o["currency"] == "RUB") & ~F.coalesce(o["source"] == "fleaMarket", F.lit(False))
                      & o["price"].isNotNull())
    init = F.struct(F.lit(0).cast("long").alias("price"), F.lit(None).cast("string").alias("source"),
                    F.lit(1).cast("long").alias("level"), F.lit(None).cast("string").alias("task"))

    def step(acc, o):
        v = o["vendor"]
        task = v["taskUnlock"]
        return F.when(o["price"] > acc["price"], F.struct(
            o["price"].alias("price"), o["source"].alias("source"),
            F.when(v.isNotNull(), _or(v["minTraderLevel"], 1)).otherwise(acc["level"]).alias("level"),
            F.when(v.isNotNull() & task.isNotNull(), task["name"]).otherwise(acc["task"]).alias("task"),
        )).otherwise(acc)

    return F.aggregate(usable, init, step)


def best_buy_price(buy: Column) -> Column:
    """#3: cheapest RUB flea-market offer (null prices skipped); null when none."""
    usable = F.filter(F.coalesce(buy, F.array().cast(T.ArrayType(OFFER))),
                      lambda o: (o["currency"] == "RUB") & (o["source"] == "fleaMarket") & o["price"].isNotNull())
    return F.array_min(F.transform(usable, lambda o: o["price"]))


def ingest_offers(payload: DataFrame, poll_time: Column | None = None) -> DataFrame:
    """#1 + #4: flatten payload items to v4 price rows.

    Items without an id are dropped; an item is kept only with a positive best
    sell price and a positive best flea buy price.  ``poll_time`` stamps the
    batch (one processing time per poll); default: the current timestamp.
    """
    it = payload
    types = F.coalesce(F.col("types"), F.array().cast("array<string>"))
    name = _or(F.col("name"), "Unknown")
    cat = F.when(F.col("category").isNotNull(), _or(F.col("category.name"), "Unknown")).otherwise(F.lit("Unknown"))
    handbook = F.transform(F.filter(F.coalesce(F.col("handbookCategories"), F.array().cast(T.ArrayType(NAMED))),
                                    lambda h: h["name"].isNotNull() & (h["name"] != "")), lambda h: h["name"])
    flat = it.filter(F.col("id").isNotNull() & (F.col("id") != "")).select(
        F.col("id").alias("item_id"), name.alias("name"),
        F.coalesce(_or(F.col("shortName"), ""), F.lit("")).alias("_short"),
        _or(F.col("iconLink"), "").alias("icon_link"), _or(F.col("wikiLink"), "").alias("wiki_link"),
        _or(F.col("width"), 1).alias("width"), _or(F.col("height"), 1).alias("height"),
        _or(F.col("basePrice"), 0).alias("base_price"), _or(F.col("avg24hPrice"), 0).alias("avg_24h_price"),
        _or(F.col("low24hPrice"), 0).alias("low_24h_price"), _or(F.col("high24hPrice"), 0).alias("high_24h_price"),
        _or(F.col("changeLast48hPercent"), 0.0).alias("change_last_48h"), _or(F.col("weight"), 0.0).alias("weight"),
        _or(F.col("lastOfferCount"), 0).alias("last_offer_count"), _or(F.col("updated"), "").alias("api_updated"),
        cat.alias("category"), handbook.alias("_handbook"),
        F.array_contains(types, "noFlea").cast("int").alias("no_flea"),
        F.array_contains(types, "markedOnly").cast("int").alias("marked_only"),
        best_sell_offer(F.col("sellFor")).alias("_sell"), best_buy_price(F.col("buyFor")).alias("_buy"),
        (poll_time if poll_time is not None else F.localtimestamp()).alias("_poll"))
    flat = flat.filter((F.col("_sell.price") > 0) & F.col("_buy").isNotNull() & (F.col("_buy") > 0))
    avg24 = F.col("avg_24h_price")
    offers = F.greatest(F.col("last_offer_count"), F.lit(0))
    out = flat.select(
        "item_id", "name", F.col("_poll").alias("ts"),
        F.col("_buy").alias("flea_price"), F.col("_sell.price").alias("trader_price"),
        F.col("_sell.source").alias("trader_name"), (F.col("_sell.price") - F.col("_buy")).alias("profit"),
        "icon_link", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"),
        "avg_24h_price", "low_24h_price", "change_last_48h", "weight", "category", "base_price",
        "high_24h_price", F.col("last_offer_count").cast("int").alias("last_offer_count"),
        F.when(F.col("_short") == "", F.col("name")).otherwise(F.col("_short")).alias("short_name"), "wiki_link",
        F.col("_sell.level").cast("int").alias("trader_level_required"),
        F.col("_sell.task").alias("trader_task_unlock"),
        level_requirement_expr("name", "category", handbook="_handbook").alias("flea_level_required"),
        F.when(avg24 > 0, gdiv(avg24 - F.col("_buy"), avg24) * 100).otherwise(F.lit(0.0)).alias("price_velocity"),
        F.when(offers > 0, F.least(offers / 50.0, F.lit(1.0)) * 100).otherwise(F.lit(0.0)).alias("liquidity_score"),
        "api_updated", "no_flea", "marked_only")
    return out


def append_versioned(*frames: DataFrame) -> DataFrame:
    """#6: frames in the v1..v4 layouts → one v4 table, missing columns filled with defaults."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    fills = {}
    for c in V4_COLUMNS:
        if c in LAYOUT_DEFAULTS:
            fills[c] = F.coalesce(F.col(c), F.lit(LAYOUT_DEFAULTS[c]).cast(dict(out.dtypes)[c]))
    out = out.withColumns(fills)
    # reader defaults for columns that came in empty
    out = out.withColumn("short_name", F.coalesce(F.col("short_name"), F.col("name")))
    return out.select(*V4_COLUMNS)


# The accepted forms: extended and basic ISO dates, alone or with a time of day (minutes at least; a fraction only
# after seconds) and an offset.  ISO texts may use any one character between date and time.
_DATE = r"(\d{4})-(\d\d)-(\d\d)"
_TIME = r"(\d\d)(?::(\d\d)(?::(\d\d)(?:[.,](\d+))?)?)?"
_BASIC_DATE = r"(\d{4})(\d\d)(\d\d)"
_BASIC_TIME = r"(\d\d)(?:(\d\d)(?:(\d\d)(?:[.,](\d+))?)?)?"
_USUAL = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d{1,6})?$"
_OFFSET = r"(Z|[+-]\d\d(?::?\d\d(?::?\d\d)?)?)?"


def normalize_timestamps(c) -> Column:
    """#8: text → timestamp.  Null, '' and anything but the accepted forms → null.

    Years or months alone, one-digit parts, zone names and texts with space around them are not accepted.  An offset
    is taken off: the stored timestamps are UTC.
    """
    t = F.col(c) if isinstance(c, str) else c
    # The usual form needs no taking apart; the others are looked at only where it fails.
    return F.when(t.rlike(_USUAL), t.try_cast("timestamp_ntz")).otherwise(_unusual(t))


def _unusual(t: Column) -> Column:
    out = None
    for date, time in ((_DATE, _TIME), (_BASIC_DATE, _BASIC_TIME)):
        form = rf"^(?s:{date}(?:.{time}{_OFFSET})?)$"
        part = lambda i, form=form: F.regexp_extract(t, form, i)
        two = lambda i, part=part: F.when(part(i) == "", F.lit("00")).otherwise(part(i))
        fraction = F.rpad(F.substring(part(7), 1, 6), 6, "0")
        # A date or time that does not exist (month 13, hour 25) does not parse.
        local = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), two(4), F.lit(":"), two(5),
                         F.lit(":"), two(6), F.lit("."), fraction).try_cast("timestamp_ntz")
        digits = F.regexp_replace(part(8), "[^0-9]", "")
        seconds = (F.coalesce(F.substring(digits, 1, 2).try_cast("int"), F.lit(0)) * 3600
                   + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)) * 60
                   + F.coalesce(F.substring(digits, 5, 2).try_cast("int"), F.lit(0)))
        shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.when(part(8).startswith("-"), -seconds).otherwise(seconds))
        hit = F.when(t.rlike(form), local - shift)
        out = hit if out is None else F.coalesce(out, hit)
    return out


def scan_prices(prices: DataFrame) -> DataFrame:
    """#7: the full-table 7-column projection."""
    return prices.select("item_id", "name", "flea_price", "trader_price", "trader_name", "profit", "ts")
