"""#36-42, #66: filters, point lookups and top-k views over a market snapshot.

Every filter is one composed ``Column`` predicate, so it lands in a single
Filter node that Catalyst pushes toward the scan.  Top-k is ``orderBy`` +
``limit`` (TakeOrderedAndProject: per-partition heaps, no full sort/shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.columns import icontains_regex


# Unique per price row: the natural tie-break of every ordered view.
ROW_KEY = ("item_id", "ts", "l_orderkey", "l_linenumber", "l_suppkey")


def total_order(df: DataFrame, keys) -> list[Column]:
    """Sort keys followed by a tie-break: a deterministic total order.

    ``keys`` items are column names (ascending) or (name, descending) pairs.
    The tie-break is the row key when present, else every other column.
    Nulls sort last in both directions.
    """
    out, used = [], set()
    for k in keys:
        name, desc = (k, False) if isinstance(k, str) else k
        out.append(F.col(name).desc_nulls_last() if desc else F.col(name).asc_nulls_last())
        used.add(name)
    rest = ROW_KEY if all(c in df.columns for c in ROW_KEY) else sorted(df.columns)
    for c in rest:
        if c not in used:
            out.append(F.col(c).asc_nulls_last())
    return out


def top_k(df: DataFrame, keys, k: int) -> DataFrame:
    return df.orderBy(*total_order(df, keys)).limit(int(k))


def market_predicate(min_profit=0, min_roi=0, min_offers=S.MIN_OFFERS_FOR_RELIABLE,
                     min_profit_per_slot=0, search=None, category="All",
                     max_trader_level=None, player_level=None, hide_no_flea=True,
                     hide_marked_only=False, show_negative=False, literal=False) -> Column:
    """#36 predicate (all conditions AND-ed)."""
    p = ((F.col("profit") >= min_profit) & (F.col("roi") >= min_roi)
         & (F.col("last_offer_count") >= min_offers)
         & (F.col("profit_per_slot") >= min_profit_per_slot))
    if search:
        p = p & icontains_regex("name", search, literal)
    if category != "All":
        p = p & (F.col("category") == category)
    if max_trader_level is not None:
        p = p & (F.col("trader_level_required") <= max_trader_level)
    if player_level is not None:
        p = p & (F.col("flea_level_required") <= player_level)
    if hide_no_flea:
        p = p & (F.col("no_flea") == 0)
    if hide_marked_only:
        p = p & (F.col("marked_only") == 0)
    if not show_negative:
        p = p & (F.col("profit") > 0)
    return p


def filter_market(df: DataFrame, **filters) -> DataFrame:
    """#36: dashboard filter set; absent optional columns get neutral defaults."""
    fills = {"profit_per_slot": F.lit(0), "flea_level_required": F.lit(S.FLEA_MARKET_UNLOCK_LEVEL),
             "no_flea": F.lit(0), "marked_only": F.lit(0), "last_offer_count": F.lit(0),
             "roi": F.lit(0), "name": F.lit(""), "category": F.lit("")}
    missing = {c: v for c, v in fills.items() if c not in df.columns}
    if missing:
        df = df.withColumns(missing)
    if "trader_level_required" not in df.columns:
        filters["max_trader_level"] = None
    return df.filter(market_predicate(**filters))


EXPLORE_SORTS = {
    "profit_desc": ("profit", True), "profit_asc": ("profit", False),
    "roi_desc": ("roi", True), "flea_desc": ("flea_price", True),
    "flea_asc": ("flea_price", False), "name_asc": ("name", False),
    "offers_desc": ("last_offer_count", True),
}
EXPLORE_COLUMNS = ("icon_link", "name", "profit", "roi", "flea_price", "trader_price",
                   "trader_name", "trader_level_required", "flea_level_required", "category",
                   "avg_24h_price", "low_24h_price", "high_24h_price", "change_last_48h",
                   "last_offer_count", "weight", "no_flea", "marked_only")


def explore_market(df: DataFrame, search=None, category=None, trader=None, min_flea=0,
                   max_flea=None, min_profit=None, show_all_profits=False,
                   sort="profit_desc", order=False) -> DataFrame:
    """#37: explorer filters, one of 7 sort orders, 18-column projection."""
    p = F.lit(True)
    if search:
        p = p & icontains_regex("name", search)
    if category:
        p = p & (F.col("category") == category)
    if trader:
        p = p & (F.col("trader_name") == trader)
    p = p & (F.col("flea_price") >= min_flea)
    if max_flea is not None:
        p = p & (F.col("flea_price") <= max_flea)
    if min_profit is not None:
        p = p & (F.col("profit") >= min_profit)
    if not show_all_profits:
        p = p & (F.col("profit") > 0)
    out = df.filter(p).select(*[c for c in EXPLORE_COLUMNS if c in df.columns])
    if order:
        out = out.orderBy(*total_order(out, [EXPLORE_SORTS[sort]]))
    return out


def items_page(df: DataFrame, limit: int = 100, offset: int = 0, category=None, trader=None,
               min_profit=None, max_profit=None, min_roi=None, search=None,
               sort_by="profit", sort_desc=True, max_limit: int | None = 1000) -> DataFrame:
    """#38: API item listing: filters, sort, offset + limit.

    A page holds ``max_limit`` rows at most; None takes any limit, and ``limit=None`` then gives all rows.
    """
    p = F.lit(True)
    if category:
        p = p & (F.col("category") == category)
    if trader:
        p = p & (F.col("trader_name") == trader)
    if min_profit is not None:
        p = p & (F.col("profit") >= min_profit)
    if max_profit is not None:
        p = p & (F.col("profit") <= max_profit)
    if min_roi is not None and "roi" in df.columns:
        p = p & (F.col("roi") >= min_roi)
    if search:
        p = p & icontains_regex("name", search)
    out = df.filter(p)
    keys = [(sort_by, sort_desc)] if sort_by in df.columns else []
    out = out.orderBy(*total_order(out, keys))
    out = out.offset(int(offset))
    most = [int(x) for x in (limit, max_limit) if x is not None]
    return out.limit(min(most)) if most else out


def item_by_id(df: DataFrame, ids) -> DataFrame:
    """#39 (batch form): first matching row per requested id (deterministic first)."""
    ids_df = ids if isinstance(ids, DataFrame) else \
        df.sparkSession.createDataFrame([(str(i),) for i in ids], "item_id string")
    hits = df.join(ids_df.select(F.col(ids_df.columns[0]).alias("item_id")).distinct(),
                   "item_id", "left_semi")
    return _first_per(hits, "item_id")


def item_by_name(df: DataFrame, names) -> DataFrame:
    """#39: case-insensitive exact name lookup, first match per name."""
    names_df = names if isinstance(names, DataFrame) else \
        df.sparkSession.createDataFrame([(str(n),) for n in names], "q string")
    q = names_df.select(F.lower(F.col(names_df.columns[0])).alias("_q")).distinct()
    hits = df.join(q, F.lower(F.col("name")) == F.col("_q"), "inner")
    return _first_per(hits, "_q").drop("_q")


def _first_per(df: DataFrame, key: str) -> DataFrame:
    """One row per key: the smallest row under the frame's order (profit desc, then all columns)."""
    others = [c for c in df.columns if c != key]
    ties = ROW_KEY if all(c in df.columns for c in ROW_KEY) else sorted(others)
    lead = [F.negative(F.col("profit")).alias("_p")] if "profit" in df.columns else []
    order = F.struct(*lead, *[F.col(c) for c in ties])
    best = df.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in others]), order).alias("_r"))
    return best.select(key, "_r.*").select(*df.columns)


def profitable_items(df: DataFrame, min_profit=0, min_roi=0.0, min_offers=S.MIN_OFFERS_FOR_RELIABLE,
                     limit: int = 50, player_level=None) -> DataFrame:
    """#40: filters then top-``limit`` by profit."""
    p = F.col("profit") >= min_profit
    if "roi" in df.columns:
        p = p & (F.col("roi") >= min_roi)
    if "last_offer_count" in df.columns:
        p = p & (F.col("last_offer_count") >= min_offers)
    if player_level is not None and "flea_level_required" in df.columns:
        p = p & (F.col("flea_level_required") <= player_level)
    return top_k(df.filter(p), [("profit", True)], limit)


def search_items(df: DataFrame, query: str, limit: int = 20, literal: bool = False) -> DataFrame:
    """#41: regex name search (case-insensitive), top-``limit`` by profit."""
    return top_k(df.filter(icontains_regex("name", query, literal)), [("profit", True)], limit)


def reliable_volume(df: DataFrame, min_offers: int = S.MIN_OFFERS_FOR_RELIABLE) -> DataFrame:
    """#42: rows with enough offers to trust the price."""
    return df.filter(F.col("last_offer_count") >= min_offers)


def gainers_losers(df: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """#66: top movers by 48 h change (change != 0 and not null)."""
    moved = df.filter(F.col("change_last_48h").isNotNull() & (F.col("change_last_48h") != 0))
    return (top_k(moved, [("change_last_48h", True)], n),
            top_k(moved, [("change_last_48h", False)], n))


def best_per_kg(df: DataFrame, n: int = 20) -> DataFrame:
    """#66: top ``n`` by profit per kg among items with weight."""
    return top_k(df.filter(F.col("weight") > 0), [("profit_per_kg", True)], n)
