"""DuckDB SQL building blocks for the correctness oracle.

Written independently of the Spark code: plain SQL over the registered test
views.  Each query in ``registry`` composes these CTEs.
"""

from __future__ import annotations

NOW = "2024-01-10 00:00:00"

BOUND = r"[\s\-_.,()\[\]]"

PRICES = f"""
prices_raw AS (
  SELECT
    CAST(l_partkey AS VARCHAR) AS item_id,
    p_name AS name,
    split_part(p_name, ' ', 1) AS short_name,
    p_type AS category,
    CASE WHEN l_suppkey % 29 = 0 THEN NULL ELSE CONCAT('T', CAST(l_suppkey % 8 AS VARCHAR)) END AS trader_name,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(5 * date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) AS BIGINT)) AS ts,
    CAST(FLOOR(p_retailprice * 2) AS BIGINT) AS flea_price,
    CAST(FLOOR(l_extendedprice / l_quantity) AS BIGINT) AS trader_price,
    CAST(FLOOR(l_extendedprice / l_quantity) AS BIGINT) - CAST(FLOOR(p_retailprice * 2) AS BIGINT) AS profit,
    CAST(CASE WHEN l_partkey % 50 = 0 THEN 0
         ELSE CAST(FLOOR(p_retailprice * 2) AS BIGINT) + l_orderkey % 401 - 100 END AS BIGINT) AS avg_24h_price,
    CAST(CAST(FLOOR(p_retailprice * 2) AS BIGINT) - CASE WHEN l_partkey % 40 = 0 THEN 0 ELSE l_orderkey % 300 END AS BIGINT) AS low_24h_price,
    CAST(CAST(FLOOR(p_retailprice * 2) AS BIGINT) + CASE WHEN l_partkey % 40 = 0 THEN 0 ELSE (l_suppkey * 7) % 350 END AS BIGINT) AS high_24h_price,
    CAST(CASE WHEN l_partkey % 33 = 0 THEN 0 ELSE FLOOR(p_retailprice) END AS BIGINT) AS base_price,
    CAST(l_orderkey % 81 - 40 AS DOUBLE) / 2 AS change_last_48h,
    CAST(p_size % 4 AS INTEGER) AS width,
    CAST(1 + p_size % 3 AS INTEGER) AS height,
    CAST(p_size % 10 AS DOUBLE) / 4 AS weight,
    CAST((l_quantity - 1) * 5 AS INTEGER) AS last_offer_count,
    CAST(1 + l_linenumber % 4 AS INTEGER) AS trader_level_required,
    CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS no_flea,
    CAST(CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN 1 ELSE 0 END AS INTEGER) AS marked_only,
    l_orderkey, l_linenumber, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
prices AS (
  SELECT *,
    CASE WHEN avg_24h_price > 0 THEN (avg_24h_price - flea_price) / avg_24h_price * 100 ELSE 0.0 END AS price_velocity,
    LEAST(GREATEST(last_offer_count, 0) / 50.0, 1.0) * 100 AS liquidity_score,
    CAST(CASE
      WHEN lower(coalesce(name, '')) = 'hot plate' OR contains(lower(coalesce(name, '')), 'hot plate') THEN 35
      WHEN lower(coalesce(name, '')) = 'widget' OR contains(lower(coalesce(name, '')), 'widget') THEN 40
      WHEN lower(coalesce(name, '')) = 'rod'
        OR regexp_matches(lower(coalesce(name, '')), '(?:^|{BOUND})rod(?:$|{BOUND})') THEN 30
      WHEN coalesce(category, '') = 'PROMO' THEN 25
      WHEN coalesce(category, '') = 'economy' THEN 20
      WHEN coalesce(category, '') = 'LARGES' THEN 30
      WHEN lower(coalesce(category, '')) = 'promo' THEN 25
      WHEN lower(coalesce(category, '')) = 'economy' THEN 20
      WHEN lower(coalesce(category, '')) = 'larges' THEN 30
      WHEN (rtrim(lower(coalesce(category, '')), 's') = 'promo' OR rtrim(lower(coalesce(category, '')), 'es') = 'promo')
        AND NOT starts_with(lower(coalesce(category, '')), 'promo ')
        AND NOT (length(lower(coalesce(category, ''))) < 5 AND starts_with('promo', lower(coalesce(category, '')) || ' ')) THEN 25
      WHEN (rtrim(lower(coalesce(category, '')), 's') = 'economy' OR rtrim(lower(coalesce(category, '')), 'es') = 'economy')
        AND NOT starts_with(lower(coalesce(category, '')), 'economy ')
        AND NOT (length(lower(coalesce(category, ''))) < 7 AND starts_with('economy', lower(coalesce(category, '')) || ' ')) THEN 20
      WHEN (rtrim(lower(coalesce(category, '')), 's') = 'large' OR rtrim(lower(coalesce(category, '')), 'es') = 'larg')
        AND NOT starts_with(lower(coalesce(category, '')), 'larges ')
        AND NOT (length(lower(coalesce(category, ''))) < 6 AND starts_with('larges', lower(coalesce(category, '')) || ' ')) THEN 30
      ELSE 15 END AS INTEGER) AS flea_level_required
  FROM prices_raw
)"""

ANCHOR = "(SELECT MAX(ts) FROM prices)"

LATEST = f"""
recent AS (SELECT * FROM prices WHERE ts >= {ANCHOR} - INTERVAL 45 MINUTE),
latest AS (
  SELECT r.* FROM recent r
  JOIN (SELECT item_id, MAX(ts) AS max_ts FROM recent GROUP BY item_id) m
    ON r.item_id = m.item_id AND r.ts = m.max_ts
)"""

# #30 trade metrics over the latest snapshot.
METRICS = """
metrics AS (
  SELECT *,
    CASE WHEN flea_price <> 0 THEN profit / flea_price * 100 ELSE 0.0 END AS roi,
    width * height AS slots,
    CASE WHEN width * height <> 0 THEN profit / (width * height) ELSE 0.0 END AS profit_per_slot,
    avg_24h_price - flea_price AS discount_from_avg,
    CASE WHEN avg_24h_price <> 0 THEN (avg_24h_price - flea_price) / avg_24h_price * 100 ELSE 0.0 END AS discount_percent,
    CASE WHEN weight <> 0 THEN profit / weight ELSE 0.0 END AS profit_per_kg,
    CASE WHEN base_price <> 0 THEN flea_price / base_price ELSE 0.0 END AS flea_to_base_ratio,
    high_24h_price - low_24h_price AS price_range_24h,
    CASE WHEN avg_24h_price <> 0 THEN (high_24h_price - low_24h_price) / avg_24h_price * 100 ELSE 0.0 END AS price_range_percent,
    CASE WHEN last_offer_count >= 50 THEN 'High' WHEN last_offer_count >= 10 THEN 'Medium' ELSE 'Low' END AS liquidity_tier
  FROM latest
)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


def metrics_cte(src: str, name: str) -> str:
    """#30 over an arbitrary source CTE."""
    return METRICS.replace("metrics AS (", f"{name} AS (", 1).replace("FROM latest", f"FROM {src}")


PMETRICS = metrics_cte("prices", "pmetrics")

# #32-34 features over a metrics-shaped source.
_O = "COALESCE(last_offer_count, 0)"


def features_cte(src: str, name: str = "features") -> str:
    return f"""
{name}_a AS (
  SELECT * REPLACE (
      width * height AS slots,
      CASE WHEN width * height > 0 THEN profit / (width * height) ELSE 0.0 END AS profit_per_slot,
      COALESCE(base_price, 0) AS base_price,
      COALESCE(trader_level_required, 1) AS trader_level_required,
      {_O} AS last_offer_count,
      CASE WHEN {_O} < 5 THEN CAST({_O} * 2 AS DOUBLE) ELSE LEAST({_O} / 50 * 100, 100.0) END AS liquidity_score),
    CASE WHEN trader_price > 0 THEN profit / trader_price * 100 ELSE 0.0 END AS profit_margin,
    CASE WHEN flea_price > 0 THEN profit / flea_price ELSE 0.0 END AS capital_efficiency,
    CASE WHEN width * height > 0 THEN weight / (width * height) ELSE 0.0 END AS density,
    CASE WHEN width * height * weight > 0 THEN profit / (width * height * GREATEST(weight, 0.1))
         WHEN width * height > 0 THEN profit / (width * height) ELSE 0.0 END AS profit_density,
    high_24h_price - low_24h_price AS price_spread,
    CASE WHEN avg_24h_price > 0 THEN (high_24h_price - low_24h_price) / avg_24h_price * 100 ELSE 0.0 END AS price_spread_pct,
    CASE WHEN high_24h_price - low_24h_price > 0
         THEN (flea_price - low_24h_price) / (high_24h_price - low_24h_price) ELSE 0.5 END AS price_position,
    COALESCE(change_last_48h, 0.0) AS momentum,
    abs(COALESCE(change_last_48h, 0.0)) AS momentum_abs,
    CAST(COALESCE(change_last_48h, 0.0) < -5 AS INTEGER) AS is_declining,
    CAST(COALESCE(change_last_48h, 0.0) > 5 AS INTEGER) AS is_rising,
    CASE WHEN COALESCE(base_price, 0) > 0 THEN (flea_price - base_price) / base_price * 100 ELSE 0.0 END AS flea_premium,
    CASE WHEN COALESCE(base_price, 0) > 0 THEN (trader_price - base_price) / base_price * 100 ELSE 0.0 END AS trader_premium,
    5 - COALESCE(trader_level_required, 1) AS trader_accessibility,
    ln(1 + {_O}) AS log_offers,
    CASE WHEN {_O} <= 5 THEN 'Unreliable' WHEN {_O} <= 10 THEN 'Very Low' WHEN {_O} <= 50 THEN 'Low'
         WHEN {_O} <= 100 THEN 'Medium' WHEN {_O} <= 200 THEN 'High' ELSE 'Very High' END AS volume_tier,
    {_O} >= 5 AS volume_reliable,
    CASE WHEN {_O} > 100 THEN 1.0 ELSE {_O} / 100 END AS market_saturation,
    profit * CASE WHEN {_O} < 5 THEN 0.1 ELSE LEAST(GREATEST({_O} / 50, 0.2), 2.0) END AS volume_adjusted_profit,
    CASE WHEN {_O} > 0 THEN profit / ln(1 + {_O}) ELSE CAST(profit AS DOUBLE) END AS profit_per_offer
  FROM {src}
),
{name} AS (
  SELECT *,
    CASE WHEN last_offer_count < 5 THEN 10.0
         ELSE liquidity_score * 0.6 + (1 - price_position) * 100 * 0.4 END AS buy_feasibility,
    CASE WHEN category IS NULL THEN 0.0 ELSE AVG(profit) OVER (PARTITION BY category) END AS category_avg_profit
  FROM {name}_a
)"""


# #62 feature list and base weights (all optional features are present in testdata).
ML_FEATURES = (("profit", .20), ("capital_efficiency", .15), ("profit_per_slot", .10),
               ("profit_density", .08), ("liquidity_score", .15), ("volume_adjusted_profit", .10),
               ("profit_per_offer", .05), ("buy_feasibility", .05), ("price_position", .04),
               ("momentum", .03), ("trader_accessibility", .03), ("market_saturation", .02))
INVERTED = ("price_position", "market_saturation")


def ml_score_cte(src: str, name: str = "scored") -> str:
    """#62 + #63 average ranks."""
    stats = ", ".join(
        f"MIN(CAST({f} AS DOUBLE)) AS mn_{f}, MAX(CAST({f} AS DOUBLE)) AS mx_{f}, "
        f"STDDEV_SAMP(CAST({f} AS DOUBLE)) AS sd_{f}" for f, _ in ML_FEATURES)
    raw = ", ".join(
        f"{w} / (CASE WHEN sd_{f} IS NULL OR sd_{f} = 0 OR isnan(sd_{f}) THEN 0.01 ELSE sd_{f} END + 0.01) AS w_{f}"
        for f, w in ML_FEATURES)
    wsum = " + ".join(f"w_{f}" for f, _ in ML_FEATURES)
    terms = []
    for f, _ in ML_FEATURES:
        x = f"COALESCE(CAST(s.{f} AS DOUBLE), 0.0)"
        sc = f"CASE WHEN mx_{f} > mn_{f} THEN ({x} - mn_{f}) / (mx_{f} - mn_{f}) ELSE 0.0 END"
        if f in INVERTED:
            sc = f"(1 - {sc})"
        terms.append(f"{sc} * (w_{f} / wsum)")
    score = " + ".join(terms)
    return f"""
{name}_st AS (SELECT COUNT(*) AS n_rows, {stats} FROM {src}),
{name}_w AS (SELECT *, {raw} FROM {name}_st),
{name}_ws AS (SELECT *, {wsum} AS wsum FROM {name}_w),
{name}_a AS (
  SELECT s.*, CASE WHEN n_rows >= 10 THEN LEAST(GREATEST(({score}) * 100, 0.0), 100.0) END AS ml_opportunity_score
  FROM {src} s, {name}_ws
),
{name} AS (
  SELECT *,
    CAST(rank() OVER (ORDER BY ml_opportunity_score DESC NULLS LAST) AS DOUBLE)
      + (COUNT(*) OVER (PARTITION BY ml_opportunity_score) - 1) / 2.0 AS opportunity_rank,
    (rank() OVER (ORDER BY ml_opportunity_score ASC) + (COUNT(*) OVER (PARTITION BY ml_opportunity_score) - 1) / 2.0)
      / COUNT(ml_opportunity_score) OVER () * 100 AS opportunity_percentile
  FROM {name}_a
)"""
