"""Thresholds and defaults.

Fixed values: these must equal the behaviour being reproduced, so they are kept
together here as plain data, in their natural order.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
COLLECTION_INTERVAL_MINUTES = 5
LOOKBACK_WINDOW_MINUTES = 45
MAX_LIQUIDITY_SCORE = 100
ANOMALY_CONTAMINATION = 0.05
FOREST_TREES = 100
MIN_ITEMS_FOR_ANALYSIS = 10
MIN_ITEMS_FOR_ANOMALY = 20
TREND_MIN_DATA_POINTS = 6
TREND_IMPROVEMENT_THRESHOLD = 0.05
VOLUME_MIN_FOR_RECOMMENDATION = 5
VOLUME_LOW = 10
VOLUME_MEDIUM = 50
VOLUME_HIGH = 100
FLEA_MARKET_UNLOCK_LEVEL = 15
ALERT_DEFAULT_COOLDOWN_MINUTES = 30
ALERT_HIGH_PROFIT_THRESHOLD = 10000
ALERT_HIGH_ROI_THRESHOLD = 50.0
ALERT_MAX_HISTORY = 500
MIN_OFFERS_FOR_RELIABLE = 5
HEALTH_STALE_HOURS = 2
FEE_LEVEL_DISCOUNT = (1.0, 0.95, 0.9, 0.85)   # intel-center level 0..3
FEE_RATE = 0.05
FEE_EXPONENT_BASE = 4.0
FEE_MAX_RATIO_EXPONENT = 10
FEE_CAP = 2_000_000_000
TRAINING_SESSION_CAP = 1000
DAILY_SUMMARY_CAP = 90
CALIBRATION_ALPHA = 0.1

# Volume tiers: right-closed upper bounds, first bin left-open at -1.
VOLUME_TIERS = ((5, "Unreliable"), (10, "Very Low"), (50, "Low"), (100, "Medium"),
                (200, "High"), (float("inf"), "Very High"))
# Risk and recommendation tiers: (lower, upper] bounds.
RISK_LEVELS = ((0, 30, "Low"), (30, 60, "Medium"), (60, 100, "High"))
REC_TIERS = ((0, 45, "Consider"), (45, 65, "Good"), (65, 80, "Great"), (80, 100, "Excellent"))
TREND_ICONS = {"Improving": "📈", "Declining": "📉", "Stable": "➡️", "Unknown": "❓"}
# Base feature weights of the learned opportunity score, in order.
OPPORTUNITY_WEIGHTS = (
    ("profit", 0.20), ("capital_efficiency", 0.15), ("profit_per_slot", 0.10),
    ("profit_density", 0.08), ("liquidity_score", 0.15), ("volume_adjusted_profit", 0.10),
    ("profit_per_offer", 0.05), ("buy_feasibility", 0.05), ("price_position", 0.04),
    ("momentum", 0.03), ("trader_accessibility", 0.03), ("market_saturation", 0.02),
)
OPPORTUNITY_INVERTED = ("price_position", "market_saturation")
RISK_TOLERANCE = {"low": 40, "medium": 70, "high": 100}
ANOMALY_FEATURES_CORE = ("profit", "capital_efficiency", "profit_per_slot")
ANOMALY_FEATURES_EXTRA = ("log_offers", "volume_adjusted_profit", "flea_premium", "price_position")
CLUSTER_FEATURES_CORE = ("profit", "capital_efficiency", "profit_per_slot")
CLUSTER_FEATURES_EXTRA = ("liquidity_score", "log_offers", "volume_adjusted_profit", "momentum",
                          "price_spread_pct")
SIMILARITY_FEATURES = ("profit", "capital_efficiency", "profit_per_slot", "slots", "weight")
CLUSTER_LABELS = {1: "🥇 Elite Opportunities", 2: "🥈 High Value", 3: "🥉 Solid Picks"}
CLUSTER_LABEL_NEGATIVE = "⚠️ Avoid (Negative)"
CLUSTER_LABEL_DEFAULT = "📊 Standard"

# The alert rules of a first start: (id, threshold, priority, message); the types are those of operators.alerts.
DEFAULT_ALERTS = (
    ("high_profit_auto", "profit_threshold", ALERT_HIGH_PROFIT_THRESHOLD, "high", "Item has very high profit potential"),
    ("high_roi_auto", "high_roi", ALERT_HIGH_ROI_THRESHOLD, "medium", "Item has exceptional ROI"),
    ("arbitrage_auto", "arbitrage_opportunity", 0, "critical", "Unusual arbitrage opportunity detected"),
)
# Level rules over the test-data vocabulary (kind, pattern, level), in priority order.
DEFAULT_LEVEL_RULES = (
    ("item", "hot plate", 35),
    ("item", "widget", 40),
    ("item", "rod", 30),
    ("category", "PROMO", 25),
    ("category", "economy", 20),
    ("category", "LARGES", 30),
)
# Word-boundary characters around short item patterns.
BOUNDARY_CLASS = r"[\s\-_.,()\[\]]"
# ---------------------------------------------------------------------------
