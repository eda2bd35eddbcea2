"""Column-expression helpers (all JVM-side, codegen friendly)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import settings as S


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def gdiv(num, den, default=0.0) -> Column:
    """Guarded ratio: ``num/den`` when den != 0 (and not null) else ``default``.

    ANSI mode raises on x/0, so the guard must be in the expression itself.
    """
    n, d = col(num), col(den)
    return F.when(d.isNotNull() & (d != 0), n.cast("double") / d).otherwise(F.lit(default).cast("double"))


def clip(c, lo=None, hi=None) -> Column:
    c = col(c)
    if lo is not None:
        c = F.greatest(c, F.lit(lo))
    if hi is not None:
        c = F.least(c, F.lit(hi))
    return c


def finite_or(c, default=0.0) -> Column:
    """NaN / +-inf / null -> default."""
    c = col(c).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(default)).otherwise(c)


def icontains_regex(c, pattern: str | None, literal: bool = False) -> Column:
    """Case-insensitive regex containment; null -> false (pandas ``str.contains(case=False, na=False)``)."""
    if pattern is None or pattern == "":
        return F.lit(True)
    pat = r"\Q" + pattern + r"\E" if literal else pattern
    return F.coalesce(col(c).rlike("(?i)" + pat), F.lit(False))


def volume_tier(offers) -> Column:
    o = col(offers)
    expr = None
    for upper, label in S.VOLUME_TIERS:
        cond = o <= F.lit(upper) if upper != float("inf") else o.isNotNull()
        expr = F.when(cond & (o > -1), label) if expr is None else expr.when(cond & (o > -1), label)
    return expr


def interval_label(c, bounds) -> Column:
    """Right-closed (lo, hi] bins; outside all bins -> null (``pd.cut`` semantics)."""
    v = col(c)
    expr = None
    for lo, hi, label in bounds:
        cond = (v > lo) & (v <= hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def risk_level(c) -> Column:
    return interval_label(c, S.RISK_LEVELS)


def rec_tier(c) -> Column:
    return interval_label(c, S.REC_TIERS)


def trend_direction(c) -> Column:
    v = col(c).cast("double")
    t = S.TREND_IMPROVEMENT_THRESHOLD
    return (F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "Unknown")
            .when(v > t, "Improving").when(v < -t, "Declining").otherwise("Stable"))


def trend_indicator(direction) -> Column:
    d = col(direction)
    expr = None
    for k, icon in S.TREND_ICONS.items():
        expr = F.when(d == k, icon) if expr is None else expr.when(d == k, icon)
    return expr.otherwise(S.TREND_ICONS["Unknown"])


def learned_trend_icon(adjustment, points) -> Column:
    a, p = col(adjustment), col(points)
    return (F.when(a > 5, "📈").when(a < -5, "📉").when(p >= 6, "➡️").otherwise("🆕"))


def liquidity_tier(offers) -> Column:
    o = col(offers)
    return F.when(o >= 50, "High").when(o >= 10, "Medium").otherwise("Low")


def ts_literal(now) -> Column:
    """A ``timestamp_ntz`` literal from a datetime or ISO text; a Column passes through.

    A Python datetime given to ``F.lit`` would go through the driver's time zone; its ISO text does
    not.  Aware datetimes are taken to UTC, the zone of the stored timestamps.
    """
    if isinstance(now, Column):
        return now
    if isinstance(now, dt.datetime):
        if now.tzinfo is not None:
            now = now.astimezone(dt.timezone.utc).replace(tzinfo=None)
        now = now.isoformat(sep=" ")
    return F.lit(now).cast("timestamp_ntz")


def utc_now() -> dt.datetime:
    """The current time in UTC, naive like the stored timestamps."""
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
