"""Registered queries: Spark plan + DuckDB oracle SQL per key.

Each query reads the shared test tables (whole tables, no subsets) and returns
a DataFrame.  Floating columns are rounded to 6 digits on both sides so the
oracle comparison is not sensitive to summation order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Query:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: tuple = field(default_factory=tuple)
    digits: int = 6
    wide: bool = False
    placed: bool = False


REGISTRY: dict[str, Query] = {}
DIGITS = 6


def register(name: str, sql: str | None = None, doubles=(), digits: int = DIGITS, wide: bool = False, placed: bool = False):
    """``wide``: all features of every row, ``placed``: a join where the rows lie; for both the session is prepared.  ``digits``: comparison precision of double columns (coarser where the
    Spark side sums in a different order, e.g. state merged across micro-batches)."""
    def deco(fn):
        REGISTRY[name] = Query(fn, sql, tuple(doubles), digits, wide, placed)
        return fn
    return deco


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    q = REGISTRY[name]
    df = q.fn(spark, sf_dir)
    dbl = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: round_binary(F.col(c), q.digits) for c in dbl}) if dbl else df


def round_binary(c, digits: int):
    """Round the way the oracle engine rounds doubles: scale, round half away, unscale.

    ``F.round`` rounds the shortest decimal text of the double, which differs on
    values such as 2.0578125 whose scaled binary value is just below the tie.
    ``F.round`` of doubles also goes by way of decimal text, which takes longer than the columns it rounds, so the
    value is rounded half to even and ties are set right: ``F.round(c * scale, 0)`` bit for bit, with no negative zero.
    """
    scale = float(10 ** digits)
    x = c * scale
    even = F.rint(x)
    away = F.when((x > 0) & (x - even == 0.5), 1.0).when((x < 0) & (x - even == -0.5), -1.0).otherwise(0.0)
    return (even + away) / scale


def oracle(name: str) -> str | None:
    q = REGISTRY[name]
    if q.sql is None:
        return None
    if not q.doubles:
        return q.sql
    repl = ", ".join(f"ROUND(CAST({c} AS DOUBLE), {q.digits}) AS {c}" for c in q.doubles)
    return f"SELECT * REPLACE ({repl}) FROM (\n{q.sql}\n) q"
