"""#11-16: file sinks, export formatting and retention.

Writes go to the shared folder named by ``spark.checkpoint.dir`` (never a
machine-local temp dir); every writer overwrites a whole directory, so a
retried or restarted job converges to the same output.
"""

from __future__ import annotations

import uuid

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ts_literal
from ..session import scratch_path
from . import summary as SM

CURRENCY_CLAMP = 999_999_999_999
EXPORT_COLUMNS = ("name", "profit", "roi", "flea_price", "trader_price", "trader_name", "category",
                  "flea_level_required", "last_offer_count", "no_flea", "marked_only", "rec_score", "rec_tier",
                  "risk_level")


def export_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"exports/{name}-{uuid.uuid4().hex[:12]}")


def write_csv(df: DataFrame, path: str) -> str:
    """#11: header row, no index column, UTF-8."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    """#12: one JSON record per row (JSON Lines)."""
    df.write.mode("overwrite").json(path)
    return path


def records_json(df: DataFrame, out: str = "record") -> DataFrame:
    """#12 string form: each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def lines_csv(df: DataFrame, out: str = "line") -> DataFrame:
    """#12 string form: each row as a CSV line; ``csv_header`` is the line that goes before them."""
    return df.select(F.to_csv(F.struct(*df.columns)).alias(out))


def csv_header(df: DataFrame) -> str:
    return ",".join(f'"{c}"' if set(c) & set(',"\n') else c for c in df.columns)


def keyed_json(df: DataFrame, key: str, out: str = "record") -> DataFrame:
    """#12 keyed by index: each row as ``{key: {column: value, ...}}``, null values included; a null key is "null".

    One object a row, so that a table of any size is written by all tasks; ``{`` and ``}`` aside, the objects joined by
    commas are the document that a single JSON file would hold.
    """
    rest = [c for c in df.columns if c != key]
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    return df.select(F.to_json(F.create_map(text, F.struct(*rest)), {"ignoreNullFields": "false"}).alias(out))


def write_keyed_json(df: DataFrame, key: str, path: str) -> str:
    """#12: the keyed objects, one a line."""
    keyed_json(df, key).write.mode("overwrite").text(path)
    return path


def currency(c) -> Column:
    """'₽1,234': null/NaN/inf → '₽0'; clamped to ±999,999,999,999; truncated toward zero."""
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    clamped = F.least(F.greatest(v, F.lit(-CURRENCY_CLAMP)), F.lit(CURRENCY_CLAMP))
    return F.when(bad, F.lit("₽0")).otherwise(
        F.concat(F.lit("₽"), F.format_number(clamped.cast("bigint"), 0)))   # cast truncates toward 0


@F.pandas_udf(T.StringType())
def _one_decimal(v: pd.Series) -> pd.Series:
    # Correct rounding of the binary value (ties to even), as the exporter's
    # text formatting does; JVM %.1f rounds the shortest decimal text half-up
    # instead (231.25 -> 231.3).  Output-sized export path only.
    return v.map(lambda x: f"{x:.1f}")


def percent(c) -> Column:
    """'12.3%': null/NaN/inf → '0.0%'."""
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, F.lit("0.0%")).otherwise(F.concat(_one_decimal(v), F.lit("%")))


def export_frame(df: DataFrame) -> DataFrame:
    """#15: the recommendation export: known columns only, money and percent as text."""
    cols = [c for c in EXPORT_COLUMNS if c in df.columns]
    fmt = {"profit": currency, "flea_price": currency, "trader_price": currency, "roi": percent}
    return df.select(*[fmt[c](c).alias(c) if c in fmt else F.col(c) for c in cols])


def export_recommendations(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """#15: write the export; unknown formats fall back to CSV unless the frame is empty."""
    out = export_frame(df)
    if fmt == "json":
        return write_json(out, path)
    if fmt != "csv" and out.isEmpty():
        raise ValueError(f"Unsupported format: {fmt}")
    return write_csv(out, path)


def market_snapshot(df: DataFrame, spark: SparkSession, name: str = "market") -> dict:
    """#14: one snapshot → CSV + JSON + summary rows, written side by side from one evaluation of the input."""
    base = export_path(spark, name)
    df = df.checkpoint(eager=True)
    write_csv(df, f"{base}/csv")
    write_json(df, f"{base}/json")
    write_json(SM.market_summary(df), f"{base}/summary")
    return {"csv": f"{base}/csv", "json": f"{base}/json", "summary": f"{base}/summary"}


def retention_filter(prices: DataFrame, now, days: int = 7, ts: str = "ts"):
    """#16: rows older than ``now - days`` (strict) are dropped.

    Returns ``(kept, deleted_count_column_frame)``; ``days <= 0`` keeps
    everything and deletes 0.  On a date-partitioned store the same predicate
    prunes to whole partitions, so the rewrite touches only expiring dates.
    """
    if days <= 0:
        return prices, prices.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("deleted"))
    cut = ts_literal(now) - F.make_dt_interval(F.lit(int(days)))
    old = F.col(ts) < cut
    kept = prices.filter(~old | F.col(ts).isNull())
    deleted = prices.agg(F.count_if(old).alias("deleted"))
    return kept, deleted
