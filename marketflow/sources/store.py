"""The ``prices`` store: Parquet partitioned by day and by the batch that wrote it.

A batch overwrites only its own partitions, so writing it again after a failure leaves the same rows.  Readers
bound the day, so a window reads its days only; retention moves a cut that readers respect and deletes whole days behind it.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ts_literal

KEYS = ("date", "batch")
#: Folder of the retention cuts; readers of the table skip names that begin with an underscore.
_MARKS = "_retention"
_EPOCH = dt.datetime(1970, 1, 1)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders in ``root``: a listing, no scan; empty when there is none."""
    fs, p = _fs(spark, root)
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()) if fs.exists(p) else []


def files(spark: SparkSession, root: str) -> list[str]:
    """Names of the files in ``root``, but for hidden ones."""
    fs, p = _fs(spark, root)
    names = [f.getPath().getName() for f in fs.listStatus(p) if f.isFile()] if fs.exists(p) else []
    return sorted(n for n in names if n[:1] not in "._")


def date_file(spark: SparkSession, path: str, millis: int) -> None:
    """Set a file's modification time, by which file streams order what they read."""
    fs, p = _fs(spark, path)
    fs.setTimes(p, millis, -1)


def complete(spark: SparkSession, path: str) -> bool:
    """Did a write to this folder commit?"""
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def run_id(checkpoint: str) -> str:
    """Names a stream by its checkpoint: batches of another stream never overwrite this one's."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:10]


def write_prices(rows: DataFrame, path: str, batch: str, ts: str = "ts") -> None:
    """Write one batch; the same batch written again replaces itself."""
    (rows.withColumns({"date": F.to_date(ts), "batch": F.lit(batch)}).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path))


def _cut(spark: SparkSession, path: str):
    """The time before which rows have expired, as the newest retention run left it; None before the first."""
    marks = [int(f.split("=")[1]) for f in folders(spark, f"{path}/{_MARKS}") if f.startswith("cut=")]
    return _EPOCH + dt.timedelta(microseconds=max(marks)) if marks else None


def _valid(rows: DataFrame, cut, ts: str) -> DataFrame:
    if cut is None:
        return rows
    c = ts_literal(cut)
    return rows.filter((F.col("date").isNull() | (F.col("date") >= c.cast("date"))) & (F.col(ts).isNull() | (F.col(ts) >= c)))


def read_prices(spark: SparkSession, path: str, since=None, ts: str = "ts") -> DataFrame:
    """Rows of the store that have not expired, from ``since`` (inclusive) on; only the days from then are read."""
    rows = _valid(spark.read.option("basePath", path).parquet(path), _cut(spark, path), ts)
    if since is not None:
        cut = ts_literal(since)
        rows = rows.filter((F.col("date") >= cut.cast("date")) & (F.col(ts) >= cut))
    return rows.drop(*KEYS)


def newest(spark: SparkSession, path: str, ts: str = "ts"):
    """The newest timestamp, read from the last day that has one; None for an empty or missing store."""
    cut = _cut(spark, path)
    for day in reversed([f for f in folders(spark, path) if f.startswith("date=") and "__HIVE" not in f]):
        found = spark.read.parquet(f"{path}/{day}").agg(F.max(ts)).first()[0]
        if found is not None:
            return found if cut is None or found >= cut else None
    return None


def recent(spark: SparkSession, path: str, window: Column, ts: str = "ts") -> DataFrame:
    """Rows from the newest timestamp less ``window`` on; the bound is known before the scan is planned, so days are pruned."""
    top = newest(spark, path, ts)
    rows = read_prices(spark, path)
    if top is None:
        return rows.limit(0)
    cut = spark.range(1).select((ts_literal(top) - window).alias("c")).first()[0]
    return read_prices(spark, path, cut, ts)


def expire(spark: SparkSession, path: str, now, days: int = 7, ts: str = "ts") -> int:
    """Drop rows older than ``now - days``; returns how many.  ``days <= 0`` keeps everything.

    The cut is written down first, as an empty folder whose name is the time: from then on readers leave older rows out.
    Days that lie wholly before the cut of the *last* run are then deleted, so a reader that has begun keeps its
    files until the next run, and a run that fails half-way changes no answer.  Rows without a timestamp stay.
    """
    if days <= 0:
        return 0
    cut = spark.range(1).select((ts_literal(now) - F.make_dt_interval(F.lit(int(days)))).alias("c")).first()[0]
    before = _cut(spark, path)
    if before is not None and cut <= before or not folders(spark, path):
        return 0
    rows = _valid(spark.read.option("basePath", path).parquet(path), before, ts)
    gone = rows.filter((F.col("date") <= ts_literal(cut).cast("date")) & (F.col(ts) < ts_literal(cut))).count()
    fs, p = _fs(spark, f"{path}/{_MARKS}/cut={(cut - _EPOCH) // dt.timedelta(microseconds=1)}")
    fs.mkdirs(p)
    if before is not None:
        edge = f"date={before.date().isoformat()}"
        for day in folders(spark, path):
            if day.startswith("date=") and "__HIVE" not in day and day < edge:
                remove(spark, f"{path}/{day}")
    return gone


class Versions:
    """Versioned tables under a root, one folder per version, named by number, stream and batch.

    A version counts once its write has committed.  A batch that is played again finds its own version and is done;
    a stream with another checkpoint goes on from the newest version.  Older versions are removed, two are kept.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _all(self) -> list[tuple[int, str, int, str]]:
        found = []
        for name in folders(self.spark, self.root):
            parts = name.split("_")
            if len(parts) == 3 and parts[0][:1] == "v" and complete(self.spark, f"{self.root}/{name}"):
                found.append((int(parts[0][1:]), parts[1], int(parts[2]), name))
        return sorted(found)

    def has(self, run: str, batch_id: int) -> bool:
        return any((r, b) == (run, batch_id) for _, r, b, _ in self._all())

    def current(self) -> DataFrame | None:
        found = self._all()
        return self.spark.read.parquet(f"{self.root}/{found[-1][3]}") if found else None

    def write(self, rows: DataFrame, run: str, batch_id: int) -> None:
        found = self._all()
        number = found[-1][0] + 1 if found else 0
        rows.write.mode("overwrite").parquet(f"{self.root}/v{number:08d}_{run}_{batch_id}")
        for _, _, _, name in found[:-1]:
            remove(self.spark, f"{self.root}/{name}")
