"""Keyed state in hash buckets: a batch reads and writes only the buckets that hold its keys.

A version is one folder, named by number, stream and batch, with a sub-folder for each bucket that the batch touched.
It counts once its write has committed, so a batch that failed half-way leaves nothing behind, and a batch that is
played again finds its own version and is done.  The state is each bucket's newest version.  A bucket keeps one older
version for readers that have begun; bytes written a batch follow the batch's keys, not the state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store as ST

KEPT = 2
_COUNT = "_buckets="


class Buckets:
    """The state under ``root``, one row a ``key``; a state keeps the number of buckets that it began with."""

    def __init__(self, spark: SparkSession, root: str, key: str, n: int = 64):
        self.spark, self.root, self.key = spark, root, key
        begun = [int(f.split("=")[1]) for f in ST.folders(spark, root) if f.startswith(_COUNT)]
        self.n = begun[0] if begun else n

    def _versions(self) -> list[tuple[int, str, int, str]]:
        """Committed versions (number, run, batch, folder), newest first."""
        found = []
        for name in ST.folders(self.spark, self.root):
            parts = name.split("_")
            if len(parts) == 3 and parts[0][:1] == "v" and ST.complete(self.spark, f"{self.root}/{name}"):
                found.append((int(parts[0][1:]), parts[1], int(parts[2]), name))
        return sorted(found, reverse=True)

    def _held(self, version: str) -> list[int]:
        return [int(f.split("=")[1]) for f in ST.folders(self.spark, f"{self.root}/{version}") if f.startswith("bucket=")]

    def has(self, run: str, batch_id: int) -> bool:
        return any((r, b) == (run, batch_id) for _, r, b, _ in self._versions())

    def paths(self, buckets=None) -> list[str]:
        """The folder of each bucket's newest version."""
        newest: dict[int, str] = {}
        for _, _, _, name in self._versions():
            for b in self._held(name):
                newest.setdefault(b, f"{self.root}/{name}/bucket={b}")
        return [p for b, p in sorted(newest.items()) if buckets is None or b in buckets]

    def current(self, buckets=None) -> DataFrame | None:
        """The rows of the state, or of some buckets; None if there are none."""
        paths = self.paths(buckets)
        schema = next((s for s in (self._schema(p) for p in paths) if s is not None), None)
        return None if schema is None else self.spark.read.schema(schema).parquet(*paths)

    def _schema(self, path: str):
        fs, p = ST._fs(self.spark, path)
        return self.spark.read.parquet(path).schema if any(f.getPath().getName().startswith("part-") for f in fs.listStatus(p)) else None

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int"))

    def update(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], run: str, batch_id: int) -> None:
        """``merge(state, batch)`` the rows of a batch, one a key, into the buckets of its keys; once for each batch."""
        if self.has(run, batch_id):
            return
        rows = self._bucketed(batch).checkpoint(eager=True)
        touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}   # no more than there are buckets
        before, now = self.current(touched), rows.drop("bucket")
        self._write(now if before is None else merge(before, now), touched, run, batch_id)

    def rewrite(self, keep: Callable[[DataFrame], DataFrame], gone, run: str, batch_id: int) -> int:
        """Drop the rows where ``gone`` holds (``keep`` filters them out), in the buckets that have any; returns how many."""
        state = self.current()
        if state is None or self.has(run, batch_id):
            return 0
        lost = {r["bucket"]: r["n"] for r in self._bucketed(state.where(gone)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        if lost:
            self._write(keep(self.current(set(lost))), set(lost), run, batch_id)
        return sum(lost.values())

    def _write(self, rows: DataFrame, touched: set[int], run: str, batch_id: int) -> None:
        fs, p = ST._fs(self.spark, f"{self.root}/{_COUNT}{self.n}")
        fs.mkdirs(p)
        versions = self._versions()
        name = f"v{versions[0][0] + 1 if versions else 0:08d}_{run}_{batch_id}"
        path = f"{self.root}/{name}"
        self._bucketed(rows).repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        for b in touched - set(self._held(name)):  # a bucket that lost all its rows is an empty folder
            fs, p = ST._fs(self.spark, f"{path}/bucket={b}")
            fs.mkdirs(p)
        self._clean()

    def _clean(self) -> None:
        seen: dict[int, int] = {}
        for k, (_, _, _, name) in enumerate(self._versions()):
            left = 0
            for b in self._held(name):
                seen[b] = seen.get(b, 0) + 1
                if seen[b] > KEPT:
                    ST.remove(self.spark, f"{self.root}/{name}/bucket={b}")
                else:
                    left += 1
            if not left and k >= KEPT:
                ST.remove(self.spark, f"{self.root}/{name}")
