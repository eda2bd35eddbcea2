"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketflow.session import ensure_checkpoint_dir

#: Words of the contracts: maximal runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder named by ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null ids count as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def popcount(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a)


# --- polynomial hashing of bytes, modulo 2**64 ------------------------------------------------
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


class Powers:
    """Growing tables of the base's powers and of their inverses, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            both = []
            for base in (_BASE, _INVERSE):
                a = np.full(m, base, np.uint64)
                a[0] = 1
                both.append(np.multiply.accumulate(a))
            self.up, self.down = both
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit (the low bits of a polynomial hash are weak)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of any substring of a byte buffer in constant time, vectorised."""

    def __init__(self, buf: np.ndarray):
        up, self.down = POWERS.get(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def fixed(self, width: int) -> np.ndarray:
        """Hash of every substring of ``width`` bytes."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix64((self.sums[width:] - self.sums[:n]) * self.down[:n] + np.uint64(width))
