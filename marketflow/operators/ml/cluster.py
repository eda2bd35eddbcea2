"""#80-82 trading-strategy clusters: k-means with restarts, all of them in the same passes.

Features are standardised with the population std (a constant column → 0), as
the reference's scaler does.  With n ≥ 20 rows, k is scanned over
2..min(8, n//3)−1 and the k after the largest inertia drop is kept (capped at
``max_k``); every k is fitted from ``n_init`` k-means++ starts and the start with
the least inertia counts.  All (k, start) fits advance together: one pass over
the points gives each fit its next seed or its next sums, so the number of jobs
is the number of iterations, not of restarts.  A pass returns one row per fit
and cluster to the driver.  Confidence is 1/(1 + distance to the own centre).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ... import settings as S

_CHUNK = 4096


def cluster_features(df: DataFrame):
    return list(S.CLUSTER_FEATURES_CORE) + [f for f in S.CLUSTER_FEATURES_EXTRA if f in df.columns]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of points to centres, summed feature by feature: no array of rows by centres by features."""
    d = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        d += (x[:, j, None] - centres[None, :, j]) ** 2
    return d


def _pass(points: DataFrame, fits: dict[int, np.ndarray], draw: int | None) -> DataFrame:
    """One pass for all fits, whose centres stand in one array: a chunk of points meets all of them at once.

    ``draw`` None: per fit and cluster the sum of its points, their number and inertia.  Otherwise per fit the point
    with the least exponential draw weighted by its squared distance to the centres so far (k-means++).
    """
    every = np.concatenate(list(fits.values()))
    ends = np.cumsum([len(c) for c in fits.values()])
    span = {fit: (int(end) - len(c), int(end)) for (fit, c), end in zip(fits.items(), ends)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        best: dict[int, tuple] = {}
        for b in batches:
            if not b.num_rows:
                continue
            whole = b.column("z").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            every_key = b.column("key").to_numpy().astype(np.uint64)
            for at in range(0, len(whole), _CHUNK):
                x, keys = whole[at:at + _CHUNK], every_key[at:at + _CHUNK]
                all_far = _distances(x, every)
                for fit, (start, end) in span.items():
                    d = all_far[:, start:end] if end > start else np.ones((len(x), 1))
                    if draw is not None:
                        least = d.min(axis=1)
                        with np.errstate(divide="ignore"):
                            race = np.where(least > 0, -np.log(_uniform(keys, fit, draw)) / least, np.inf)
                        first = np.flatnonzero(race == race.min())
                        i = int(first[np.argmin(keys[first])])
                        if fit not in best or (race[i], keys[i]) < best[fit][:2]:
                            best[fit] = (race[i], keys[i], x[i])
                        continue
                    near = d.argmin(axis=1)
                    columns = [*x.T, np.ones(len(x)), d[np.arange(len(x)), near]]
                    mine = np.stack([np.bincount(near, weights=c, minlength=end - start) for c in columns], axis=1)
                    sums[fit] = sums[fit] + mine if fit in sums else mine
        if draw is None:
            rows = [(f, c, r[:-2].tolist(), int(r[-2]), float(r[-1])) for f, v in sums.items() for c, r in enumerate(v) if r[-2]]
        else:
            rows = [(f, 0, v[2].tolist(), int(v[1] >> np.uint64(1)), float(v[0])) for f, v in best.items()]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["fit", "cluster", "v", "n", "w"])

    return points.mapInArrow(run, "fit int, cluster int, v array<double>, n long, w double")


def _uniform(keys: np.ndarray, fit: int, draw: int) -> np.ndarray:
    """Uniform in (0, 1), fixed by the row's key, the fit and the draw."""
    salt = np.frombuffer(hashlib.sha256(f"{fit}/{draw}".encode()).digest()[:8], np.uint64)[0]
    h = keys ^ salt
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
    return ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53


def fit_all(points: DataFrame, ks, n_init: int, seed: int, max_iter: int, tol: float) -> dict[int, tuple[np.ndarray, float]]:
    """Best (centres, inertia) for every k over ``n_init`` k-means++ starts; ``points`` has z (array) and key (long)."""
    of = {i: k for i, k in enumerate(k for k in ks for _ in range(n_init))}
    dim = len(points.first()["z"])
    centres = {i: np.zeros((0, dim)) for i in of}
    for step in range(max(ks)):
        open_ = {i: c for i, c in centres.items() if len(c) < of[i]}
        found = _pass(points, open_, seed * 1000 + step).groupBy("fit").agg(F.min(F.struct("w", "n", "v")).alias("m")).collect()
        for r in found:
            centres[r["fit"]] = np.vstack([centres[r["fit"]], r["m"]["v"]])
    live, inertia = dict(centres), dict.fromkeys(of, float("inf"))
    for _ in range(max_iter):
        got = (_pass(points, live, None).groupBy("fit", "cluster")
               .agg(F.sum("n").alias("n"), F.sum("w").alias("w"),
                    F.array(*[F.sum(F.col("v")[j]) for j in range(dim)]).alias("v")).collect())
        new = {i: c.copy() for i, c in live.items()}
        cost = dict.fromkeys(live, 0.0)
        for r in got:
            new[r["fit"]][r["cluster"]] = np.array(r["v"]) / r["n"]
            cost[r["fit"]] += r["w"]
        still = {}
        for i, c in new.items():
            moved = ((c - live[i]) ** 2).sum()
            centres[i], inertia[i] = (live[i], cost[i]) if moved <= tol else (c, cost[i])
            if moved > tol:
                still[i] = c
        live = still
        if not live:
            break
    best: dict[int, tuple[np.ndarray, float]] = {}
    for i, k in of.items():
        if k not in best or inertia[i] < best[k][1]:
            best[k] = centres[i], inertia[i]
    return best


def cluster_items(df: DataFrame, max_k: int = 5, n_init: int = 10, seed: int = 42, max_iter: int = 300,
                  tol: float = 1e-8, centres=None) -> DataFrame:
    """Adds ``cluster``, ``cluster_label`` and ``cluster_confidence``.

    ``centres`` (over the standardised features) skips the fit and only assigns.
    """
    feats = cluster_features(df)
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in feats]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(x):
        aggs += [F.avg(c).alias(f"_mu{i}"), F.stddev_pop(c).alias(f"_sd{i}")]
    stats = df.agg(*aggs).first()
    n = stats["_n"]
    if n < max_k:
        return df.withColumns({"cluster": F.lit(0), "cluster_label": F.lit("Unknown"),
                               "cluster_confidence": F.lit(0.5)})
    z = []
    for i, c in enumerate(x):
        mu, sd = stats[f"_mu{i}"] or 0.0, stats[f"_sd{i}"] or 0.0
        z.append(((c - F.lit(mu)) / F.lit(sd)) if sd > 0 else F.lit(0.0))
    if centres is None:
        narrow = df.select(F.array(*z).alias("z"))
        points = narrow.withColumn("key", F.xxhash64("z")).checkpoint(eager=True)
        ks = list(range(2, min(8, n // 3))) if n >= 20 else []
        best = fit_all(points, sorted({*ks, min(max_k, n)}), n_init, seed, max_iter, tol)
        k = min(max_k, n)
        if len(ks) > 1:
            costs = [best[kk][1] for kk in ks]
            k = min(ks[int(np.argmin(np.diff(costs))) + 1], max_k, n)
        centres = best[k][0]
    return cluster_labels(assign(df.withColumn("_z", F.array(*z)), centres).drop("_z"))


def assign(df: DataFrame, centres, z: str = "_z") -> DataFrame:
    """``cluster`` (nearest centre, the first of equals) and ``cluster_confidence`` of standardised points."""
    far = [F.sqrt(sum(((F.col(z)[i] - F.lit(float(v))) * (F.col(z)[i] - F.lit(float(v))) for i, v in enumerate(c)), F.lit(0.0)))
           for c in centres]
    return (df.withColumn("_d", F.array(*far))
            .withColumn("cluster", (F.array_position("_d", F.array_min("_d")) - 1).cast("int"))
            .withColumn("cluster_confidence", 1 / (1 + F.array_min("_d"))).drop("_d"))


def cluster_labels(df: DataFrame) -> DataFrame:
    """#81: rank clusters by mean profit: 1-3 named tiers, negative mean 'Avoid', else 'Standard'.

    The per-cluster table has k ≤ 8 rows, so ranking it in one partition and
    broadcasting it back is bounded.
    """
    means = df.groupBy("cluster").agg(F.avg("profit").alias("_mp"))
    # Tied clusters share the average of their ranks, cut to a whole number: two at 1.5 are both of the first tier.
    r = means.withColumn("_rk", F.floor(F.rank().over(Window.orderBy(F.desc("_mp"))) +
                                        (F.count(F.lit(1)).over(Window.partitionBy("_mp")) - 1) / 2))
    lab = F.when(F.col("_rk") == 1, S.CLUSTER_LABELS[1]).when(F.col("_rk") == 2, S.CLUSTER_LABELS[2]) \
           .when(F.col("_rk") == 3, S.CLUSTER_LABELS[3]).when(F.col("_mp") < 0, S.CLUSTER_LABEL_NEGATIVE) \
           .otherwise(S.CLUSTER_LABEL_DEFAULT)
    r = r.select("cluster", lab.alias("cluster_label"))
    return df.join(F.broadcast(r), "cluster", "left")


def cluster_summary(df: DataFrame) -> DataFrame:
    """#82: per label mean profit, item count and mean risk, best first."""
    aggs = [F.avg("profit").alias("avg_profit"), F.count(F.lit(1)).alias("items")]
    if "risk_score" in df.columns:
        aggs.append(F.avg("risk_score").alias("avg_risk"))
    return df.groupBy("cluster_label").agg(*aggs).orderBy(F.desc("avg_profit"), "cluster_label")
