"""#78-79 isolation forest (Liu, Ting & Zhou, 2008) on Spark.

MLlib has no isolation forest, so the work is split the Spark way:

1. **Sampling** — each row draws a deterministic uniform number per tree from
   a hash of (seed, tree, row key); rows under a rate of ~3ψ/n are kept, and
   the ψ smallest draws per tree form that tree's sample (a window over at
   most ~3ψ rows per tree).  Same seed, same data ⇒ same forest, regardless
   of partitioning or task retries.
2. **Growing** — ``groupBy(tree).applyInPandas``: one task per tree grows a
   random-split tree over its ψ ≤ 256 rows with numpy.
3. **Scoring** — the forest (≤ trees × (2ψ−1) nodes: a proven bound) is
   collected once and turned into tables of bits: for each interval between
   two thresholds of a feature, the leaves it leaves open, a bit each.  The
   bits of a row's intervals, and-ed over the features, leave one leaf of each
   tree, so a row takes a few hundred word operations in place of a walk down
   each tree.  A pandas UDF takes the features only; the rest of a row stays in
   the JVM.  The anomaly cut is the exact linear-interpolated quantile of the
   scores, found by narrowing (``operators.quantile``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ... import settings as S
from ..quantile import exact_quantile

EULER = 0.5772156649015329
BITS = 62           # leaves a word, which stays positive and converts to a double of the same exponent
BLOCK = 256         # rows whose words stay in the processor's cache
MASK53 = (1 << 53) - 1


def avg_path(n):
    """c(n): mean path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()), T.StructField("depth", T.IntegerType()),
])


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Random-split tree as flat node arrays; a leaf has feature -1."""
    nodes = []          # [feature, threshold, left, right, size, depth]
    stack = [(np.arange(len(x)), 0, None, None)]
    while stack:
        idx, depth, parent, side = stack.pop()
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(idx), depth])
        if parent is not None:
            nodes[parent][2 if side == 0 else 3] = me
        if len(idx) <= 1 or depth >= max_depth:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            continue
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < thr
        nodes[me][0], nodes[me][1] = f, thr
        stack.append((idx[~go_left], depth + 1, me, 1))
        stack.append((idx[go_left], depth + 1, me, 0))
    return nodes


def _path_lengths(x: np.ndarray, tree: dict) -> np.ndarray:
    """The plain walk down one tree, whose sums ``_summed_paths`` equals bit for bit."""
    node = np.zeros(len(x), dtype=np.int64)
    feat, thr, left, right = tree["feature"], tree["threshold"], tree["left"], tree["right"]
    for _ in range(tree["max_depth"] + 1):
        f = feat[node]
        active = f >= 0
        if not active.any():
            break
        a = np.flatnonzero(active)
        go_left = x[a, f[a]] < thr[node[a]]
        node[a] = np.where(go_left, left[node[a]], right[node[a]])
    return tree["depth"][node] + avg_path(tree["size"][node])


def _tables(forest: list[dict], features: int):
    """(cuts, masks, paths): the thresholds of each feature, the leaves that each interval between them leaves open, and
    the path length of each leaf, at the exponent of its bit (0 where no bit is set).  Words belong to one tree each."""
    cuts = [np.unique(np.concatenate([t["threshold"][t["feature"] == f] for t in forest]).astype(float)) for f in range(features)]
    leaves, words = [], 0
    for t in forest:
        length = t["depth"] + avg_path(t["size"])
        stack, k = [(0, [0] * features, [len(c) for c in cuts])], 0
        while stack:
            i, lo, hi = stack.pop()
            f = int(t["feature"][i])
            if f < 0:
                leaves.append((words + k // BITS, k % BITS, length[i], lo, hi))
                k += 1
                continue
            c = int(np.searchsorted(cuts[f], t["threshold"][i]))
            stack.append((int(t["right"][i]), [max(v, c + 1) if g == f else v for g, v in enumerate(lo)], hi))
            stack.append((int(t["left"][i]), lo, [min(v, c) if g == f else v for g, v in enumerate(hi)]))
        words += -(-k // BITS)
    masks, paths = [np.zeros((len(c) + 1, words), np.int64) for c in cuts], np.zeros((words, BITS + 1))
    for w, bit, length, lo, hi in leaves:
        paths[w, bit + 1] = length
        for f in range(features):
            masks[f][lo[f]:hi[f] + 1, w] |= np.int64(1 << bit)
    return cuts, masks, paths


def _summed_paths(x: np.ndarray, cuts, masks, paths) -> np.ndarray:
    """Path lengths of each row, summed tree by tree.  NaN lies behind every threshold, as in a walk."""
    at = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
    flat, base = paths.ravel(), (np.arange(len(paths)) * paths.shape[1] - 1022)[:, None]
    h = np.zeros(len(x))
    for i in range(0, len(x), BLOCK):
        open_ = masks[0].take(at[0][i:i + BLOCK], axis=0)
        for m, a in zip(masks[1:], at[1:]):
            open_ &= m.take(a[i:i + BLOCK], axis=0)
        exponent = np.maximum(open_.astype(np.float64).view(np.int64) >> 52, 1022)
        found, own = flat.take(np.ascontiguousarray(exponent.T) + base), h[i:i + BLOCK]
        for length in found:
            own += length
    return h


def isolation_forest(df: DataFrame, features=None, trees: int = S.FOREST_TREES,
                     contamination: float = S.ANOMALY_CONTAMINATION, seed: int = 42,
                     max_samples: int = 256, row_key=("item_id",),
                     min_rows: int = S.MIN_ITEMS_FOR_ANOMALY) -> DataFrame:
    """Adds ``anomaly_score`` (higher = more isolated) and ``is_anomaly`` (0/1)."""
    if features is None:
        features = list(S.ANOMALY_FEATURES_CORE) + [f for f in S.ANOMALY_FEATURES_EXTRA if f in df.columns]
    feats = list(features)
    xcols = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"_f{i}") for i, f in enumerate(feats)]
    key = F.xxhash64(*[F.col(c).cast("string") for c in row_key])
    base = df.withColumn("_key", key)
    # narrow (key + features) copy, reused by every sampling pass
    xf = base.select("_key", *xcols).persist(StorageLevel.MEMORY_AND_DISK)
    n = xf.count()
    if n < min_rows:
        xf.unpersist()
        return df.withColumns({"is_anomaly": F.lit(0), "anomaly_score": F.lit(0.0)})
    psi = min(max_samples, n)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    rate = min(1.0, 3.0 * psi / n + 64.0 / n)

    def draw(t):
        return F.xxhash64(F.lit(seed), t, F.col("_key")).bitwiseAND(F.lit(MASK53))

    def uniform(drawn):
        return drawn.cast("double") / float(1 << 53)
    # The least draw of a row is compiled code; few rows come to the array of their draws.
    least = F.least(*(draw(F.lit(t)) for t in range(trees))) if trees > 1 else draw(F.lit(0))
    while True:
        draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), uniform(draw(t)).alias("u")))
        kept = F.filter(draws, lambda s: s["u"] < F.lit(rate))
        some = xf.where(uniform(least) < F.lit(rate)) if rate < 1.0 else xf
        cand = (some.select(F.explode(kept).alias("_d"), "_key", *[f"_f{i}" for i in range(len(feats))])
                .select("_d.tree", "_d.u", "_key", *[f"_f{i}" for i in range(len(feats))]))
        w = Window.partitionBy("tree").orderBy("u", "_key")
        sample = (cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= psi).drop("_r")
                  .persist(StorageLevel.MEMORY_AND_DISK))
        sizes = sample.groupBy("tree").count()
        ok = sizes.agg(F.count(F.lit(1)).alias("t"), F.min("count").alias("m")).first()
        if (ok["t"] == trees and (ok["m"] or 0) >= psi) or rate >= 1.0:
            break
        sample.unpersist()
        rate = min(1.0, rate * 2)

    fcols = [f"_f{i}" for i in range(len(feats))]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["u", "_key"])
        rng = np.random.default_rng([seed, t])
        nodes = _grow(pdf[fcols].to_numpy(dtype=float), rng, max_depth)
        arr = np.array(nodes, dtype=object)
        return pd.DataFrame({"tree": t, "node": np.arange(len(nodes), dtype=np.int32),
                             "feature": arr[:, 0].astype(np.int32), "threshold": arr[:, 1].astype(float),
                             "left": arr[:, 2].astype(np.int32), "right": arr[:, 3].astype(np.int32),
                             "size": arr[:, 4].astype(np.int32), "depth": arr[:, 5].astype(np.int32)})

    forest_df = sample.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
    rows = forest_df.orderBy("tree", "node").toPandas()   # <= trees * (2*psi - 1) rows
    forest = [{k: g[k].to_numpy() for k in ("feature", "threshold", "left", "right", "size", "depth")}
              for _, g in rows.groupby("tree", sort=True)]
    c_psi = float(avg_path(np.array([psi]))[0])
    sent, grown = df.sparkSession.sparkContext.broadcast(_tables(forest, len(feats))), len(forest)

    @F.pandas_udf(T.DoubleType())
    def score(*columns: pd.Series) -> pd.Series:
        h = _summed_paths(np.column_stack([c.to_numpy(dtype=float) for c in columns]), *sent.value)
        return pd.Series(np.power(2.0, -(h / grown) / c_psi))

    # Only the features cross to Python.  Scores are written once, narrow, for the cut; the output scores its rows
    # again, which costs less than keeping or joining full-width rows.
    scored = score(*xcols)
    cut = exact_quantile(xf.select(score(*[f"_f{i}" for i in range(len(feats))]).alias("s")), "s", 1 - contamination)
    for kept in (xf, sample):
        kept.unpersist()
    return (df.withColumn("anomaly_score", scored)
            .withColumn("is_anomaly", (F.col("anomaly_score") > F.lit(cut)).cast("int")))
