"""#83 similar items: z-scored Euclidean distance with one-hot category, exact top-k.

Numeric features are standardised with the population std (a constant column
scales by 1, i.e. contributes 0).  The one-hot category block has a closed
form: two rows of different categories a, b differ by 1/σa² + 1/σb² in squared
distance (σc² = pc·(1−pc)), rows of one category by 0 — no one-hot columns are
materialised.

Targets may be any number of items.  Rows are dealt to the nearest of a set of pivot
rows; a cell keeps the range of its distances to its pivot and its closest items.  The
closest items of all cells bound how far a target's ``k``-th neighbour can be, and by the
triangle inequality most cells hold nothing that near: they are never compared.  Cells
and their targets are cut into blocks of a bounded size; a task compares one block with
another, carrying only row numbers and standardised features.  The ``k`` nearest over
all blocks follow, and only they are joined with their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ... import settings as S
from ..sequence import numbered

#: Rows of a block of targets and of candidates, about.
TARGET_BLOCK = 2_000
ROW_BLOCK = 20_000
#: Rows a pivot, about, and pivots at most.
CELL, PIVOTS = 1_000, 1_024
#: Far above the rounding of a distance; keeps ties and near ties in.
_SLACK = 1e-9


class _Pivots:
    """Pivot rows as arrays: standardised features, category and 1/variance of its indicator."""

    def __init__(self, rows: list):
        self.z = np.array([r["_z"] for r in rows], float).reshape(len(rows), -1)
        self.cat, self.icv = np.array([r["_cat"] for r in rows], object), np.array([r["_icv"] for r in rows], float)

    def distances(self, z: np.ndarray, cat: np.ndarray, icv: np.ndarray) -> np.ndarray:
        """From each of some rows to every pivot."""
        d2 = np.zeros((len(z), len(self.z)))
        for j in range(z.shape[1]):
            d2 += (z[:, j, None] - self.z[None, :, j]) ** 2
        none = np.array([c is None for c in cat])
        same = (cat[:, None] == self.cat[None, :]) | (none[:, None] & np.array([c is None for c in self.cat])[None, :])
        return np.sqrt(d2 + np.where(same, 0.0, icv[:, None] + self.icv[None, :]))


def _points(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    z = np.array(b.column("_z").to_pylist(), float).reshape(b.num_rows, -1)
    return z, np.array(b.column("_cat").to_pylist(), object), b.column("_icv").to_numpy()


def _cells(narrow: DataFrame, pivots) -> DataFrame:
    """``narrow`` with the nearest pivot of each row and the distance to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2_000):
                part = b.slice(i, 2_000)
                d = pivots.value.distances(*_points(part))
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])],
                                                 [*part.schema.names, "cell", "away"])
    return narrow.mapInArrow(run, "_no long, _id string, _z array<double>, _cat string, _icv double, cell int, away double").checkpoint(eager=True)


def cells_to_visit(targets: DataFrame, cells: DataFrame, pivots, n_pivots: int, k: int) -> DataFrame:
    """``targets`` (target_id, _z, _cat, _icv), one row for each cell that may hold one of its ``k`` nearest rows."""
    spark = targets.sparkSession
    ranges = cells.groupBy("cell").agg(F.min("away").alias("lo"), F.max("away").alias("hi")).collect()      # a row a pivot
    low, high = np.full(n_pivots, np.inf), np.full(n_pivots, -np.inf)
    for r in ranges:
        low[r["cell"]], high[r["cell"]] = r["lo"], r["hi"]
    # The closest k + 1 items of each cell: without the target's own, k of them are left.
    ids = cells.where("_id IS NOT NULL").groupBy("cell", "_id").agg(F.min("away").alias("away"))
    w = Window.partitionBy("cell").orderBy("away", "_id")
    close = ids.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1).select("cell", "_id", "away").collect()
    sent = spark.sparkContext.broadcast((low, high, np.array([r["cell"] for r in close], int), np.array([r["_id"] for r in close], object),
                                         np.array([r["away"] for r in close], float), pivots.value.distances(pivots.value.z, pivots.value.cat, pivots.value.icv)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, cell, names, away, between = sent.value
        full = np.flatnonzero(high >= low)
        for b in batches:
            rows, visit = [], []
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                d = pivots.value.distances(*_points(part))
                own = d.argmin(axis=1)
                for t, name in enumerate(part.column("target_id").to_pylist()):
                    ub = np.sort((d[t, cell] + away)[names != name])
                    far = (ub[k - 1] if len(ub) >= k else np.inf) * (1 + _SLACK) + _SLACK
                    least = np.maximum(d[t, full] - high[full], low[full] - d[t, full])
                    gap = between[own[t], full]
                    with np.errstate(divide="ignore", invalid="ignore"):  # rows nearer to their own pivot lie beyond the middle
                        middle = np.where(gap > 0, (d[t, full] ** 2 - d[t, own[t]] ** 2) / (2 * gap), 0.0)
                    seen = full[np.maximum(least, middle) <= far]
                    rows.append(np.full(len(seen), i + t))
                    visit.append(seen)
            at = pa.array(np.concatenate(rows) if rows else np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("target_id", "_z", "_cat", "_icv")),
                                              pa.array((np.concatenate(visit) if visit else np.zeros(0, int)).astype(np.int32))],
                                             ["target_id", "_z", "_cat", "_icv", "cell"])
    return (targets.select("target_id", "_z", "_cat", "_icv")
            .mapInArrow(run, "target_id string, _z array<double>, _cat string, _icv double, cell int").checkpoint(eager=True))


def similar_items(df: DataFrame, targets: DataFrame, k: int = 5,
                  features=S.SIMILARITY_FEATURES, category: str | None = "category",
                  row_key=("item_id",)) -> DataFrame:
    """For each target item id, the ``k`` most similar rows of ``df`` (excluding the item itself).

    ``targets`` has the item id in its first column.  Output: target_id, rank,
    the neighbour's columns, distance and ``similarity_score = 1/(1+d)``.
    """
    if not isinstance(k, int) or isinstance(k, bool) or k <= 0:
        return df.limit(0)
    feats = [f for f in features if f in df.columns]
    x = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in feats}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(feats):
        aggs += [F.avg(x[f]).alias(f"_mu{i}"), F.stddev_pop(x[f]).alias(f"_sd{i}")]
    stats = df.agg(*aggs)
    use_cat = category is not None and category in df.columns
    base = df.crossJoin(F.broadcast(stats))     # one-row statistics
    z = {}
    for i, f in enumerate(feats):
        sd = F.col(f"_sd{i}")
        z[f] = F.when(sd > 0, (x[f] - F.col(f"_mu{i}")) / sd).otherwise(F.lit(0.0))
    pts = base.select("*", *[z[f].alias(f"_z{i}") for i, f in enumerate(feats)])
    if use_cat:
        # rows without a category have an all-zero dummy block (they add no 1/σ² of their own)
        cats = (df.filter(F.col(category).isNotNull())
                .groupBy(F.col(category).alias("_cat")).agg(F.count(F.lit(1)).alias("_cn"))
                .crossJoin(F.broadcast(stats.select("_n")))
                .select("_cat", (F.col("_cn") / F.col("_n")).alias("_pc")))
        cats = cats.select("_cat", F.when((F.col("_pc") > 0) & (F.col("_pc") < 1),
                                          1 / (F.col("_pc") * (1 - F.col("_pc"))))
                           .otherwise(F.lit(0.0)).alias("_icv"))
        pts = (pts.join(cats, pts[category] == cats["_cat"], "left")
               .withColumn("_icv", F.coalesce(F.col("_icv"), F.lit(0.0)))
               .withColumn("_cat", F.col(category)))
    else:
        pts = pts.withColumns({"_cat": F.lit(None).cast("string"), "_icv": F.lit(0.0)})
    zs = [f"_z{i}" for i in range(len(feats))]
    pts = numbered(pts, [F.col(c) for c in row_key], "_no").checkpoint(eager=True)
    narrow = pts.select("_no", F.col("item_id").cast("string").alias("_id"), F.array(*zs).alias("_z"),
                        F.col("_cat").cast("string").alias("_cat"), "_icv").checkpoint(eager=True)
    tid = targets.select(F.col(targets.columns[0]).cast("string").alias("target_id")).distinct()
    # the target's own point: its first row in the frame's row order
    tp = (narrow.join(tid, narrow["_id"] == tid["target_id"])
          .groupBy("target_id").agg(F.min_by(F.struct("_z", "_cat", "_icv"), "_no").alias("p"))
          .select("target_id", "p.*").checkpoint(eager=True))
    n_pivots = max(1, min(PIVOTS, narrow.count() // CELL))
    chosen = narrow.orderBy(F.xxhash64("_no"), "_no").limit(n_pivots).select("_z", "_cat", "_icv").collect()
    if not chosen:
        return pts.withColumns({"target_id": F.lit(""), "distance": F.lit(0.0), "rank": F.lit(0), "similarity_score": F.lit(0.0)}).drop(
            *[c for c in pts.columns if c.startswith("_")]).limit(0)
    pivots = df.sparkSession.sparkContext.broadcast(_Pivots(chosen))
    cells = _cells(narrow, pivots)
    visits = cells_to_visit(tp, cells, pivots, n_pivots, k)
    # Blocks: a cell's rows and the targets that visit it, each cut to its size.
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    r_cuts = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).alias("r_cuts"))
    t_cuts = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TARGET_BLOCK).alias("t_cuts"))
    cuts = r_cuts.join(t_cuts, "cell")      # a row a pivot
    left = (visits.join(F.broadcast(cuts), "cell").withColumn("tb", F.pmod(F.xxhash64("target_id"), F.col("t_cuts"))).withColumn("rb", every("r_cuts"))
            .select("target_id", "_z", "_cat", "_icv", "cell", "tb", "rb"))
    right = (cells.join(F.broadcast(cuts), "cell").withColumn("rb", F.pmod(F.xxhash64("_no"), F.col("r_cuts"))).withColumn("tb", every("t_cuts"))
             .select("_no", "_id", "_z", "_cat", "_icv", "cell", "tb", "rb"))

    def block(t: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(t) or not len(r):
            return pd.DataFrame({"target_id": [], "n_no": [], "distance": []})
        r = r.sort_values("_no")
        codes = pd.factorize(pd.concat([t["_cat"], r["_cat"]]), use_na_sentinel=True)[0]
        tc, rc = codes[:len(t)], codes[len(t):]
        rz, no, ids, ricv = np.stack(r["_z"].to_numpy()), r["_no"].to_numpy(), r["_id"].to_numpy(), r["_icv"].to_numpy()
        out = []
        for i, (target, z0, icv) in enumerate(zip(t["target_id"], t["_z"], t["_icv"])):
            d2 = np.zeros(len(r))
            for j, v in enumerate(z0):
                d2 += (rz[:, j] - v) ** 2
            d2 += np.where(rc == tc[i], 0.0, ricv + icv)
            d = np.sqrt(d2)
            d[ids == target] = np.inf
            d[pd.isna(ids)] = np.inf
            top = np.argsort(d, kind="stable")[:k]
            out.append(pd.DataFrame({"target_id": target, "n_no": no[top], "distance": d[top]}))
        out = pd.concat(out)
        return out[np.isfinite(out["distance"])]

    near = (left.groupBy("cell", "tb", "rb").cogroup(right.groupBy("cell", "tb", "rb"))
            .applyInPandas(block, "target_id string, n_no long, distance double"))
    best = Window.partitionBy("target_id").orderBy("distance", "n_no")
    top = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    rows = pts.join(top, pts["_no"] == top["n_no"])
    drop = [c for c in rows.columns if c.startswith("_")] + ["n_no"]
    return rows.withColumn("similarity_score", 1 / (1 + F.col("distance"))).drop(*drop)
