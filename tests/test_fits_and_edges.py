"""Checked fits of the forest and the clusters; rolling means at partition edges; ties; text forms; sessions without settings."""

import datetime as dt
import json
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketflow.operators import alerts as AL
from marketflow.operators import ranking as R
from marketflow.operators import sinks as SK
from marketflow.operators import summary as SU
from marketflow.operators.ml import cluster as CL
from marketflow.operators.ml import iforest as IF


def walk(x, tree, node=0):
    """Path length of one row, step by step."""
    f = tree["feature"][node]
    if f < 0:
        n = tree["size"][node]
        return tree["depth"][node] + (0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n)
    return walk(x, tree, tree["left"][node] if x[f] < tree["threshold"][node] else tree["right"][node])


def test_forest_paths_equal_a_plain_walk():
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(256, 3)), 1)
    nodes = np.array(IF._grow(x, rng, 8), dtype=object)
    tree = {k: nodes[:, i].astype(float if k == "threshold" else int) for i, k in enumerate(("feature", "threshold", "left", "right", "size", "depth"))} | {"max_depth": 8}
    rows = np.round(rng.normal(size=(200, 3), scale=2), 1)
    assert IF._path_lengths(rows, tree) == pytest.approx([walk(r, tree) for r in rows])
    leaves = tree["feature"] < 0
    assert tree["size"][leaves].sum() == 256 and tree["depth"].max() <= 8


def test_forest_scores_equal_the_formula(spark, monkeypatch):
    """The scores of the whole job, from the very trees that it grew."""
    rng = np.random.default_rng(5)
    rows = [(f"i{k}", *map(float, rng.normal(size=2))) for k in range(400)] + [("odd", 9.0, -9.0)]
    df = spark.createDataFrame(rows, "item_id string, a double, b double")
    held = {}
    real = pd.DataFrame.groupby

    def groupby(self, *a, **k):
        if "threshold" in getattr(self, "columns", ()):
            held["forest"] = self.copy()
        return real(self, *a, **k)
    monkeypatch.setattr(pd.DataFrame, "groupby", groupby)
    got = {r.item_id: r for r in IF.isolation_forest(df, features=["a", "b"], trees=20).collect()}
    forest = [{c: g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "size", "depth")} for _, g in real(held["forest"], "tree")]
    c = 2 * (np.log(255) + 0.5772156649015329) - 2 * 255 / 256
    for name, a, b in rows[::37] + rows[-1:]:
        assert got[name].anomaly_score == pytest.approx(2 ** (-np.mean([walk((a, b), t) for t in forest]) / c))
    scores = np.array([r.anomaly_score for r in got.values()])
    assert {n for n, r in got.items() if r.is_anomaly} == {n for n, r in got.items() if r.anomaly_score > np.quantile(scores, 0.95)}


def lloyd(z, k, rng):
    """Plain k-means, the best of ten starts."""
    best = np.inf
    for _ in range(10):
        c = z[rng.choice(len(z), 1)]
        while len(c) < k:
            d = ((z[:, None] - c[None]) ** 2).sum(2).min(1)
            c = np.vstack([c, z[rng.choice(len(z), p=d / d.sum())]])
        for _ in range(100):
            near = ((z[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([z[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
        best = min(best, ((z[:, None] - c[None]) ** 2).sum(2).min(1).sum())
    return best


def test_cluster_fit_is_as_good_as_plain_kmeans(spark):
    rng = np.random.default_rng(3)
    z = np.concatenate([rng.normal(m, s, (60, 3)) for m, s in ((0, 1), (4, 0.5), (-5, 1.5), (9, 1))])
    points = spark.createDataFrame([(v.tolist(), k) for k, v in enumerate(z)], "z array<double>, key long").repartition(3)
    fits = CL.fit_all(points, [2, 3, 4, 5], 10, 42, 300, 1e-8)
    for k, (centres, inertia) in fits.items():
        assert len(centres) == k and inertia == pytest.approx(((z[:, None] - centres[None]) ** 2).sum(2).min(1).sum(), rel=1e-6)
        assert inertia <= lloyd(z, k, rng) * 1.01


def test_tied_clusters_share_a_tier(spark):
    rows = [(c, p) for c, ps in ((0, (5.0, 15.0)), (1, (10.0,)), (2, (3.0,)), (3, (-1.0,))) for p in ps]
    got = {r.cluster: r.cluster_label for r in CL.cluster_labels(spark.createDataFrame(rows, "cluster int, profit double")).collect()}
    assert got[0] == got[1] == CL.S.CLUSTER_LABELS[1] and got[2] == CL.S.CLUSTER_LABELS[3] and got[3] == CL.S.CLUSTER_LABEL_NEGATIVE


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_rolling_means_over_partition_edges(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(None if k % 50 == 0 else "hot" if k % 10 else f"i{k % 7}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(rng.integers(0, 40))), k,
             None if k % 13 == 0 else float(rng.integers(-9, 9))) for k in range(400)]
    df = spark.createDataFrame(rows, "item_id string, ts timestamp_ntz, no long, profit double")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.no: (r.sma_short, r.sma_long) for r in R.rolling_means(df, tiebreak=("no",)).collect()}
        assert R.rolling_means(df.where("false"), tiebreak=("no",)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    pdf = pd.DataFrame(rows, columns=["item", "ts", "no", "p"]).sort_values(["ts", "no"])
    pdf["item"] = pdf["item"].astype(object).where(pdf["item"].notna(), "none")
    for n, i in ((3, 0), (6, 1)):
        want = pdf.groupby("item")["p"].rolling(n, min_periods=1).mean().droplevel(0)
        for no, v in zip(pdf.loc[want.index, "no"], want):
            assert got[no][i] is None if np.isnan(v) else got[no][i] == pytest.approx(v)


def test_text_forms(spark):
    df = spark.createDataFrame([("a", 1, None), ("b, \"c\"", 2, 2.5), (None, 3, 0.5)], "name string, n int, x double")
    doc = {}
    for r in SK.keyed_json(df, "name").collect():
        doc.update(json.loads(r.record))
    assert doc == {"a": {"n": 1, "x": None}, 'b, "c"': {"n": 2, "x": 2.5}, "null": {"n": 3, "x": 0.5}}
    lines = [r.line for r in SK.lines_csv(df.where("name IS NOT NULL")).collect()]
    back = spark.createDataFrame([(x,) for x in lines], "v string").select(F.from_csv("v", "name string, n int, x double").alias("r")).select("r.*")
    assert sorted(map(tuple, back.collect())) == sorted(tuple(r) for r in df.where("name IS NOT NULL").collect()) and SK.csv_header(df) == "name,n,x"


def test_pivot_refuses_unbounded_columns(spark):
    df = spark.range(30).select(F.lit("c").alias("category"), F.concat(F.lit("t"), "id").alias("trader_name"), F.col("id").alias("profit"))
    with pytest.raises(ValueError, match="more than 20"):
        SU.profit_pivot(df, max_traders=20)
    assert len(SU.profit_pivot(df, traders=["t1", "t2"]).columns) == 3


def test_rule_upserts_take_frames(spark):
    rules = AL.rules_frame(spark, AL.default_rules())
    more = AL.upsert_rules(rules, AL.watchlist_rules(spark.createDataFrame([("7", "x"), ("8", None)], "item_id string, name string")))
    off = AL.set_enabled(more, spark.createDataFrame([("watchlist_7",), ("none",)], "i string"), False)
    left = AL.remove_rules(off, ["watchlist_8"])
    assert {r.id: r.enabled for r in left.collect()} == {**{r[0]: True for r in AL.default_rules()}, "watchlist_7": False}
    assert left.where("id = 'watchlist_7'").first().message == "Watchlist item x reached profit threshold" and left.columns == rules.columns


def test_a_session_without_settings_has_a_folder(tmp_path):
    code = ("from marketflow.session import get_session, ensure_checkpoint_dir, scratch_path\n"
            "s = get_session(master='local[1]', partitions=1)\n"
            "assert ensure_checkpoint_dir(s) == ensure_checkpoint_dir(s) and scratch_path(s, 'x').endswith('/x')\n"
            "print(s.range(5).checkpoint().count())\n")
    import os
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                         env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)})
    assert out.stdout.strip().endswith("5"), out.stderr[-800:]
