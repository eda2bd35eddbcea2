"""Nearest items by pivots: equal to plain distances, with most cells never compared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketflow.operators.ml import neighbors as N

FEATS = ("a", "b", "c")


def frame(spark, seed, n, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (8, 3))
    rows = []
    for k in range(n):
        x = centres[k % 8] + rng.normal(0, 1, 3)
        if k % 11 == 0 and rows:
            x = np.array(rows[int(rng.integers(len(rows)))][2:5])       # ties
        rows.append((f"i{k if k % 17 else k // 34}", [None, "p", "q"][k % 3], *map(float, x), k))
    return rows, spark.createDataFrame(rows, "item_id string, category string, a double, b double, c double, no long")


def plain(rows, targets, k):
    x = np.array([r[2:5] for r in rows])
    z = (x - x.mean(0)) / x.std(0)
    share = {c: sum(r[1] == c for r in rows) / len(rows) for c in {r[1] for r in rows} - {None}}
    icv = np.array([0.0 if r[1] is None else 1 / (share[r[1]] * (1 - share[r[1]])) for r in rows])
    out = {}
    for t in targets:
        i = min((j for j, r in enumerate(rows) if r[0] == t), key=lambda j: (rows[j][0], rows[j][5]), default=None)
        if i is not None:
            d = np.sqrt(((z - z[i]) ** 2).sum(1) + np.where([r[1] == rows[i][1] for r in rows], 0, icv + icv[i]))
            out[t] = sorted(float(v) for v, r in zip(d, rows) if r[0] != t)[:k]
    return out


@pytest.mark.parametrize("seed,spread", [(1, 0.0), (2, 20.0)])
def test_equals_plain_distances(spark, monkeypatch, seed, spread):
    monkeypatch.setattr(N, "CELL", 20)
    monkeypatch.setattr(N, "ROW_BLOCK", 30)
    monkeypatch.setattr(N, "TARGET_BLOCK", 25)
    rows, df = frame(spark, seed, 1500, spread)
    ids = [f"i{k}" for k in range(0, 1500, 9)] + ["absent"]
    targets = spark.createDataFrame([(i,) for i in ids], "id string")
    compared = []
    real = N.cells_to_visit

    def counted(t, cells, pivots, n, k):
        out = real(t, cells, pivots, n, k)
        compared.append((out.count(), t.count() * n))
        return out
    monkeypatch.setattr(N, "cells_to_visit", counted)
    got: dict = {}
    for r in N.similar_items(df, targets, k=4, features=FEATS, row_key=("item_id", "no")).orderBy("target_id", "rank").collect():
        got.setdefault(r.target_id, []).append(r.distance)
        assert r.item_id != r.target_id
    want = plain(rows, ids, 4)
    assert set(got) == set(want) and all(got[t] == pytest.approx(want[t], abs=1e-9) for t in want)
    visited, pairs = compared[0]
    assert visited < pairs * (0.6 if spread == 0 else 0.25)     # block pairs that cannot hold a neighbour are left out


def test_few_rows_and_none(spark):
    rows, df = frame(spark, 3, 3, 1.0)
    one = spark.createDataFrame([("i1",)], "id string")
    assert [r.item_id for r in N.similar_items(df, one, k=9, features=FEATS, row_key=("item_id", "no")).collect()].count("i1") == 0
    assert N.similar_items(df, one, k=9, features=FEATS, row_key=("item_id", "no")).count() == 2
    assert N.similar_items(df.where("false"), one, features=FEATS, row_key=("item_id", "no")).count() == 0
    assert N.similar_items(df, one.where("false"), features=FEATS, row_key=("item_id", "no")).count() == 0
    assert N.similar_items(df, one, k=0).count() == 0
    alone = df.where(F.col("item_id") == "i1")
    assert N.similar_items(alone, one, features=FEATS, row_key=("item_id", "no")).count() == 0
