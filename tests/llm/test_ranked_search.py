"""Ball-tree search against a plain ranking, and its bounds."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd

from marketflow.llm.ball_search import BallTree, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, top=10):
    def words(t):
        return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(w), len(w)) for i, w in ((i, words(t)) for i, t in docs) if w]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        rank = []
        for i, c, size in held:
            m = 10 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m))
                    for w in set(words(text)) if c[w])
            if s > 0:
                rank.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(rank)[:top])]
    return sorted(out, key=str)


def test_equals_a_plain_ranking(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    bench = pd.read_parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows, items = list(zip(docs.doc_id.tolist(), docs.text)), list(zip(bench.item_id.tolist(), bench.text))
    got = ranked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
                 spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, items)


def test_odd_input(spark):
    long = " ".join(random.Random(1).choices(["the", "of", "Été", "x9", "word"], k=30_000))
    rows = [(1, None), (2, ""), (3, " \n-"), (4, "The word"), (4, "the WORD"), (5, long), (6, long), (None, "word of"), (None, None),
            *((100 + i, "same word here") for i in range(40))]
    items = [(1, "the word of"), (1, "the word of"), (2, None), (3, ""), (None, "été word"), (4, "absent"), (5, "été")]
    docs = spark.createDataFrame([(*r, 1, 2, "s", 3) for r in rows], "doc_id long, text string, n int, score long, terms string, item int")
    asked = spark.createDataFrame([(*r, 9, "x") for r in items], "item_id long, text string, doc_id int, rank string")
    got = ranked(docs, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, [items[0], *items[4:]])
    assert ranked(docs.where("false"), asked).count() == ranked(docs, asked.where("false")).count() == 0
    by_name = ranked(docs.withColumn("doc_id", docs.doc_id.cast("string")), asked.withColumn("item_id", asked.item_id.cast("string")), top=1)
    assert {r.item_id for r in by_name.collect()} == {"1", None}  # only A-Z are lower-cased


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    topics = [rng.choice(200, 30, replace=False) for _ in range(16)]
    rows = [np.sort(rng.choice(topics[i % 16], 12, replace=False)) for i in range(2000)]
    rows += [rows[0]] * 300
    indptr, cols = np.arange(0, 12 * len(rows) + 1, 12), np.concatenate(rows)
    vals = rng.integers(1, 900_000, len(cols))
    tree = BallTree(indptr, cols, vals, 200)
    seen = 0
    for _ in range(20):
        q = np.sort(rng.choice(200, 8, replace=False))
        w = rng.integers(1, 9000, 8)
        dense = np.zeros(200, np.int64)
        dense[q] = w
        exact = np.array([(dense[cols[a:a + 12]] * vals[a:a + 12]).sum() for a in indptr[:-1]])
        bound = tree.bounds(q, w)
        for node, (lo, hi) in enumerate(zip(tree.lo, tree.hi)):
            assert bound[node] >= exact[tree.order[lo:hi]].max()
        best: list = []
        for row, score in tree.search(q, w, lambda: sorted(best)[-5] if len(best) >= 5 else 1):
            assert score == exact[row]
            best.append(score)
            seen += 1
        assert sorted(best)[-5:] == sorted(exact.tolist())[-5:]
    assert seen < 20 * len(rows) / 2  # most documents are never offered
