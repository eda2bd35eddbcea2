"""Jaccard join against all pairs, its list skipping against plain filters, and derived answers."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from marketflow.llm.jaccard_join import _list_pairs, prefix_length, shingle_set, similar_sets


def plain_set(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def plain(rows, percent=85):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def changed(rng, words, share):
    return [rng.choice(["aa", "bb", "cc", "dd", "ee"]) + str(rng.randrange(9999)) if rng.random() < share else w for w in words]


def test_equals_all_pairs(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    rows = list(zip(docs.doc_id.tolist(), docs.text))
    rng = random.Random(2)
    for i, t in enumerate(docs.text[:80]):
        rows.append((1000 + i, " ".join(changed(rng, t.split(" "), rng.choice([0.005, 0.02, 0.04])))))
    got = similar_sets(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = plain(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(c != d for d, _, c in want) > 40


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chains_and_families_at_the_threshold(spark, seed):
    """Copies of copies, and two families so close to the threshold that some member pairs must be counted."""
    rng = random.Random(seed)
    rows = []
    for f in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for k in range(4):  # sister families
            own = changed(rng, base, 0.035)
            rows += [(len(rows) * 10 + j, " ".join(changed(rng, own, 0.012))) for j in range(8)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = similar_sets(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_open_answers_are_counted(spark):
    """Two leaders just under the threshold whose members reach it."""
    base = [f"w{i}" for i in range(400)]
    a, b = list(base), list(base)
    for i in range(0, 66, 4):
        b[i + 100] = f"x{i}"
    near = list(b)
    for i in range(0, 30, 4):
        near[i + 100] = base[i + 100]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(near)), (4, " ".join(a + ["tail"])), (5, " ".join(b[:-1]))]
    got = similar_sets(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_list_skipping_loses_nothing():
    rng = np.random.default_rng(5)
    n = rng.integers(1, 300, 600)
    pos = np.array([rng.integers(0, prefix_length(int(x))) for x in n])
    token = np.sort(rng.integers(0, 12, 600))
    ids, comp = np.arange(600), rng.integers(0, 40, 600)
    a, b = _list_pairs(token, n, pos, ids, comp, 85)
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if token[i] == token[j] and comp[i] != comp[j]
            and 100 * min(n[i], n[j]) >= 85 * max(n[i], n[j]) and 185 * min(n[i] - pos[i], n[j] - pos[j]) >= 85 * (n[i] + n[j])}
    assert set(zip(a.tolist(), b.tolist())) == want
    group = comp  # whole groups as one entry: every pair of members must be covered
    a, b = _list_pairs(token, n, pos, group, comp, 85)
    covered = set(zip(a.tolist(), b.tolist()))
    assert all((min(comp[i], comp[j]), max(comp[i], comp[j])) in covered for i, j in want)
    assert all(len(x) == 0 for x in _list_pairs(token, n, pos, ids, np.zeros(600, int), 85))


def test_odd_input(spark):
    long = " ".join(random.Random(5).choices([f"v{i}" for i in range(300)], k=30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one  TWO"), (6, "one two three four"), (None, None), (None, "ONE two"),
            (7, long), (8, long + " more"), (9, "à É b c d"), (9, "à É b c d"), (9, "other text"), (10, "à é b c d"),
            *((20 + i, "word pair " * (5 + i)) for i in range(30))]
    frame = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], "doc_id long, text string, id long, n int, comp string, keys int")
    got = similar_sets(frame)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
    assert similar_sets(frame.where("false")).count() == 0
    assert len(shingle_set("a b")) == 1 and len(shingle_set(None)) == 0
