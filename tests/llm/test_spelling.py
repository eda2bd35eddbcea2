"""Spelling groups against a plain version, and single edits against all pairs."""

import random
import re
import zlib
from collections import Counter

import pandas as pd

from marketflow.llm import spelling
from marketflow.llm.spelling import spelling_groups


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, damage=199):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % damage == 0:
                run = "".join(c for i, c in enumerate(run) if i != h % len(run))
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    form, near = {}, {}
    for w in n:
        near[w] = [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, []) if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w
    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def got(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_equals_plain_version(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    rows = list(zip(docs.doc_id.tolist(), docs.text))
    want = plain(rows)
    assert got(spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert any(v[0] for v in want.values()) and any(v[3] > 1 for v in want.values())


def test_every_single_edit_and_hot_blocks(spark, monkeypatch):
    rng = random.Random(4)
    words = {"".join(rng.choices("abé", k=rng.randint(6, 9))) for _ in range(700)}
    words |= {"commonbeginning" + "".join(rng.choices("xyz", k=3)) for _ in range(200)}
    text = " ".join(w for w in sorted(words) for _ in range(rng.choice([5, 6, 40, 300])))
    rows = [(1, text)]
    want = plain(rows, 10**12)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling_groups(frame, damage=0)) == want
    monkeypatch.setattr(spelling, "INDEX", 16)  # most blocks are cut into several indexes
    assert got(spelling_groups(frame, damage=0)) == want


def test_odd_input(spark):
    long = "lettersandletters" * 2000
    rows = [(1, None), (2, ""), (3, " 12 ab "), (None, "Variant variant VARIANT varian7t " * 20), (4, "varyant " * 5), (4, "varyant"), (4, "varyant"),
            (5, f"{long} " * 5), (6, f"{long}x " * 40), (7, "ÀBCDEFG àbcdefg " * 5), (8, "\U0001F600variant"),
            (9, "aabbccdd " * 5), (9, "aabbccd " * 30), (9, "aabbcc " * 200)]
    frame = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], "doc_id long, text string, n int, word string, block int, form string")
    want = plain(rows)
    out = spelling_groups(frame)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got(out) == want
    assert want["aabbccdd"][1] == "aabbcc" and want["varyant"][0] == "variant" and want[long][0] == long + "x"
    assert spelling_groups(frame.where("false")).count() == 0
