"""op3 finds every overlap that its thresholds accept: short items, many substitutions, partial passages."""

import random
import re
from collections import Counter

import numpy as np

from marketflow.llm.decontaminate import MASKS, _best_stretch, contaminated


def plain_best(same):
    """Most agreeing tokens of a stretch of which they are 60 %, by trying all."""
    return max((j - i + 1 for i in range(len(same)) for j in range(i, len(same))
                if 10 * (j - i + 1) >= 6 * (same[j] - same[i] + 1)), default=0)


def test_masks_meet_every_accepted_overlap():
    masks = [int(m, 2) for m in MASKS]
    for size in range(10, 17):
        for middle in range(1 << size - 2):
            p = 1 << size - 1 | middle << 1 | 1
            if p.bit_count() >= 10 and 10 * p.bit_count() >= 6 * size:
                assert any(p >> k & m == m for m in masks for k in range(size - m.bit_length() + 1)), bin(p)


def test_best_stretch_matches_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        same = sorted(rng.sample(range(60), rng.randint(0, 30)))
        m, n = _best_stretch(np.array(same, np.int64), 0.6)
        assert m == plain_best(same) and 10 * m >= 6 * n


def test_many_substitutions_short_items_and_parts(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    items = [" ".join(rng.choices(words, k=k)) for k in [*range(1, 21), *range(11, 21), *range(22, 60, 2)]]
    docs = []
    for d in range(400):
        text = rng.choices(words, k=rng.randint(5, 150))
        passage = items[d % len(items)].split()
        if d % 4 == 3:  # a verbatim part, and one more agreeing token far from it
            half = len(passage) // 2 + 1
            passage = passage[:half] + ["other"] * (len(passage) - half - 1) + passage[-1:]
        else:
            for p in rng.sample(range(len(passage)), len(passage) * (2 + d % 3) // 10):  # 20 to 40 %
                passage[p] = "other"
        at = rng.randint(0, len(text))
        text[at:at] = passage
        docs.append((d, " ".join(text)))
    want = {}
    for d, text in docs:
        t = re.findall(r"[a-z]+", text)
        at = {}
        for i, w in enumerate(t):
            at.setdefault(w, []).append(i)
        for k, item in enumerate(items):
            b = item.split()
            need = max(min(10, len(b)), len(b) / 2)
            for o, n in Counter(i - j for j, w in enumerate(b) for i in at.get(w, ())).items():
                if n >= need:
                    m = plain_best([j for j, w in enumerate(b) if 0 <= o + j < len(t) and t[o + j] == w])
                    if m >= need:
                        want[d, k] = max(m, want.get((d, k), 0))
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                       spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.matched for r in got} == want and len(want) > 150
