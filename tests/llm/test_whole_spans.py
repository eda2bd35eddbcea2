"""op4 judges every run of three sentences, lengthened to forty words; long sentences are cut by content."""

import random
import re

import xxhash

from marketflow.llm.queries import QUERIES
from marketflow.llm.sentences import sentences

SF = "/root/testdata/sf0.001"


def pair(a, b):
    m = 2**64 - 1
    h = (xxhash.xxh3_64_intdigest(a) * 0x9E3779B97F4A7C15 + xxhash.xxh3_64_intdigest(b)) & m
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & m
    h ^= h >> 29
    h = h * 0xA0761D6478BD642F & m
    return h ^ h >> 32


def pieces(text):
    """The rule over again: stops and line ends, then cuts before words whose pair hashes least among three on either side."""
    whole = sentences(text, longest=10**9)
    low = text.lower().split()
    h = {i: pair(low[i - 1], low[i]) for i in range(1, len(low))}
    out, at = [], 0
    for s in whole:
        words = re.findall(r"\S+\s*", s)
        lead = s[:len(s) - len("".join(words))]
        cuts = [0]
        if len(words) > 12:
            cuts += [i - at for i in range(max(at, 1), at + len(words)) if i > at and all(h[i] <= h.get(k, h[i]) for k in range(i - 3, i + 4))]
        own = ["".join(words[a:b]) for a, b in zip(cuts, [*cuts[1:], len(words)])]
        own[0] = lead + own[0]
        out += own
        at += len(words)
    return out


def spans(p):
    size = [len(x.split()) for x in p]
    out = []
    for i in range(len(p)):
        j = i
        while j < len(p) and (j < i + 3 or sum(size[i:j]) < 40):
            j += 1
        if j - i >= 3 and sum(size[i:j]) >= 40:
            out.append((i, j))
    return out or [(0, len(p))] * bool(p)


def plain(rows):
    first, want = {}, {}
    cut = {i: pieces(t) for i, t in rows}
    of = {i: [(a, b, " ".join(" ".join(p[a:b]).lower().split())) for a, b in spans(p)] for i, p in cut.items()}
    for i, _ in rows:
        for a, _, s in of[i]:
            first.setdefault(s, (i, a))
    for i, t in rows:
        gone = {k for a, b, s in of[i] if first[s] != (i, a) for k in range(a, b)}
        want[i] = (len(cut[i]), len(gone), "".join(x for k, x in enumerate(cut[i]) if k not in gone).rstrip() if gone else t)
    return want


def as_rows(df):
    return {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in df.collect()}


def run(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return as_rows(QUERIES["op4_sentence_span_dedup"](spark, str(path)))


def test_pieces_are_the_text(spark):
    for t in spark.read.parquet(f"{SF}/documents.parquet").toPandas().text:
        assert "".join(sentences(t)) == t and [x for x in sentences(t)] == pieces(t)


def test_every_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")
    want = plain(list(zip(docs.doc_id, docs.text)))
    assert as_rows(QUERIES["op4_sentence_span_dedup"](spark, SF)) == want and any(n for _, n, _ in want.values())


def test_repeated_dialogue_of_short_lines_goes(spark, tmp_path):
    dialogue = "".join(f"Line {i}.\nYes {i}.\n" for i in range(40))
    rows = [(1, "An opening of its own.\n" + dialogue), (2, "Another opening.\n" + dialogue + "Another end.")]
    got = run(spark, rows, tmp_path)
    assert got == plain(rows) and got[2] == (82, 80, "Another opening.\nAnother end.")


def test_long_text_without_stops_and_short_formulas(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = " ".join(word() for _ in range(120))
    formula = "Yes, sir. No, sir. Very well. "
    rows = [(1, " ".join(word() for _ in range(60)) + " " + passage), (2, formula + " ".join(word() for _ in range(70)) + " " + passage + " tail words"),
            (3, formula + " ".join(word() for _ in range(90)))]
    got = run(spark, rows, tmp_path)
    assert got == plain(rows)
    left = got[2][2].split()
    assert sum(w in left for w in passage.split()) < 30   # all but the ends of the passage
    assert got[3][1] == 0                                 # a formula is not a passage
