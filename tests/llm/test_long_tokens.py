"""op9 on very long tokens and very many matches; its models against a plain computation."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from marketflow.llm import secrets
from marketflow.llm.secrets import ACCESS, ASSIGN, BACKOFF, HEX, MIN_RATIO, TOKEN

LABELLED = [("kX9fQ2zL8vB3nM7pR1tY", 1), ("a8f3c9e1b7d2046f9a8b", 1), ("customer_identifier_name", 0), ("another_plain_word", 0)]


def plain_ratio(labelled):
    """log P(b|a) of random strings less that of identifiers: pairs, smoothed towards single characters, towards uniform."""
    p = {}
    for y in (0, 1):
        pairs = [(a, b) for t, label in labelled if label == y for a, b in zip(t, t[1:])]
        pair, first, second = {}, {}, {}
        for a, b in pairs:
            pair[a, b] = pair.get((a, b), 0) + 1
            first[a] = first.get(a, 0) + 1
            second[b] = second.get(b, 0) + 1
        p[y] = lambda a, b, pair=pair, first=first, second=second, n=len(pairs): math.log(
            (pair.get((a, b), 0) + BACKOFF * (second.get(b, 0) + 0.5) / (n + 64)) / (first.get(a, 0) + BACKOFF))
    return lambda t: sum(p[1](a, b) - p[0](a, b) for a, b in zip(t, t[1:]))


def plain_spans(text, ratio):
    base = []
    for k, (kind, pattern) in enumerate((("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))):
        for m in re.finditer(pattern, text):
            if kind != "assign" or len(m[1]) >= 6:
                base.append((m.start(), k, m.end(), kind))
    more = [(m.start(), 3, m.end(), "random") for m in re.finditer(TOKEN, text)
            if not any(b[0] < m.end() and m.start() < b[2] for b in base) and ratio(m[0]) >= MIN_RATIO]
    return sorted(base + more)


@pytest.fixture(scope="module")
def model(spark):
    return secrets.markov_ratio(spark.createDataFrame(LABELLED, "token string, label int")).cache()


def listed(found):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)


def test_spans_of_the_models_match_plain_markov(spark, model):
    rng, ratio = random.Random(3), plain_ratio(LABELLED)
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            parts.append(rng.choice([
                "plain words here", "été", "".join(rng.choices("kX9fQ2zL8vB3nM7pR1tYa8f3c", k=rng.randint(15, 60))),
                "customer_identifier_name_plain", "password = " + "".join(rng.choices("abcXYZ019", k=rng.randint(3, 30))),
                "AKIA" + "".join(rng.choices("ABCDEF012", k=18)), "".join(rng.choices("0123456789abcdef", k=30))]))
        rows.append((i, rng.choice([" ", "", "\n", "-"]).join(parts)))
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    want = {i: listed(plain_spans(t, ratio)) for i, t in rows}
    assert got == want and any("random" in v for v in want.values()) and any("assign" in v for v in want.values())
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    red = {r.doc_id: r.t for r in secrets.with_spans(texts, model).select("doc_id", secrets.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    for i, t in rows:
        out, at = "", 0
        for a, _, b, _ in plain_spans(t, ratio):
            if a >= at:
                out += t[at:a] + "[REDACTED]"
            at = max(at, b)
        assert red[i] == out + t[at:]


def test_a_token_of_a_million_characters(spark, model):
    token = "".join(random.Random(1).choices("kX9fQ2zL8vB3nM7pR1tY", k=1_000_000))
    frame = spark.createDataFrame([(1, f"début {token} end")], "doc_id long, text string")
    began = time.time()
    assert secrets.scan(frame, model).first().spans == "random:6:1000006"
    assert secrets.train(frame).count() == 1
    assert time.time() - began < 60


def test_a_hundred_thousand_matches(spark, model):
    one = "token=abcdef123456 kX9fQ2zL8vB3nM7pR1tYkX9f "
    frame = spark.createDataFrame([(1, one * 100_000)], "doc_id long, text string")
    began = time.time()
    row = secrets.scan(frame, model).first()
    assert row.n_assign == 100_000 and row.spans.count("random") == 100_000
    assert row.spans.endswith(f"assign:{len(one) * 99_999}:{len(one) * 99_999 + 18},random:{len(one) * 99_999 + 19}:{len(one) * 100_000 - 1}")
    red = secrets.with_spans(frame, model).select(secrets.redacted(F.col("text"), F.col("spans")).alias("t")).first().t
    assert red == "[REDACTED] [REDACTED] " * 100_000
    assert time.time() - began < 90
