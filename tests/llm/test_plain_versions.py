"""op2, op10 and op3 against plain computations of the same rules."""

import math
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marketflow.llm import language, toxicity
from marketflow.llm.decontaminate import contaminated

SF = "/root/testdata/sf0.01"


def plain_score(lex, text):
    """Every term at every place of the folded text, word by word."""
    folded = toxicity.fold(text)
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", folded)]
    total = 0.0
    for term, weight in lex.weights.items():
        at = folded.find(term)
        while at >= 0:
            end = at + len(term)
            whole = not (at and folded[at - 1].isalnum()) and not (end < len(folded) and folded[end].isalnum())
            if whole:
                left = [s for s in spans if s[1] <= at and at - s[1] <= 60]
                right = [s for s in spans if s[0] >= end and s[0] - end <= 60]
                before = folded[slice(*left[-1])] if left else ""
                after = folded[slice(*right[0])] if right else ""
                if f"{before} {term}" not in lex.exceptions and f"{term} {after}" not in lex.exceptions:
                    total += weight
            at = folded.find(term, at + 1)
    a, b = (math.log1p(total), math.log1p(100 * total / (len(spans) + toxicity.PRIOR_WORDS))) if total else (0.0, 0.0)
    return 1 / (1 + math.exp(-max(-30, min(30, lex.coef[0] + lex.coef[1] * a + lex.coef[2] * b))))


def test_toxicity_equals_a_plain_scorer(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    lex = toxicity.train(toxicity.training_rows(docs, labels))
    lex.exceptions |= {f"{a} {t}" for t in list(lex.weights)[:9] for a in ("of", "the", "and")} | {f"{next(iter(lex.weights))} end"}
    got = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.scorer(lex)("text").alias("s")).collect()}
    texts = pd.read_parquet(f"{SF}/documents.parquet")
    some = [*list(zip(texts.doc_id, texts.text))[::7]]
    for i, t in some:
        assert abs(got[i] - plain_score(lex, t)) < 1e-12
    term, phrase = next(iter(lex.weights)), f"{next(iter(lex.weights))} end"
    long = "x" * 500
    odd = [f"{term} {long}", f"{long} {term}", f"{term}{'-' * 70}{term}", phrase, phrase.replace(" ", " " * 59), phrase.replace(" ", " " * 62), f"_{term}_ {term.upper()}!", ""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, text string")
    for r in frame.select("i", "text", toxicity.scorer(lex)("text").alias("s")).collect():
        assert abs(r.s - plain_score(lex, r.text)) < 1e-12


def test_repeated_ids_do_not_pass_the_bound(spark):
    rows = [(1, f"bad{k % 50} words {k}") for k in range(400)] + [(2, f"good words {k}") for k in range(400)]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    texts = toxicity.training_rows(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert texts.count() == 800
    lex = toxicity.train(texts, fit_rows=60)
    assert all(sum(w in t for _, t in rows) >= toxicity.MIN_DOCS for w in lex.weights)


def plain_proportions(model, text):
    """The same expectation maximisation, trigram by trigram."""
    grams = language.trigrams(text).tolist()
    if not grams:
        return {}

    def mixed(keep):
        prior = np.array([model.prior[k] for k in keep]) if len(keep) == len(model.langs) else np.array([model.prior[k] for k in keep]) / sum(model.prior[k] for k in keep)
        share = [1 / len(keep)] * len(keep)
        for _ in range(language.ROUNDS):
            now = [language.PRIOR * p for p in prior]
            for g in grams:
                p = [s * math.exp(model.log_p[k, g]) for s, k in zip(share, keep)]
                whole = sum(p)
                now = [n + x / whole for n, x in zip(now, p)]
            now = [n / (len(grams) + language.PRIOR) for n in now]
            done = max(abs(a - b) for a, b in zip(now, share)) < 1e-4
            share = now
            if done:
                break
        return share, sum(math.log(sum(s * math.exp(model.log_p[k, g]) for s, k in zip(share, keep))) for g in grams)

    keep = list(range(len(model.langs)))
    share, fit = mixed(keep)
    cost = language.PENALTY[0] * len(grams) + language.PENALTY[1] * math.log(len(grams) + 1)
    while len(keep) > 1:
        weak = min(range(len(keep)), key=lambda i: share[i])
        rest = keep[:weak] + keep[weak + 1:]
        other, worse = mixed(rest)
        if worse + cost < fit:
            break
        keep, share, fit = rest, other, worse
    return {model.langs[k]: s for k, s in zip(keep, share)}


def test_language_mixtures_equal_plain_em(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    texts = pd.read_parquet(f"{SF}/documents.parquet")
    by_lang = [g.text.iloc[0] for _, g in texts.groupby("lang")]
    rng = random.Random(2)
    some = [t for t in texts.text[::90] if len(t) < 4000] + [" ".join(x[:300] for x in rng.sample(by_lang, 2)) for _ in range(4)] + ["", "12 !", "a", None]
    for t in some:
        got, want = model.proportions(t), plain_proportions(model, t)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert any(len(model.proportions(t)) > 1 for t in some)


def test_long_repetitive_texts_are_aligned_everywhere(spark):
    item = " ".join(f"w{k % 3}" for k in range(40)) + " tail of the item in other words than those"
    rows = [(1, "w0 w1 w2 " * 3000), (2, "w0 w1 w2 " * 3000 + item.split(" ", 1)[1]), (3, "x " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).select("doc_id", "matched").collect()
    assert {r.doc_id: r.matched for r in got} == {1: 40, 2: 48}  # the first token of the item stands beside another one
    assert docs.where(F.length("text") > 20_000).count() == 2
