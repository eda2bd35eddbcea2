"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Texts are folded first: lower case, homoglyphs to Latin letters, and digits or
symbols that stand for letters inside a word.  The lexicon with its weights, the
exception phrases (a listed word with a neighbour that makes it harmless) and the
calibration are fitted on at most ``fit_rows`` labelled rows, those with the
smallest hashes of their ids; every document is scored, over its whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from marketflow.llm.common import checkpointed

#: Toxic training documents a term must occur in, and its least log-likelihood ratio.
MIN_DOCS = 4
MIN_G2 = 22.0
#: Least log odds of a term: toxic over clean document rate.
MIN_WEIGHT = 1.5
#: Labelled rows that the classifier is fitted on at most (the smallest hashes of their ids).
FIT_ROWS = 50_000
THRESHOLD = 0.7
#: Words added to a text's length, so that one hit in a tiny text is not a rate of 1.
PRIOR_WORDS = 20

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "п": "n", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ս": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o",
}
# Digits and symbols written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}

_WIDE = {chr(0xFEE0 + i): chr(i).lower() for i in range(0x21, 0x7F)}
_UNSEEN = "­​‌‍⁠﻿"
_TABLE = str.maketrans(HOMOGLYPHS | _WIDE | dict.fromkeys(_UNSEEN))
_ODD = re.compile("[" + "".join(HOMOGLYPHS) + _UNSEEN + "！-～]")
_MARK = str.maketrans(SUBSTITUTES)
#: Substitutes count as letters before a letter, digits also after one at the end of a word.
_STAND_IN = re.compile(r"[01345789@$!]+(?=[^\W\d_])|(?<=[^\W\d_])[01345789]+(?!\w)")
_WORD = re.compile(r"[^\W_]+")
#: Characters between a word and its neighbour, at most.
_GAP = 60


def fold(text: str | None) -> str:
    t = (text or "").lower()
    if _ODD.search(t):
        t = t.translate(_TABLE)
    return _STAND_IN.sub(lambda m: m.group().translate(_MARK), t)


def words_of(folded: str) -> list[str]:
    return _WORD.findall(folded)


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    coef: tuple[float, ...] = (-4.0, 1.0, 1.0)
    _auto: object = None

    def __getstate__(self):
        return self.__dict__ | {"_auto": None}  # every worker builds its own automaton

    def hits(self, folded: str) -> list[tuple[str, str, str]]:
        """(term, word before, word after) of every whole-word match."""
        if self._auto is None:
            self._auto = ahocorasick.Automaton()
            for t in self.weights:
                self._auto.add_word(t, t)
            if self.weights:
                self._auto.make_automaton()
        out = []
        if not self.weights:
            return out
        n = len(folded)
        for last, term in self._auto.iter(folded):
            first = last - len(term) + 1
            if (first and folded[first - 1].isalnum()) or (last + 1 < n and folded[last + 1].isalnum()):
                continue
            out.append((term, _neighbour(folded, first, -1), _neighbour(folded, last + 1, 1)))
        return out

    def phrases(self, folded: str) -> set[str]:
        """Each hit with its neighbour on either side: what may become an exception."""
        return {p for t, a, b in self.hits(folded) for p in ((f"{a} {t}" if a else None), (f"{t} {b}" if b else None)) if p}

    def features(self, folded: str) -> tuple[float, float]:
        """(evidence, evidence by length): sums of the weights of hits that no exception phrase excuses."""
        w = sum(self.weights[t] for t, a, b in self.hits(folded)
                if f"{a} {t}" not in self.exceptions and f"{t} {b}" not in self.exceptions)
        if not w:
            return 0.0, 0.0
        return math.log1p(w), math.log1p(100 * w / (len(words_of(folded)) + PRIOR_WORDS))

    def score(self, text: str | None) -> float:
        a, b = self.features(fold(text))
        z = self.coef[0] + self.coef[1] * a + self.coef[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _neighbour(text: str, at: int, step: int) -> str:
    """The whole word before (step -1) or from (step 1) position ``at``, if not more than _GAP other characters lie between."""
    if step > 0:
        m = _WORD.search(text, at, at + _GAP + 1)
        return _WORD.match(text, m.start()).group() if m else ""
    end = at
    while end > 0 and at - end <= _GAP and not _WORD.match(text, end - 1, end):
        end -= 1
    first = end
    while first > 0 and _WORD.match(text, first - 1, first):
        first -= 1
    return text[first:end] if at - end <= _GAP else ""


def _word_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, clean): documents of each class that hold the folded word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def flush():
            keys = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in reversed(seen))],
                ["word", "toxic", "clean"])
            for c in seen:
                c.clear()
            return out

        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[int(label == 1)].update(set(words_of(fold(text))))
            if len(seen[0]) > 300_000:
                yield flush()
        yield flush()

    return (rows.select("text", "label").mapInArrow(run, "word string, toxic long, clean long")
            .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def _g2(a: Column, b: Column, na: float, nb: float) -> Column:
    """Log-likelihood ratio of a word in ``a`` of na toxic and ``b`` of nb clean documents."""
    def term(k, e):
        return F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    rate = (a + b) / F.lit(float(na + nb))
    none = lambda k, n: term(F.lit(float(n)) - k, F.lit(float(n)) * (1 - rate))
    return 2 * (term(a, rate * na) + term(b, rate * nb) + none(a, na) + none(b, nb))


def training_rows(docs: DataFrame, labels: DataFrame, held_out: Column | None = None,
                  fit_rows: int = FIT_ROWS) -> DataFrame:
    """(text, label) of at most ``fit_rows`` documents with a toxic label of 0 or 1 that are not held out.

    ``held_out`` is an expression over ``doc_id``.  The sample of ids is bounded, so it is broadcast.
    """
    y = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("label"))
    if held_out is not None:
        y = y.where(~held_out)
    y = y.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(fit_rows).withColumnRenamed("doc_id", "labelled")
    d = docs.select(F.col("doc_id").alias("id"), "text")
    return d.join(F.broadcast(y), F.col("id") == F.col("labelled")).select("text", "label")


def train(texts: DataFrame, fit_rows: int = FIT_ROWS) -> Lexicon:
    """Learn the lexicon from (text, label 0/1), as ``training_rows`` gives them; equal texts of one label count once.

    At most ``fit_rows`` texts are learnt from (the smallest hashes), which bounds the lexicon: a term is a word of at least
    MIN_DOCS of them, an exception a phrase of at least three.

    Rows with null text are left out.  Without a class the lexicon is empty and every score the same.
    """
    # A copied document would make each of its words look like a term.
    rows = texts.where("text IS NOT NULL").select("text", "label", F.xxhash64("text").alias("key"))
    rows = checkpointed(rows.groupBy("key", "label").agg(F.first("text").alias("text")))
    count = lambda: {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = count()
    if sum(n.values()) > fit_rows:  # an id may stand for many texts; only keys are sorted, the texts stay where they are
        first = rows.select("key", "label").orderBy("key", "label").limit(fit_rows)
        rows = checkpointed(rows.join(F.broadcast(first), ["key", "label"], "left_semi"))
        n = count()
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return Lexicon({}, coef=(math.log((pos + 0.5) / (neg + 0.5)), 0.0, 0.0))
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    weight = F.log((a + 0.5) / (pos + 1.0)) - F.log((b + 0.5) / (neg + 1.0))
    terms = (_word_counts(rows).where((F.col("toxic") >= MIN_DOCS) & (F.length("word") >= 3))
             .select("word", weight.alias("w"), _g2(a, b, pos, neg).alias("g2"))
             .where((F.col("w") > MIN_WEIGHT) & (F.col("g2") >= MIN_G2))
             .collect())
    lex = Lexicon({r["word"]: r["w"] for r in terms})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [(p, y) for s, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for p in lex.phrases(fold(s))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in flat], pa.string()),
                                              pa.array([y for _, y in flat], pa.int32())], ["phrase", "label"])

    phrases = (rows.select("text", "label").mapInArrow(run, "phrase string, label int").groupBy("phrase")
               .agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
               .where((F.col("clean") >= 3) & (F.col("clean") * F.lit(pos) >= 4 * (F.col("toxic") + 1) * F.lit(neg)))
               .collect())
    lex.exceptions = {r["phrase"] for r in phrases}

    @pandas_udf("a double, b double")
    def features(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([lex.features(fold(t)) for t in text], columns=["a", "b"], dtype=float)

    sample = rows.select("label", features("text").alias("f")).select("label", "f.a", "f.b").toPandas()
    lex.coef = _logistic(sample[["a", "b"]].to_numpy(), sample["label"].to_numpy())
    return lex


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; evidence can only raise a score."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.array([-2.0, 0.5, 0.5])
    penalty = np.diag([1e-3, ridge, ridge])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - y) + penalty @ w), -2, 2)
        w[1:] = np.maximum(w[1:], 0)
    return tuple(float(v) for v in w)


def scorer(lex: Lexicon):
    """Column function: score of a text, 0 to 1 (null like empty)."""
    @pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([lex.score(t) for t in text], dtype=float)
    return score
