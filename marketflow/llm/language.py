"""Language identification by mixtures of n-gram models.

Each language is a multinomial over hashed character trigrams, counted over all
training documents.  A document is a mixture of languages: expectation
maximisation estimates the proportions from its trigrams' likelihoods, and the
set of languages is the one with the best penalised likelihood, found by
dropping the weakest language while that pays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Trigram bins: 16-bit hashes.  Bounds the model at this many numbers a language.
BINS = 1 << 16
SMOOTHING = 0.5
ROUNDS = 25
#: A further language has to gain this many nats a trigram, and this many times ln(trigrams).
PENALTY = (0.02, 3.0)
#: Pseudo-trigrams spread by the languages' frequency, which decide texts without evidence.
PRIOR = 1.0
UNKNOWN = "und"

_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER[97]:
        _LETTER[:] = [chr(i).isalpha() for i in range(0x110000)]
    return _LETTER


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams (uint16) of the lower-cased text around every letter; anything but a letter counts as a gap."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return np.zeros(0, np.uint16)
    c = np.zeros(len(code) + 2, np.uint32)
    c[1:-1] = np.where(letter, code, 0)
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h[letter] >> np.uint32(16)).astype(np.uint16)


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # languages x bins
    prior: np.ndarray

    def _mix(self, log_p: np.ndarray, n: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions by expectation maximisation, and the log-likelihood."""
        top = log_p.max(axis=0)
        p = np.exp(log_p - top)
        share = np.full(len(p), 1 / len(p))
        total = n.sum()
        for _ in range(ROUNDS):
            given = share[:, None] * p
            now = given @ (n / given.sum(axis=0))  # responsibilities, summed over trigrams
            now = (now + PRIOR * prior) / (total + PRIOR)
            done = np.abs(now - share).max() < 1e-4
            share = now
            if done:
                break
        return share, float(n @ (np.log(share @ p) + top))

    def proportions(self, text: str | None) -> dict[str, float]:
        """The chosen languages and their proportions, largest first; empty for texts without a letter."""
        if not self.langs:
            return {}
        bins, n = np.unique(trigrams(text), return_counts=True)
        if not len(bins):
            return {}
        n = n.astype(float)
        log_p = self.log_p[:, bins]
        cost = PENALTY[0] * n.sum() + PENALTY[1] * np.log(n.sum() + 1)
        keep = np.arange(len(self.langs))
        share, fit = self._mix(log_p, n, self.prior)
        while len(keep) > 1:
            rest = np.delete(np.arange(len(keep)), int(np.argmin(share)))
            prior = self.prior[keep[rest]]
            other, worse = self._mix(log_p[keep[rest]], n, prior / prior.sum())
            if worse + cost < fit:
                break
            keep, share, fit = keep[rest], other, worse
        order = np.lexsort((keep, -share))
        return {self.langs[keep[i]]: float(share[i]) for i in order}


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count trigrams per language over all rows with a text and a language; one row per language and bin reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = counts.setdefault(lang, np.zeros(BINS, np.int64))
                rows[lang] = rows.get(lang, 0) + 1
                bins, n = np.unique(trigrams(text), return_counts=True)
                got[bins] += n
        for lang, got in counts.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1).astype(np.int32)),
                 pa.array(np.append(got[at], rows[lang]))], ["lang", "bin", "n"])

    used = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    got = (used.mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow())
    langs, at = np.unique(np.array(got["lang"].to_pylist(), dtype=object), return_inverse=True) if len(got) else ([], [])
    bins, n = got["bin"].to_numpy(), got["n"].to_numpy()
    counts, rows = np.zeros((len(langs), BINS)), np.zeros(len(langs))
    seen = bins >= 0
    if len(got):
        counts[at[seen], bins[seen]] = n[seen]
        rows[at[~seen]] = n[~seen]
    p = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BINS)
    return Model(list(langs), np.log(p), rows / max(1, rows.sum()))


def predictor(spark, model: Model):
    """Column function: struct(lang_pred, score, languages) of a text.

    The model has BINS numbers a language, whatever the corpus; it is broadcast.
    """
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("lang_pred string, score double, languages string")
    def predict(text: pd.Series) -> pd.DataFrame:
        out = []
        for t in text:
            p = shared.value.proportions(t)
            first = next(iter(p), UNKNOWN)
            out.append((first, min(1.0, p.get(first, 0.0)), ",".join(f"{k}:{v:.3f}" for k, v in p.items())))
        return pd.DataFrame(out, columns=["lang_pred", "score", "languages"])

    return predict


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, languages (chosen languages with proportions).

    Models are trained on rows that are not held out and have text and language.  Null texts and texts without a letter
    get ``und`` and score 0, as does every text when there is nothing to learn from; ties go to the smaller name.
    """
    model = train(docs.where(~held_out), text_col, lang_col)
    predict = predictor(docs.sparkSession, model)
    return (docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), predict(F.col(text_col)).alias("p"))
            .select("doc_id", "held_out", "p.*"))
