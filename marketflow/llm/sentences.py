"""Substring deduplication by sliding sentence spans.

Every run of ``span`` consecutive sentences is hashed, from each sentence on; a run of fewer than ``min_words`` words
goes on until it has them, so that formulas of a few words do not count as a passage.  A sentence of more than
``longest`` words is cut before the words whose pair with the word before has the least hash among its neighbours: the same passage
is cut at the same places wherever it stands, so long text without stops forms runs too.  Hashes meet in a global join;
every occurrence but the first of a repeated span loses the sentences that it covers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.llm.common import POWERS, mix64

SPAN = 3
#: Words that a span holds at least, unless its whole text has fewer.
MIN_WORDS = 40
#: Words of a sentence that is left whole, and how far around a word its hash must be the least to cut before it.
LONGEST = 12
_NEARBY = 3
_ODD, _MOST = np.uint64(0x9E3779B97F4A7C15), np.uint64(2**64 - 1)

_WORD = re.compile(r"\S+")
#: A sentence ends after . ! or ? (with closing marks) before white space, or at a line end; white space goes with it.
_SENTENCE = re.compile(r"""(?:[^.!?\n]++|[.!?]++(?!["')\]]*(?:\s|$)))*+(?:[.!?]+["')\]]*|\n|$)\s*""")


def _sentences(text: str) -> list[str]:
    out = [m for m in _SENTENCE.findall(text) if m]
    while len(out) > 1 and not out[0].strip():
        out[:2] = [out[0] + out[1]]
    return out


class Pieces:
    """A text's sentences, long ones cut, as ranges of its lower-cased words.

    ``begin`` has the first word of each piece, with the number of words at the end.
    """

    def __init__(self, text: str | None, longest: int = LONGEST):
        self.text = text or ""
        self.whole = _sentences(self.text)
        words = self.text.lower().split()
        self.h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        sizes = np.array([len(x.split()) for x in self.whole], np.int64)
        ends = np.cumsum(sizes)
        n = len(words)
        starts = np.zeros(n + 1, bool)
        starts[ends - sizes] = True
        if n and sizes.max() > longest:
            pair = np.full(n + 2 * _NEARBY, _MOST)  # of each word with the one before
            pair[_NEARBY + 1:_NEARBY + n] = mix64(self.h[:-1] * _ODD + self.h[1:])
            least = np.lib.stride_tricks.sliding_window_view(pair, 2 * _NEARBY + 1).min(axis=1)
            own = pair[_NEARBY:_NEARBY + n]
            starts[:n] |= (own == least) & (own < _MOST) & np.repeat(sizes > longest, sizes)
        starts[n] = True
        self.begin = np.flatnonzero(starts) if n else np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.begin) - 1

    def spans(self, span: int, min_words: int) -> np.ndarray:
        """The piece after the last of each span, by the piece that begins it; see :func:`span_hashes`."""
        n = len(self)
        ends = np.maximum(np.arange(n) + span, np.searchsorted(self.begin, self.begin[:-1] + min_words))
        ends = ends[ends <= n]
        return ends if len(ends) else np.full(min(n, 1), n)

    def hashes(self, span: int, min_words: int) -> np.ndarray:
        """Hash of the words of each span, whatever white space is between them."""
        ends = self.spans(span, min_words)
        up, down = POWERS.get(len(self.h) + 1)
        sums = np.zeros(len(self.h) + 1, np.uint64)
        np.cumsum(self.h * up[:-1], out=sums[1:])
        a, b = self.begin[:len(ends)], self.begin[ends]
        return mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)).view(np.int64)

    def strings(self) -> list[str]:
        """The pieces with the white space after them; leading white space is in the first."""
        cuts, out, word = set(self.begin.tolist()), [], 0
        for s in self.whole:
            begin = [m.start() for m in _WORD.finditer(s)]
            at = [0, *(c for k, c in enumerate(begin) if k and word + k in cuts), len(s)]
            out += [s[a:b] for a, b in zip(at, at[1:])]
            word += len(begin)
        return out if word else []


def sentences(text: str | None, longest: int = LONGEST) -> list[str]:
    """Sentences, long ones cut; their concatenation is the text, unless it has no words."""
    return Pieces(text, longest).strings()


def span_hashes(text: str | None, span: int = SPAN, min_words: int = MIN_WORDS, longest: int = LONGEST) -> np.ndarray:
    """Hash of each span, by the sentence that begins it.

    Spans that the text does not fill are left out, but for a text that fills none: it is one span.
    """
    return Pieces(text, longest).hashes(span, min_words)


def _repeats(docs: DataFrame, span: int, min_words: int, longest: int) -> DataFrame:
    """(doc, key, pos) of every span but the first of its hash.

    A batch sends one row a hash to meet the others, its first; the rest of the batch's are repeats whatever comes, and
    travel by document.  So a span of very many documents is a row a batch.
    """
    id_type = docs.schema["doc"].dataType.simpleString()
    names = ["part", "hash", "doc", "key", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            once = list({(d, k): i for i, (d, k) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))}.values())
            b = b.take(pa.array(once, pa.int64()))  # a document that a batch repeats is one
            got = [span_hashes(t, span, min_words, longest) for t in b.column(2).to_pylist()]
            sizes = np.array([len(h) for h in got])
            if not sizes.sum():
                continue
            doc, key = b.column(0), b.column(1).to_numpy()
            h, at = np.concatenate(got), np.repeat(np.arange(len(got)), sizes)
            pos = np.concatenate([np.arange(n) for n in sizes])
            place = np.empty(len(got), np.int64)  # of the documents in their order: null ids last, then text hash
            place[pc.sort_indices(pa.table([doc, b.column(1)], ["d", "k"]), [("d", "ascending"), ("k", "ascending")]).to_numpy()] = np.arange(len(got))
            by = np.lexsort((pos, place[at], h))
            again = np.zeros(len(h), bool)
            again[by[1:]] = h[by[1:]] == h[by[:-1]]
            for i in range(0, len(h), 50_000):
                s = slice(i, i + 50_000)
                rows, sure = pa.array(at[s]), again[s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(sure, key[at[s]] + at[s], h[s])), pa.array(h[s], pa.int64(), mask=sure), doc.take(rows),
                     b.column(1).take(rows), pa.array(pos[s].astype(np.int32))], names)

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first row of the hash that the last batch ended with
        for b in batches:
            if not b.num_rows:
                continue
            skip = 0 if held is None else 1
            t = b if held is None else pa.concat_batches([held, b])
            sure = t.column(1).is_null().to_numpy(zero_copy_only=False)
            h = t.column(1).fill_null(0).to_numpy()
            begins = np.concatenate([[True], (h[1:] != h[:-1]) | sure[:-1]])
            first = np.maximum.accumulate(np.where(begins, np.arange(len(h)), 0))
            doc = pc.dictionary_encode(t.column(2), null_encoding="encode").indices.to_numpy()
            key, pos = t.column(3).to_numpy(), t.column(4).to_numpy()
            other = (doc != doc[first]) | (key != key[first]) | (pos != pos[first])  # not the first span over again
            held = None if sure[-1] else t.slice(int(first[-1]), 1)
            yield pa.RecordBatch.from_arrays([t.column(i) for i in (2, 3, 4)], ["doc", "key", "pos"]).filter(pa.array(sure | other)).slice(
                int((sure | other)[:skip].sum()))

    place = [F.col("hash").asc_nulls_first(), F.col("doc").asc_nulls_last(), "key", "pos"]
    return (docs.mapInArrow(run, f"part long, hash long, doc {id_type}, key long, pos int").repartition("part")
            .sortWithinPartitions(*place).mapInArrow(later, f"doc {id_type}, key long, pos int"))


def dedup_spans(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_sentences, n_removed (pieces of a cut sentence count each), text (what is left, as it stood).

    Of a repeated span the first occurrence stays: smallest doc_id (null last), then text hash, then position; spans are
    judged on the input.  Rows that agree in doc_id and text count as one document.  Null and empty texts have no
    sentences (text stays as it is); a text that loses all its sentences becomes empty.  Long texts are hashed whole, a
    row a sentence.  Not found: repeats of fewer than ``span`` whole sentences or ``min_words`` words inside longer texts.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    repeats = (_repeats(rows, span, min_words, longest).groupBy("doc", "key").agg(F.collect_set("pos").alias("repeats"))
               .select(F.col("doc").alias("d"), F.col("key").alias("k"), "repeats"))

    id_type = rows.schema["doc"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part, out = b.slice(i, 500), []
                for t, r in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    pieces = Pieces(t, longest)
                    if r is None:
                        out.append((len(pieces), 0, t))
                        continue
                    ends, s = pieces.spans(span, min_words), pieces.strings()
                    gone = {k for p in r for k in range(p, ends[p])}
                    out.append((len(s), len(gone), "".join(x for k, x in enumerate(s) if k not in gone).rstrip()))
                cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", "n_sentences", "n_removed", "text"])

    joined = rows.join(repeats, F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return joined.select("doc", "text", "repeats").mapInArrow(cut, f"doc_id {id_type}, n_sentences long, n_removed long, text string")
