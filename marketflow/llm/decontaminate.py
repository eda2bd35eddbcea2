"""Benchmark decontamination by spaced seeds.

A mask names the token positions of a window that are hashed; the others are
ignored, so a substituted token leaves some windows intact.  The masks are all
choices of four tokens within six: ten agreeing tokens or more that are 60 % of
their stretch always hold four within six, so no overlap that the thresholds
accept goes unproposed.  Hashes of benchmark items and of documents meet in an equality join.  A hit fixes how item and
document are aligned; the document's tokens around it, carried along with the
hit, are compared with the item's token by token.

Before the join, document windows are tested against a bitmap of the benchmark's
hashes.  Its size is a parameter, so the broadcast does not grow; a fuller bitmap
only lets more rows through to the join, which decides exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from marketflow.llm.common import Rolling, checkpointed, mix64

# 1 = the token counts, 0 = it is ignored.  Every choice of four tokens within six; sparser sets, or
# thresholds below the following ones, lose overlaps.
MASKS = ("1111", "11101", "11011", "10111", "111001", "110101", "110011", "101101", "101011", "100111")
#: A document is contaminated by an item when, in some stretch of one alignment, this many tokens agree,
#: they are this share of the item, and this share of the stretch.
MIN_TOKENS = 10
MIN_COVERAGE = 0.5
MIN_IDENTITY = 0.6
#: Bits of the prefilter bitmap (2 MB).
BITMAP_BITS = 1 << 24

_WORDY = np.zeros(256, bool)
_WORDY[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def token_hashes(text: str | None) -> np.ndarray:
    """A hash of every token: maximal runs of letters and digits of the lower-cased text (other scripts included)."""
    buf = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    wordy = np.concatenate([[False], _WORDY[buf], [False]])
    edge = np.flatnonzero(wordy[1:] != wordy[:-1])
    if not len(edge):
        return np.zeros(0, np.uint64)
    return Rolling(buf).of(edge[::2], edge[1::2])


@lru_cache(maxsize=None)
def _odd(n: int, salt: int) -> np.ndarray:
    return np.random.default_rng(salt).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _window_hashes(tokens: np.ndarray, offsets: list[int], span: int, salt: int) -> np.ndarray:
    n = len(tokens) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    odd = _odd(len(offsets), salt)
    h = np.full(n, salt, np.uint64)
    for o, c in zip(offsets, odd):
        h += tokens[o:o + n] * c
    return mix64(h)


def _seeds(short: tuple[int, ...], masks=MASKS) -> list[tuple[list[int], int, int]]:
    """(offsets, span, salt) of each mask, and a full window for each length of items shorter than all masks."""
    out = [([i for i, c in enumerate(m) if c == "1"], len(m), k + 1) for k, m in enumerate(masks)]
    return out + [(list(range(n)), n, 1000 + n) for n in short]


def _item_windows(items: DataFrame, short: tuple[int, ...], masks) -> DataFrame:
    least = min(map(len, masks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = np.array(tokens, np.int64).view(np.uint64)
                for offsets, span, salt in _seeds(short, masks):
                    if salt >= 1000 and len(t) != span or salt < 1000 and len(t) < least:
                        continue
                    rows += [(h, item, p) for p, h in enumerate(_window_hashes(t, offsets, span, salt).view(np.int64).tolist())]
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                              pa.array(cols[2], pa.int32())], ["hash", "item", "item_pos"])

    return items.select("item", "item_tokens").mapInArrow(run, "hash long, item long, item_pos int")


def _bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """Bit set of all hashes, two bits each; gathered as one word per 64 bits, so at most ``bits / 64`` rows."""
    both = F.array(F.pmod("hash", F.lit(bits)), F.pmod(F.shiftright("hash", 32), F.lit(bits)))
    words = (windows.select(F.explode(both).alias("s")).groupBy((F.col("s") / 64).cast("long").alias("w"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("s") % 64).cast("int"))).alias("b")))
    got = words.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return out


def _passes(filled: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of the hashes that have both their bits set."""
    def is_set(s: np.ndarray) -> np.ndarray:
        return (filled[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1)

    h = hashes.view(np.int64)
    at = np.flatnonzero(is_set(h % bits))
    return at[np.flatnonzero(is_set((h[at] >> 32) % bits))]


def _doc_hits(docs: DataFrame, bitmap, reach: int, short: tuple[int, ...], masks, bits: int) -> DataFrame:
    """(hash, doc, pos, from, tokens): windows that pass the bitmap, with the tokens of ``reach`` positions around."""
    id_type = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, ways = bitmap.value, _seeds(short, masks)
        for b in batches:
            ids, seeds, stretches = [], [], []
            for doc, text in zip(b.column(0), b.column(1).to_pylist()):
                t = token_hashes(text)
                pos, hashes = [], []
                for way in ways:
                    h = _window_hashes(t, *way)
                    at = _passes(filled, h, bits)
                    pos.append(at)
                    hashes.append(h[at].view(np.int64))
                pos, hashes = np.concatenate(pos), np.concatenate(hashes)
                if not len(pos):
                    continue
                order = np.argsort(pos, kind="stable")
                pos, hashes = pos[order], hashes[order]
                # Hits that lie close share one stretch of tokens.
                for group in np.split(np.arange(len(pos)), np.flatnonzero(np.diff(pos) > reach) + 1):
                    lo = max(0, int(pos[group[0]]) - reach)
                    hi = int(pos[group[-1]]) + reach
                    ids.append(doc)
                    seeds.append([{"hash": int(hashes[g]), "at": int(pos[g]) - lo} for g in group])
                    stretches.append(t[lo:hi].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.schema.field(0).type), pa.array(seeds, pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())]))),
                 pa.array(stretches, pa.list_(pa.int64()))], ["doc", "seeds", "tokens"])

    return docs.select("doc", "text").mapInArrow(
        run, f"doc {id_type}, seeds array<struct<hash:bigint,at:int>>, tokens array<bigint>")


def _best_stretch(same: np.ndarray, min_identity: float) -> tuple[int, int]:
    """Most agreeing tokens of a stretch in which they are ``min_identity`` of all tokens, and its length.

    ``same`` has the places of all agreeing tokens in order; a stretch runs from one of them to another.
    """
    if not len(same):
        return 0, 0
    n = np.arange(len(same))
    begin = n - min_identity * same  # a stretch from i to j is dense enough when begin[i] <= end[j]
    end = n + 1 - min_identity * (same + 1)
    least = np.minimum.accumulate(begin)
    first = len(n) - np.searchsorted(least[::-1], end + 1e-9, side="right")  # the farthest i for each j
    j = int(np.argmax(n - first))
    i = int(first[j])
    return (j - i + 1, int(same[j] - same[i]) + 1) if i <= j else (0, 0)


def _compare(doc: pd.Series, item: pd.Series, offset: pd.Series, min_identity: float) -> pd.DataFrame:
    """Agreeing tokens of the best stretch on one alignment, its length, and the item's size."""
    out = []
    for d, t, o in zip(doc, item, offset):
        a, b = max(0, o), min(len(d), o + len(t))
        same = np.flatnonzero(np.asarray(d[a:b]) == np.asarray(t[a - o:b - o]))
        out.append((*_best_stretch(same, min_identity), len(t)))
    return pd.DataFrame(out, columns=["matched", "stretch", "size"], dtype="int32")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS, min_coverage: float = MIN_COVERAGE,
                 min_identity: float = MIN_IDENTITY, masks=MASKS, bits: int = BITMAP_BITS, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, matched, item_tokens, coverage): pairs of which a stretch passes the three thresholds.

    An item shorter than ``min_tokens`` has to agree in all its tokens.  Null and empty texts hold no token and match
    nothing; null ids are kept as they are; repeated documents and items count once.  Empty tables give an empty result.
    """
    @pandas_udf("matched int, stretch int, size int")
    def compare(doc: pd.Series, item: pd.Series, offset: pd.Series) -> pd.DataFrame:
        return _compare(doc, item, offset, min_identity)

    @pandas_udf("array<bigint>")
    def tokens_of(text: pd.Series) -> pd.Series:
        return pd.Series([token_hashes(t).view(np.int64) for t in text])

    # A number for each item, so that ids of any type and null ids do.
    items = checkpointed(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
                         .select("item_id", tokens_of("text").alias("item_tokens"), F.monotonically_increasing_id().alias("item"))
                         .where(F.size("item_tokens") > 0))
    size = F.size("item_tokens")
    least = min(map(len, masks))
    facts = items.agg(F.max(size).alias("most"), F.collect_set(F.when(size < least, size)).alias("short")).first()
    short = tuple(sorted(facts["short"]))  # fewer lengths than the shortest mask
    reach = max(facts["most"] or 0, max(map(len, masks)))
    windows = checkpointed(_item_windows(items, short, masks))
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(windows, bits))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    hits = (_doc_hits(rows, bitmap, reach, short, masks, bits)
            .withColumn("no", F.monotonically_increasing_id()))
    hits = checkpointed(hits)
    seeds = hits.select("no", F.explode("seeds").alias("s")).select("no", "s.hash", "s.at")
    ways = (seeds.join(windows, "hash").select("no", "item", (F.col("at") - F.col("item_pos")).alias("offset")).distinct()
            .join(items.select("item", size.alias("n")), "item"))
    # A way takes along the tokens that the item can lie on, not the whole stretch: a repetitive text has very many ways.
    begin, behind = F.greatest(F.col("offset"), F.lit(0)), F.least(F.col("offset"), F.lit(0))
    near = F.slice("tokens", begin + 1, F.greatest(F.col("n") + behind, F.lit(0)))
    found = (ways.join(hits.select("no", "doc", "tokens"), "no").select("doc", "item", near.alias("near"), behind.alias("offset")).join(items, "item")
             .select("doc", "item_id", compare("near", "item_tokens", "offset").alias("c"))
             .select("doc", "item_id", "c.*"))
    need = F.least(F.lit(min_tokens), F.col("size"))
    passed = found.where((F.col("matched") >= need) & (F.col("matched") >= F.lit(min_coverage) * F.col("size"))
                         & (F.col("matched") > 0))
    best = passed.groupBy("doc", "item_id").agg(F.max(F.struct("matched", "size")).alias("b"))
    return best.select(F.col("doc").alias("doc_id"), "item_id", F.col("b.matched").alias("matched"),
                       F.col("b.size").alias("item_tokens"), (F.col("b.matched") / F.col("b.size")).alias("coverage"))
