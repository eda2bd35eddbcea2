"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments.  Of two fingerprints that
differ in at most two bits, one segment differs in at most one; so the segment
is indexed 32 times, each time with one bit wildcarded, and two fingerprints
that agree on any such signature are candidates, verified on all 64 bits.

Only distinct fingerprints are indexed, so a group of copies of any size is one
row.  Inside a signature bucket the verified links are reduced to a spanning
star before they leave the task, so output is linear in the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.llm.common import checkpointed, popcount
from marketflow.llm.components import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
SEGMENTS = 2
WIDTH = 64 // SEGMENTS
_CHUNK = 1 << 16
#: Rows of one signature bucket that are compared pair by pair; beyond, neighbours are looked up.
_PAIRWISE = 1024


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle (A-Z lower-cased; fewer words: the whole sequence)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[last:last + n].tolist())),
                       np.uint64, n)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in over half the shingle hashes; no words give zero."""
    h = shingle_hashes(text, shingle)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _CHUNK):
        bits = np.unpackbits(h[i:i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp long) per document row; whole texts, null text like empty."""
    schema = docs.select(F.col(id_col).alias("doc_id")).schema
    id_type = schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps)], ["doc_id", "text_key", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("text_key")).mapInArrow(
        run, f"doc_id {id_type}, text_key long, fp long")


def _signatures(fps: DataFrame) -> DataFrame:
    """64 rows (sig, fp) per fingerprint: one per segment and wildcarded bit."""
    k = F.col("k")
    seg, bit = (k / WIDTH).cast("int"), (k % WIDTH).cast("int")
    half = F.when(seg == 1, F.shiftrightunsigned("fp", WIDTH)).otherwise(F.col("fp")).bitwiseAND(F.lit((1 << WIDTH) - 1))
    kept = half.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))
    sig = kept.bitwiseOR(k.cast("long") * F.lit(1 << WIDTH))
    return (fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS * WIDTH - 1))).alias("k"))
            .select(sig.alias("sig"), "fp"))


def _near_masks(bits: int, most: int) -> np.ndarray:
    one = [1 << i for i in range(bits)]
    return np.array([0, *one, *(a | b for i, a in enumerate(one) for b in one[:i] if most > 1)][: None], np.uint64)


def _links(sig: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of row numbers within each run of equal signatures (``sig`` sorted)."""
    a, b = [], []
    change = np.flatnonzero(np.diff(sig)) + 1
    bounds = np.concatenate([[0], change, [len(sig)]])
    length = np.diff(bounds)
    big = length > _PAIRWISE
    run_of = np.repeat(np.arange(len(length)), length)
    rows = np.flatnonzero(~big[run_of])
    end = bounds[1:][run_of]
    step = 1
    while len(rows := rows[rows + step < end[rows]]):
        near = popcount(fp[rows] ^ fp[rows + step]) <= most
        a.append(rows[near])
        b.append(rows[near] + step)
        step += 1
    masks = _near_masks(64, most) if big.any() else None
    for r in np.flatnonzero(big):
        lo, hi = bounds[r], bounds[r + 1]
        order = np.argsort(fp[lo:hi])
        run = fp[lo:hi][order]
        for m in masks[1:]:
            want = run ^ m
            at = np.minimum(np.searchsorted(run, want), len(run) - 1)
            got = np.flatnonzero((run[at] == want) & (want > run))
            a.append(lo + order[got])
            b.append(lo + order[at[got]])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row number reachable from each row."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) that join the distinct fingerprints of ``fps`` within ``max_bits`` into their groups.

    ``max_bits`` may be 0 to 2: beyond, two segments no longer promise one with at most one differing bit.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("two segments with one wildcard find at most two differing bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_sig, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def edges(sig, fp):
            a, b = _links(sig, fp, max_bits)
            label = _stars(len(fp), a, b)
            at = np.flatnonzero(label != np.arange(len(fp)))
            pairs = np.unique(np.stack([fp[at].view(np.int64), fp[label[at]].view(np.int64)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

        for batch in batches:
            sig = np.concatenate([held_sig, batch.column(0).to_numpy()])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy().view(np.uint64)])
            if not len(sig):
                continue
            cut = np.searchsorted(sig, sig[-1])  # the last run may go on in the next batch
            held_sig, held_fp = sig[cut:], fp[cut:]
            if cut:
                yield edges(sig[:cut], fp[:cut])
        if len(held_sig):
            yield edges(held_sig, held_fp)

    return (_signatures(fps.select("fp")).repartition("sig").sortWithinPartitions("sig")
            .mapInArrow(run, "u long, v long"))


def classes(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
            id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text_key, fp) and classes (fp, root, component_id); root is the fingerprint that names a component.

    Classes have a row per distinct fingerprint and are read back as a table, so that the join of a fingerprint
    that very many documents share can be split.
    """
    prints = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(nodes, max_bits))
    named = (nodes.join(roots, nodes["fp"] == roots["node"], "left")
             .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = checkpointed(named.groupBy("root").agg(F.min("least").alias("component_id")))
    return prints, checkpointed(named.select("fp", "root").join(least, "root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id reachable over links of at most ``max_bits`` bits, itself included.
    Null and empty texts have fingerprint zero and are linked like any other; repeated rows stay repeated;
    a null doc_id keeps its row and never names a component unless its whole component has null ids.
    Other columns of ``docs`` are ignored.  An empty table gives an empty result.
    """
    prints, of = classes(docs, shingle, max_bits, id_col, text_col)
    return prints.join(of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key) of the one document of each component that stays: the smallest id, null ids last."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    prints, of = classes(docs, shingle, max_bits, id_col, text_col)
    # One row per fingerprint first, so that copies are gone before the join.
    alone = prints.groupBy("fp").agg(first.alias("first"))
    return (alone.join(of, "fp").groupBy("root").agg(F.min("first").alias("first"))
            .select("first.doc_id", "first.text_key").distinct())
