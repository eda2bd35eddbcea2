"""Ranked lexical search through exact sparse ball trees.

Every document is the sparse vector of its integer term weights, kept for the terms of the items that are asked.
A task cuts its documents into blocks and builds a ball tree over each: a node has the centroid of its documents and
their radius, over all terms and term by term.  An item's score of any document below a node is at most

    q . centroid + min(|q| * radius, sum of q_t * radius_t)

where the first form is rounded upwards and the second is exact.  Nodes are opened best first until no bound reaches
the item's tenth score so far; documents at the leaves are scored in 64-bit integers, so the result is exact.

Items are answered in blocks of about ``ITEM_TERMS`` terms, which bounds what is sent to the tasks.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketflow.llm.common import checkpointed

TOP = 10
#: Documents of one tree, and of one leaf.
BLOCK = 8192
LEAF = 64
#: Terms of the items that are answered together.
ITEM_TERMS = 200_000

#: Terms are runs of digits, letters and everything beyond ASCII; only A-Z are lower-cased.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Far above the rounding of sums of a few thousand doubles.
_SLACK = 1e-9


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _rows(indptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries of ``rows`` in a row-compressed matrix, and the entries of each."""
    length = indptr[rows + 1] - indptr[rows]
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(indptr[rows] - (ends - length), length), length


class BallTree:
    """Ball tree over the rows of a sparse matrix (indptr, columns, positive integer values)."""

    def __init__(self, indptr: np.ndarray, cols: np.ndarray, vals: np.ndarray, n_cols: int, leaf: int = LEAF):
        n = len(indptr) - 1
        self.order = np.arange(n)
        norm = np.zeros(n)
        np.add.at(norm, np.repeat(np.arange(n), np.diff(indptr)), vals.astype(float) ** 2)
        self.lo, self.hi, self.kids, self.radius = [], [], [], []
        held: list[tuple] = []  # (node, columns, centroid, largest value) of every node
        todo = [(0, n, -1)]
        while todo:
            lo, hi, parent = todo.pop()
            node, own = len(self.lo), self.order[lo:hi]
            at, length = _rows(indptr, own)
            c, v = cols[at], vals[at].astype(float)
            some, local = np.unique(c, return_inverse=True)
            mean = np.bincount(local, v, len(some)) / len(own)
            most = np.zeros(len(some), np.int64)
            np.maximum.at(most, local, vals[at])
            row = np.repeat(np.arange(len(own)), length)
            away = norm[own] - 2 * np.bincount(row, v * mean[local], len(own)) + mean @ mean
            safe = _SLACK * (norm[own] + mean @ mean)
            self.radius.append(math.sqrt(max(0.0, float((away + safe).max()))) * (1 + _SLACK))
            held.append((np.full(len(some), node), some, mean, most))
            self.lo.append(lo)
            self.hi.append(hi)
            self.kids.append([])
            if parent >= 0:
                self.kids[parent].append(node)
            if hi - lo > leaf:  # split between two documents that are far apart
                dense = np.zeros(len(some))

                def dots(i):
                    dense[:] = 0
                    dense[local[row == i]] = v[row == i]
                    return np.bincount(row, v * dense[local], len(own))

                first = int(np.argmax(away))
                to_first = dots(first)
                second = int(np.argmax(norm[own] - 2 * to_first))
                self.order[lo:hi] = own[np.argsort(to_first - dots(second), kind="stable")]
                mid = (lo + hi) // 2
                todo += [(lo, mid, node), (mid, hi, node)]
        self.radius = np.array(self.radius)
        node, col, mean, most = (np.concatenate(x) for x in zip(*held))
        by = np.argsort(col, kind="stable")
        self.node, self.mean, self.most = node[by], mean[by], most[by]
        self.node_at = np.searchsorted(col[by], np.arange(n_cols + 1))
        # The documents in tree order, by column.
        at, length = _rows(indptr, self.order)
        place, col, val = np.repeat(np.arange(n), length), cols[at], vals[at]
        by = np.argsort(col, kind="stable")
        self.place, self.val = place[by], val[by]
        self.val_at = np.searchsorted(col[by], np.arange(n_cols + 1))

    def bounds(self, cols: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Least upper bound known of weights . row, for every node."""
        n = len(self.lo)
        centre, corner = np.zeros(n), np.zeros(n, np.int64)
        for c, w in zip(cols.tolist(), weights.tolist()):
            s = slice(self.node_at[c], self.node_at[c + 1])
            centre[self.node[s]] += w * self.mean[s]
            corner[self.node[s]] += w * self.most[s]  # q . centroid + sum of q_t * radius_t
        ball = centre + math.sqrt(float(np.sum(weights.astype(float) ** 2))) * self.radius
        return np.minimum(np.floor(ball * (1 + _SLACK)) + 1, corner)

    def scores(self, node: int, cols: np.ndarray, weights: np.ndarray) -> np.ndarray:
        lo, hi = self.lo[node], self.hi[node]
        out = np.zeros(hi - lo, np.int64)
        for c, w in zip(cols.tolist(), weights.tolist()):
            a, b = self.val_at[c], self.val_at[c + 1]
            a, b = a + np.searchsorted(self.place[a:b], (lo, hi))
            out[self.place[a:b] - lo] += w * self.val[a:b]
        return out

    def search(self, cols: np.ndarray, weights: np.ndarray, least) -> Iterator[tuple[int, int]]:
        """(row, score) of every row that may reach ``least()``, asked anew before each node; best bounds first."""
        bound = self.bounds(cols, weights)
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            if -b < max(1, least()):
                return
            for k in self.kids[node]:
                heapq.heappush(heap, (max(b, -bound[k]), k))
            if not self.kids[node]:
                score = self.scores(node, cols, weights)
                for i in np.flatnonzero(score >= max(1, least())).tolist():
                    yield int(self.order[self.lo[node] + i]), int(score[i])


def _vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, term array, tf array) of every document with a term; only terms of the vocabulary are listed."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                part = b.slice(s, 2000)
                keep, size, found, tf, ends = [], [], [], [], [0]
                for i, text in enumerate(part.column(1).to_pylist()):
                    words = terms(text)
                    if not words:
                        continue
                    counts = Counter(words)
                    for w in counts.keys() & number.keys():
                        found.append(number[w])
                        tf.append(counts[w])
                    keep.append(i)
                    size.append(len(words))
                    ends.append(len(found))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(keep, pa.int64())), pa.array(size, pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))], ["doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(run, f"doc_id {id_type}, n long, terms array<int>, tf array<long>")


def _document_frequencies(vectors: DataFrame, n_terms: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            df += np.bincount(b.column(0).flatten().to_numpy(), minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    counted = vectors.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in counted.toLocalIterator():
        out[r["term"]] = r["df"]
    return out


def _best(vectors: DataFrame, asked, n_docs: int, total: int, n_terms: int, top: int) -> DataFrame:
    """(item, doc_id, score): the best ``top`` documents of each item in each task."""
    id_type = vectors.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = asked.value  # [(term numbers, weights)]
        best: list[list] = [[] for _ in items]  # (-score, id is null, id), least first

        def block(held: list[pa.RecordBatch]):
            t = pa.Table.from_batches(held).combine_chunks()
            ids, n = t.column(0).to_pylist(), t.column(1).to_numpy()
            listed = t.column(2).combine_chunks()
            length = listed.value_lengths().to_numpy(zero_copy_only=False)
            used, cols = np.unique(listed.flatten().to_numpy(), return_inverse=True)
            if not len(used):
                return
            tf = t.column(3).combine_chunks().flatten().to_numpy()
            m = np.repeat(10 + np.array([90 * int(x) * n_docs // total for x in n], np.int64), length)
            vals = 1_000_000_000 * tf // (1000 * tf + 8 * m)
            tree = BallTree(np.concatenate([[0], np.cumsum(length)]), cols, vals, len(used))
            local = np.full(n_terms, -1)
            local[used] = np.arange(len(used))
            for k, (numbers, weights) in enumerate(items):
                mine = local[numbers]
                have, mine_best = mine >= 0, best[k]

                def least():
                    return -mine_best[-1][0] if len(mine_best) == top else 1

                for row, score in tree.search(mine[have], weights[have], least):
                    entry = (-score, ids[row] is None, ids[row] if ids[row] is not None else 0)
                    if len(mine_best) < top or entry < mine_best[-1]:
                        mine_best.append(entry)
                        mine_best.sort()
                        del mine_best[top:]

        held, rows, kind = [], 0, None
        for b in batches:
            kind = b.column(0).type
            while b.num_rows:
                held.append(b.slice(0, BLOCK - rows))
                rows, b = rows + held[-1].num_rows, b.slice(held[-1].num_rows)
                if rows == BLOCK:
                    block(held)
                    held, rows = [], 0
        if held:
            block(held)
        if kind is None:
            return
        out = [(k, None if e[1] else e[2], -e[0]) for k, entries in enumerate(best) for e in entries]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in
                                          enumerate((pa.int32(), kind, pa.int64()))], ["item", "doc_id", "score"])

    return vectors.mapInArrow(run, f"item int, doc_id {id_type}, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``top`` highest-scoring documents of each item: item_id, rank (from 1), doc_id, score.

    All documents are scored; equal scores rank by ascending doc_id, null ids last, and repeated rows stand side by
    side.  Null and empty texts have no terms: such documents are not counted and such items get no row.  Repeated
    rows of an item (id and text) are answered once; two texts under one id are two items, both under that id.  Ids
    are integers or strings.  Other columns are ignored; an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    wanted = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text IS NOT NULL").distinct()
    chars = wanted.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = 1 + chars // (4 * ITEM_TERMS)
    item_type = wanted.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score long")
    for k in range(blocks):
        asked = [(r["item_id"], sorted(set(terms(r["text"])))) for r in
                 wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toLocalIterator()]
        number = {w: i for i, w in enumerate(sorted({w for _, own in asked for w in own}))}
        if not number:
            continue
        vectors = checkpointed(_vectors(rows, spark.sparkContext.broadcast(number)))
        n_docs, total = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = _document_frequencies(vectors, len(number))
        weight = np.array([term_weight(n_docs, int(x)) for x in df], np.int64)
        own = [np.array([number[w] for w in words], np.int64) for _, words in asked]
        sent = spark.sparkContext.broadcast([(t, weight[t]) for t in own])
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(asked)], f"item int, item_id {item_type}")
        place = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        found = (_best(vectors, sent, n_docs, total, len(number), top)
                 .withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top))
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
