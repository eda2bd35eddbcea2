"""Prefix scans over any associative operation without one task that holds the order.

Rows are cut into range partitions of the whole order and written once.  A first pass reduces each partition to one
value, the driver folds these few (one a partition) into what stands before each partition, and a second pass scans
every partition from its carry.  Operations work on whole columns: an operation is given by how it scans arrays and
how it puts a value before them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Elementwise:
    """An associative numpy function of each column by itself: running sums, products, least or largest values."""

    def __init__(self, ufunc: np.ufunc):
        self.ufunc = ufunc

    def scan(self, cols: list[np.ndarray]) -> list[np.ndarray]:
        return [self.ufunc.accumulate(c) for c in cols]

    def join(self, before, cols: list[np.ndarray]) -> list[np.ndarray]:
        return [self.ufunc(b, c) for b, c in zip(before, cols)]


class Affine:
    """Maps ``x -> decay * x + add`` applied one after another; the first column is the decay, the others are sums.

    Exponential smoothing by ``alpha`` is the map (1 - alpha, alpha * x): any stretch of it is one such pair, so
    stretches merge in any grouping, though not in another order.
    """

    def scan(self, cols: list[np.ndarray]) -> list[np.ndarray]:
        decay, adds = cols[0].astype(float), [c.astype(float) for c in cols[1:]]
        k = 1
        while k < len(decay):
            adds = [np.concatenate([a[:k], a[:-k] * decay[k:] + a[k:]]) for a in adds]
            decay = np.concatenate([decay[:k], decay[:-k] * decay[k:]])
            k *= 2
        return [decay, *adds]

    def join(self, before, cols: list[np.ndarray]) -> list[np.ndarray]:
        return [before[0] * cols[0], *(b * cols[0] + c for b, c in zip(before[1:], cols[1:]))]


SUM, LARGEST, LEAST, AFFINE = Elementwise(np.add), Elementwise(np.maximum), Elementwise(np.minimum), Affine()


def prefix_scan(df: DataFrame, order, inputs: list[str], outputs: list[str], op=SUM) -> DataFrame:
    """``df`` with the running values of ``inputs`` (no nulls) in the given order, each row's own included.

    ``order`` must be total for a definite result.  Integer columns stay long, others are double.
    """
    part = (df.repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("_p", F.spark_partition_id()).checkpoint(eager=True))
    whole = {c: t in ("tinyint", "smallint", "int", "bigint") for c, t in df.select(*inputs).dtypes}
    kinds = [pa.int64() if whole[c] and not isinstance(op, Affine) else pa.float64() for c in inputs]
    names = {pa.int64(): "long", pa.float64(): "double"}

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(c).cast(k).to_numpy(zero_copy_only=False) for c, k in zip(inputs, kinds)]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, p = None, 0
        for b in batches:
            if b.num_rows:
                p, cols = b.column("_p")[0].as_py(), op.scan(columns(b))
                state = [c[-1] for c in (cols if state is None else op.join(state, cols))]
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([v], k) for v, k in zip(state, kinds))], ["_p", *outputs])

    made = ", ".join(f"`{o}` {names[k]}" for o, k in zip(outputs, kinds))
    totals = sorted(tuple(r) for r in part.select("_p", *inputs).mapInArrow(total, f"_p int, {made}").collect())
    carry, before = {}, None
    for p, *own in totals:
        carry[p] = before
        own = [np.array([v]) for v in own]
        before = [c[0] for c in (own if before is None else op.join(before, own))]
    sent = df.sparkSession.sparkContext.broadcast(carry)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, begun = None, False
        for b in batches:
            if not b.num_rows:
                continue
            if not begun:
                state, begun = sent.value[b.column("_p")[0].as_py()], True
            cols = op.scan(columns(b))
            cols = cols if state is None else op.join(state, cols)
            state = [c[-1] for c in cols]
            rest = [(n, b.column(n)) for n in b.schema.names if n != "_p"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                             [*(n for n, _ in rest), *outputs])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return part.mapInArrow(scan, f"{fields}, {made}")
