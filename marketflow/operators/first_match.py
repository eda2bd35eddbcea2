"""#87, #88: the first match of threshold rules without the pairs of rules and rows.

A rule over all items compares one measure with its threshold, so its first match in batch order is the first row at
which the running maximum of that measure reaches it.  Only those record rows matter: rules and records are put into
one order by value, and a prefix scan gives every rule the earliest record at or above its threshold.  Over many polls a
rule goes from one firing to the next poll behind its cooldown whose maximum reaches it, found by halving over a table of
maxima of 1, 2, 4, ... polls; within that poll the same scan finds the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import LARGEST, LEAST, prefix_scan
from .sequence import numbered
from .small import small_side

#: Polls whose maxima a task holds at once; longer histories are walked block by block.
POLLS = 500_000
_NONE = 2**62
#: Rows of a measure are moved below those of the measures before it, so that one scan serves all.
_APART = 2**50


def _narrow(items: DataFrame, measures: list[Column], order: list[str], payload, *more) -> DataFrame:
    cols = list(dict.fromkeys([*payload, *order, *more]))
    return items.withColumn("_meas", F.array(*[m.cast("double") for m in measures])).select(*cols, "_meas")


def _earliest(rows: DataFrame, rules: DataFrame, poll: bool) -> DataFrame:
    """(_rule, _g[, _t]) of the earliest row of the rule's measure (and poll) whose value reaches its threshold.

    ``rows`` has (k, v, _g[, _t]), ``rules`` (_rule, k, v[, _t]).  Later measures, and earlier polls, come later in the
    scan and have smaller numbers, so nothing seen before a rule's own stretch is ever the least.
    """
    at = ["_t"] if poll else []
    both = (rows.select("k", *at, "v", F.lit(0).alias("kind"), (F.col("_g") - F.col("k") * F.lit(_APART)).alias("place"), F.lit(None).cast("long").alias("_rule"))
            .unionByName(rules.select("k", *at, "v", F.lit(1).alias("kind"), F.lit(_NONE).alias("place"), "_rule")))
    order = [F.col("k").asc(), *(F.col(c).desc() for c in at), F.col("v").desc(), F.col("kind").asc(), F.col("place").asc()]
    found = prefix_scan(both, order, ["place"], ["least"], LEAST).where("kind = 1")
    g = F.col("least") + F.col("k") * F.lit(_APART)
    return found.where((g >= 0) & (g < F.lit(_APART))).select("_rule", *at, g.alias("_g"))


def first_matches(items: DataFrame, rules: DataFrame, measures: list[Column], order: list[str], payload) -> DataFrame:
    """(_rule, payload columns): the first row in ``order`` at which measure ``k`` is at least ``v``, for rules (_rule, k, v)."""
    g = numbered(_narrow(items, measures, order, payload), [F.col(c) for c in order])
    n = len(measures)
    tops = [f"_top{k}" for k in range(n)]
    run = prefix_scan(g.select("_g", *[F.col("_meas")[k].alias(f"_v{k}") for k in range(n)]), ["_g"], [f"_v{k}" for k in range(n)], tops, LARGEST)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(tops[k]).alias("v")) for k in range(n)])).alias("r")
    records = run.select("_g", each).groupBy("r.k", "r.v").agg(F.min("_g").alias("_g")).select("k", "v", "_g")
    return _earliest(records, rules, poll=False).join(g, "_g").drop("_meas")


class _Maxima:
    """Maxima of one measure over stretches of 1, 2, 4, ... polls."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.levels = [np.concatenate([values, [-np.inf]])]
        while 1 << len(self.levels) <= self.n:
            low, half = self.levels[-1], 1 << (len(self.levels) - 1)
            moved = np.concatenate([low[half:], np.full(min(half, len(low)), -np.inf)])[:len(low)]
            self.levels.append(np.maximum(low, moved))

    def next(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first poll from ``at`` on whose value is at least ``least``; ``n`` where there is none."""
        at = at.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            at = np.where((at < self.n) & (self.levels[level][np.minimum(at, self.n)] < least), np.minimum(at + (1 << level), self.n), at)
        return at


def firings(polls: DataFrame, rules: DataFrame, n_measures: int, block: int = POLLS) -> DataFrame:
    """(_rule, _t): the polls at which each rule fires.

    ``polls`` has one row a poll: _t (microseconds) and _v, the largest value of each measure; ``rules`` (_rule, k, v, gap,
    last).  A rule fires at a poll that reaches it, if it is strictly later than its last firing plus its gap.
    """
    spark = polls.sparkSession
    at = numbered(polls, [F.col("_t")], out="_no").checkpoint(eager=True)
    total = at.count()
    state, out = rules.select("_rule", "k", "v", "gap", "last"), None
    for start in range(0, total, block):
        rows = sorted(at.where((F.col("_no") >= start) & (F.col("_no") < start + block)).select("_t", "_v").collect())
        times = np.array([r["_t"] for r in rows], np.int64)
        held = spark.sparkContext.broadcast((times, [_Maxima(np.array([r["_v"][k] for r in rows], float)) for k in range(n_measures)]))

        def walk(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            times, maxima = held.value
            for b in batches:
                rule, k, v, gap = (b.column(i).to_numpy() for i in range(4))
                last = b.column(4)
                at = np.where(last.is_null().to_numpy(zero_copy_only=False), 0,
                              np.searchsorted(times, last.fill_null(0).to_numpy() + gap, side="right"))
                for m in np.unique(k):
                    mine = np.flatnonzero(k == m)
                    while len(mine):
                        at[mine] = maxima[m].next(at[mine], v[mine])
                        mine = mine[at[mine] < len(times)]
                        if len(mine):
                            yield pa.RecordBatch.from_arrays([pa.array(rule[mine]), pa.array(times[at[mine]])], ["_rule", "_t"])
                            at[mine] = np.searchsorted(times, times[at[mine]] + gap[mine], side="right")

        fired = state.mapInArrow(walk, "_rule long, _t long").checkpoint(eager=True)
        out = fired if out is None else out.unionByName(fired)
        newest = fired.groupBy("_rule").agg(F.max("_t").alias("_newest"))
        state = (state.join(newest, "_rule", "left").withColumn("last", F.coalesce("_newest", "last")).drop("_newest").checkpoint(eager=True))
    return out if out is not None else state.where("false").select("_rule", F.col("last").alias("_t"))


def placed(history: DataFrame, measures: list[Column], ts: str, order: list[str], payload, *more) -> DataFrame:
    """The rows that have a time, written once: payload, ``order`` and ``more`` columns, measures ``_meas``, time ``_t``
    (microseconds) and place ``_g`` by time, then ``order``."""
    timed = history.where(F.col(ts).isNotNull()).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    return numbered(_narrow(timed, measures, order, payload, "_t", *more), [F.col("_t"), *[F.col(c) for c in order]])


def replayed_matches(g: DataFrame, rules: DataFrame, n: int, block: int = POLLS) -> DataFrame:
    """(_rule, _t, _g): every firing of rules (_rule, k, v, gap, last) over ``placed`` rows of ``n`` measures, with the place
    of its poll's first match."""
    polls = g.groupBy("_t").agg(F.array(*[F.max(F.col("_meas")[k]) for k in range(n)]).alias("_v"))
    fired = firings(polls, rules, n, block)
    asked = fired.join(rules.select("_rule", "k", "v"), "_rule")
    used = small_side(fired.select("_t").distinct())
    # Below the least threshold that fires in a poll no row is a match, so most rows end here.
    lows = small_side(asked.groupBy("k", "_t").agg(F.min("v").alias("_low")))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("_meas")[k].alias("v")) for k in range(n)])).alias("r")
    values = g.join(used, "_t", "left_semi").select("_t", "_g", each).select("r.k", "_t", "r.v", "_g")
    values = (values.join(lows, ["k", "_t"]).where(F.col("v") >= F.col("_low"))
              .groupBy("k", "_t", "v").agg(F.min("_g").alias("_g")))
    return _earliest(values, asked, poll=True)
