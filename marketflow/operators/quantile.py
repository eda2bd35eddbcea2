"""Exact quantiles by group, without a group's values in one task.

Groups of up to ``SMALL`` rows are left to the built-in ``percentile``.  For the larger ones all wanted ranks of all groups
are narrowed in shared passes: a pass counts each group's rows between its bounds in ``BINS`` bins (partial counts, so a
group with most of the rows is a thousand rows a task), keeps the bin that holds the rank, and goes on with that bin's own
least and largest value.  The bounds, a few rows for each ``SMALL`` rows of a group, are broadcast: a join that moved rows
by their group would put a group into one task.  Once a few rows, or neighbouring doubles, are left, their distinct values decide.
Infinite values and NaN, which Spark sorts last, have ranks of their own and never bound a bin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .small import small_written

SMALL = 65_536
BINS = 1024
FEW = 1024
_ENDS = (float("-inf"), float("inf"), float("nan"))


def _kind(x: Column) -> Column:
    """0: -inf, 1: finite, 2: +inf, 3: NaN."""
    return F.when(F.isnan(x), 3).when(x == F.lit(_ENDS[1]), 2).when(x == F.lit(_ENDS[0]), 0).otherwise(1)


def _holding(counts: DataFrame, order: str) -> DataFrame:
    """Of the counted pieces of each target, the one that holds its rank; ``below`` counts what lies before it."""
    w = Window.partitionBy("g", "r").orderBy(order)          # no more pieces than bins or distinct values left
    cum = counts.withColumn("cum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (cum.where(F.col("below") + F.col("cum") > F.col("r"))
            .withColumn("first", F.row_number().over(w)).where("first = 1")
            .withColumn("below", F.col("below") + F.col("cum") - F.col("n")).drop("first", "cum"))


def _narrowed(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, r, value): the finite value at the 0-based rank ``r`` of its group; ``wanted`` has (g, r, lo, hi, n)."""
    open_ = wanted.select("g", "r", "lo", "hi", "n", F.lit(0).cast("long").alias("below")).checkpoint(eager=True)
    done = open_.where("lo = hi").select("g", "r", F.col("lo").alias("value"))
    open_ = open_.where("lo < hi")
    width = (F.col("hi") - F.col("lo")) / BINS
    even = F.isnan(width) | (width == F.lit(_ENDS[1])) | (F.col("lo") + width == F.col("lo"))
    while True:
        ready = (F.col("n") <= FEW) | (F.col("lo") + width == F.col("lo"))
        last = open_.where(ready)
        if last.limit(1).count():
            near = rows.join(small_written(last), "g").where(F.col("x").between(F.col("lo"), F.col("hi")))
            counts = near.groupBy("g", "r", "below", "x").agg(F.count(F.lit(1)).alias("n"))
            done = done.unionByName(_holding(counts, "x").select("g", "r", F.col("x").alias("value")))
        open_ = open_.where(~ready)
        if not open_.limit(1).count():
            return done.checkpoint(eager=True)
        # A span beyond the largest double is halved first.
        half = F.col("lo") / 2 + F.col("hi") / 2
        bin_ = F.when(even, (F.col("x") > half).cast("long")).otherwise(
            F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(BINS - 1)))
        inside = rows.join(small_written(open_.drop("n")), "g").where(F.col("x").between(F.col("lo"), F.col("hi")))
        counts = (inside.groupBy("g", "r", "below", bin_.alias("b"))
                  .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))
        open_ = _holding(counts, "b").select("g", "r", "lo", "hi", "n", "below").checkpoint(eager=True)
        done = done.unionByName(open_.where("lo = hi").select("g", "r", F.col("lo").alias("value")))
        open_ = open_.where("lo < hi")


def grouped_quantiles(df: DataFrame, group: str, value: str, qs, small: int = SMALL) -> DataFrame:
    """(group, n, q): linearly interpolated quantiles ``qs`` of each group's non-null values, as an array, and their count.

    A null group is a group.  Interpolation between two equal values is that value, infinite ones included.
    """
    qs = [float(q) for q in qs]
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull())
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    direct = lambda r: r.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.percentile("x", F.array(*map(F.lit, qs))).alias("q"))
    large = sizes.where(F.col("n") > small).select("g").checkpoint(eager=True)   # one row for each ``small`` rows at most
    if not large.limit(1).count():
        return direct(rows).select(F.col("g").alias(group), "n", "q")
    big = small_written(large.withColumnRenamed("g", "b"))
    same = F.col("g").eqNullSafe(F.col("b"))
    rows = rows.checkpoint(eager=True)
    mine = rows.join(big, same, "left_semi").withColumn("g", F.struct("g"))      # a struct is never null, so joins are plain
    kind, x = _kind(F.col("x")), F.col("x")
    facts = mine.groupBy("g").agg(
        *(F.count_if(kind == k).alias(f"n{k}") for k in range(4)), F.min(F.when(kind == 1, x)).alias("lo"), F.max(F.when(kind == 1, x)).alias("hi"))
    facts = facts.withColumn("n", F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3")).checkpoint(eager=True)
    place = [(F.col("n") - 1) * F.lit(q) for q in qs]
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(p), F.ceil(p)) for p in place))))
    targets = facts.select("*", F.explode(ranks).alias("rank"))
    at = F.col("rank") - F.col("n0")
    finite = targets.where((at >= 0) & (at < F.col("n1"))).select("g", at.alias("r"), "lo", "hi", F.col("n1").alias("n"), "rank")
    values = _narrowed(mine.where(_kind(F.col("x")) == 1), finite.drop("rank"))
    end = F.when(at < 0, F.lit(_ENDS[0])).when(at < F.col("n1") + F.col("n2"), F.lit(_ENDS[1])).otherwise(F.lit(_ENDS[2]))
    known = (finite.join(values, ["g", "r"]).select("g", "rank", "value")
             .unionByName(targets.where((at < 0) | (at >= F.col("n1"))).select("g", "rank", end.alias("value"))))
    by_rank = known.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("v"))  # two a quantile
    joined = facts.join(by_rank, "g")

    def between(p: Column) -> Column:
        a, b = F.element_at("v", F.floor(p)), F.element_at("v", F.ceil(p))
        return F.when(a == b, a).otherwise(a + (p - F.floor(p)) * (b - a))
    exact = joined.select(F.col("g.g").alias(group), "n", F.array(*(between(p) for p in place)).alias("q"))
    rest = direct(rows.join(big, same, "left_anti"))
    return exact.unionByName(rest.select(F.col("g").alias(group), "n", "q"))


def exact_quantile(df: DataFrame, c: str, q: float, small: int = SMALL) -> float | None:
    """Linearly interpolated quantile of the non-null values (None without any).

    The rows are made and written once.  Narrowing is that of the groups, with the bounds as literals; the two ranks
    beside the quantile are neighbours, so they lie in one bin, or the upper is the least value of the next.
    """
    # A filter before would compute the values a second time.
    rows = df.select(F.col(c).cast("double").alias("x")).checkpoint(eager=True).where(F.col("x").isNotNull())
    kind, x = _kind(F.col("x")), F.col("x")
    f = rows.agg(*(F.count_if(kind == k).alias(f"n{k}") for k in range(4)), F.min(F.when(kind == 1, x)).alias("lo"), F.max(F.when(kind == 1, x)).alias("hi")).first()
    total = f["n0"] + f["n1"] + f["n2"] + f["n3"]
    if not total:
        return None
    if total <= small:
        return rows.agg(F.percentile("x", F.lit(float(q)))).first()[0]
    place = (total - 1) * float(q)
    ranks = [math.floor(place), math.ceil(place)]
    got = {r: _ENDS[0] if r < f["n0"] else _ENDS[1] if r < f["n0"] + f["n1"] + f["n2"] else _ENDS[2]
           for r in ranks if not f["n0"] <= r < f["n0"] + f["n1"]}
    wanted = sorted({r - f["n0"] for r in ranks if r not in got})
    if wanted:
        got |= {r + f["n0"]: v for r, v in _at_ranks(rows.where(kind == 1), wanted, f["lo"], f["hi"], f["n1"]).items()}
    a, b = (got[r] for r in ranks)
    return a if a == b or math.isnan(a) and math.isnan(b) else a + (place - ranks[0]) * (b - a)


def _at_ranks(rows: DataFrame, wanted: list[int], lo: float, hi: float, n: int) -> dict[int, float]:
    """The values at one 0-based rank, or two neighbouring ones, of ``n`` finite values from ``lo`` to ``hi``."""
    x, below, got = F.col("x"), 0, {}
    while wanted:
        if lo == hi:
            return got | dict.fromkeys(wanted, lo)
        width, near = (hi - lo) / BINS, rows.where(F.col("x").between(F.lit(lo), F.lit(hi)))
        last = n <= FEW or lo + width == lo
        if last:
            pieces = near.groupBy(x.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        else:
            # A span beyond the largest double is halved first.
            bin_ = ((x > F.lit(lo / 2 + hi / 2)).cast("long") if math.isinf(width)
                    else F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(BINS - 1)))
            pieces = near.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        first = None
        for p in sorted(pieces.collect(), key=lambda p: p["b"]):     # no more pieces than bins or distinct values left
            if first is None and wanted[0] < below + p["n"]:
                first = p
                if last:
                    got |= {r: p["lo"] for r in wanted if r < below + p["n"]}
                    wanted = [r for r in wanted if r >= below + p["n"]]
                if not wanted or wanted[-1] < below + p["n"]:
                    break
            elif first is not None:
                got[wanted.pop()] = p["lo"]
                break
            if first is None:
                below += p["n"]
        lo, hi, n = first["lo"], first["hi"], first["n"]
    return got
