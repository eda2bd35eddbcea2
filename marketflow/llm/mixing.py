"""Mixing sources to target weights by Pareto order sampling.

Every source gets a word target.  Whole copies that the target affords are
certain; the rest of the target is filled by a Pareto order sample: documents
are ranked by their random odds divided by their inclusion odds, and the
smallest ranks are taken until the source's remaining words are met.

The cut is found without sorting a source: rank values are counted in a fixed
number of bins, then those of the one bin that holds the cut, and only the bin
found there is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketflow.llm.common import WORD, checkpointed

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Bins of the rank value, and of that bin in turn which holds the cut; a source's cut is ordered within one of these.
BINS = 1 << 8
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform in (0, 1), fixed by the id and the seed: 52 bits of an MD5."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources in code-point order, null last.

    One row per source: targets stop at ``most`` times the source's size and what is above is
    shared again by weight, which the rising ratio of cap to weight gives in closed form.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("i") % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("i", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    rising = W.orderBy(F.col("source_size") / F.col("w"), "i")
    steps = (ranked.withColumn("w", w)
             .withColumn("k", F.row_number().over(rising))
             .withColumn("before", F.sum("source_size").over(rising.rowsBetween(W.unboundedPreceding, -1)))
             .withColumn("above", F.sum("w").over(rising.rowsBetween(0, W.unboundedFollowing)))
             .withColumn("all", F.sum("source_size").over(W.partitionBy())))
    rate = (F.col("all") * share - F.coalesce("before", F.lit(0)) * float(most)) / F.col("above")
    fits = rate * F.col("w") <= F.col("source_size") * float(most)
    first = F.min(F.when(fits, F.struct("k", rate.alias("rate")))).over(W.partitionBy())
    return (steps.withColumn("level", first["rate"])
            .select("source", "source_size",
                    F.least(F.col("source_size") * float(most), F.coalesce(F.col("level") * F.col("w"),
                            F.col("source_size") * float(most))).alias("target")))


def pareto_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weight_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    ``weight_col`` (positive numbers; null or not positive count as 1) tilts the inclusion odds within a source;
    without it all documents of a source have the same odds.  Null text has size 0, null source is a source
    of its own that sorts last, null ids share one random number, repeated rows are drawn one by one.
    An empty table gives an empty result; sources without words have target 0.
    """
    tilt = F.lit(1.0) if weight_col is None else F.when(F.col(weight_col) > 0, F.col(weight_col)).otherwise(1.0)
    sizes = checkpointed(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        uniform(F.col(id_col), seed).alias("u"), tilt.cast("double").alias("tilt")))
    targets = source_targets(sizes, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = checkpointed(targets.withColumn("whole", F.floor(ratio)).withColumn("part", ratio - F.floor(ratio))
                           .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
                           .withColumnRenamed("source", "s"))
    rows = sizes.join(targets, F.col("source").eqNullSafe(F.col("s")))
    odds = F.col("part") / (1 - F.col("part")) * F.col("tilt")
    rank = F.col("u") / (1 - F.col("u")) / odds
    ranked = (rows.withColumn("v", F.when(F.col("part") > 0, rank / (1 + rank)).otherwise(1.0))
              .withColumn("bin", F.least(F.floor(F.col("v") * BINS * BINS), F.lit(BINS * BINS - 1)).cast("int")))
    high, low = F.floor(F.col("bin") / BINS), F.col("bin") % BINS

    def cut_in(rows: DataFrame, level, room, name: str) -> DataFrame:
        """(source, bin in which the running sum passes the room, sum before it)."""
        bins = rows.groupBy("s", level.alias("b")).agg(F.sum("size").alias("words"), F.first(room).alias("room"))
        rising = W.partitionBy("s").orderBy("b")
        return (bins.withColumn("upto", F.sum("words").over(rising)).where("upto > room").groupBy("s")
                .agg(F.min(F.struct("b", F.expr("upto - words").alias("before"))).alias("c"))
                .select(F.col("s").alias(f"s{name}"), F.col("c.b").alias(f"cut{name}"), F.col("c.before").alias(f"before{name}")))

    coarse = cut_in(ranked, high, F.col("rest"), "1")
    within = ranked.join(coarse, F.col("s").eqNullSafe(F.col("s1")) & (high == F.col("cut1")))
    fine = cut_in(within, low, F.col("rest") - F.col("before1"), "2")
    cut = coarse.join(fine, F.col("s1").eqNullSafe(F.col("s2"))).select(
        F.col("s1").alias("cs"), (F.col("cut1") * BINS + F.col("cut2")).alias("cut"),
        (F.col("before1") + F.col("before2")).alias("before"))
    marked = checkpointed(ranked.join(cut, F.col("s").eqNullSafe(F.col("cs")), "left"))
    inside = W.partitionBy("s").orderBy("v", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    edge = (marked.where("bin = cut")
            .withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .withColumn("drawn", (2 * F.col("ahead") + F.col("size") <= 2 * F.col("rest")).cast("long")))
    rest = marked.where("cut IS NULL OR bin <> cut").withColumn(
        "drawn", F.when(F.col("part") > 0, F.col("cut").isNull() | (F.col("bin") < F.col("cut"))).otherwise(False).cast("long"))
    out = edge.drop("ahead").unionByName(rest).withColumn("copies", F.col("whole") + F.col("drawn"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))
