"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

Every stage but the last returns exactly the columns of ``docs``.  Decisions are joined back under names
that cannot clash with a column of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketflow.llm import secrets, toxicity
from marketflow.llm.common import fold_of, read_table
from marketflow.llm.decontaminate import contaminated
from marketflow.llm.mixing import pareto_mix
from marketflow.llm.simhash import representatives


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold stay; null and empty texts score like any text without a hit."""
    held_out = fold_of(F.col("doc_id"), 3) == 1
    lexicon = toxicity.train(toxicity.training_rows(docs, read_table(spark, sf_dir, "labels"), held_out))
    return docs.where(toxicity.scorer(lexicon)(docs["text"]) < toxicity.THRESHOLD)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    Of repeated rows one stays; a row with a null doc_id stays only where its whole group has null ids.
    """
    keep = representatives(docs).select(F.col("doc_id").alias("__keep_id"), F.col("text_key").alias("__keep_key"))
    rows = docs.join(keep, docs["doc_id"].eqNullSafe(F.col("__keep_id")) & (F.xxhash64(docs["text"]) == F.col("__keep_key")))
    order = [F.col(f"`{c}`") for c, t in docs.dtypes if not t.startswith("map")]
    same = W.partitionBy("__keep_id", "__keep_key").orderBy(*order)
    return (rows.withColumn("__row", F.row_number().over(same)).where("__row = 1")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay.  Rows are told apart by doc_id and text, so ids may repeat or be null."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("key")).alias("row"), "text")
    bad = (contaminated(keyed, read_table(spark, sf_dir, "benchmark"), id_col="row")
           .select(F.col("doc_id.doc_id").alias("__bad_id"), F.col("doc_id.key").alias("__bad_key")).distinct())
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__bad_id")) & (F.xxhash64(docs["text"]) == F.col("__bad_key")), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every secret span of the text is replaced by a mark, and n_chars follows the new text."""
    d = secrets.with_spans(docs, secrets.train(docs), base_name="__base", all_name="__spans")
    d = d.withColumn("text", secrets.redacted(F.col("text"), F.col("__spans")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        d = d.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, size, source_size, target, copies, taken of every document."""
    return pareto_mix(docs)
