"""Registered queries of the training-data operators: key -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketflow.llm import language, oracles, secrets, toxicity
from marketflow.llm.ball_search import ranked
from marketflow.llm.common import fold_of, read_table
from marketflow.llm.decontaminate import contaminated
from marketflow.llm.graph_ann import nearest
from marketflow.llm.jaccard_join import similar_sets
from marketflow.llm.mixing import pareto_mix
from marketflow.llm.prefix_free import remove_repeats
from marketflow.llm.sentences import dedup_spans
from marketflow.llm.simhash import near_duplicates
from marketflow.llm.spelling import spelling_groups
from marketflow.llm.wrapper import extract

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@query("op1_graph_ann")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    lexicon = toxicity.train(toxicity.training_rows(docs, read_table(spark, sf_dir, "labels"), held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.scorer(lexicon)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op4_sentence_span_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(read_table(spark, sf_dir, "documents"))


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op6_prefix_free_dedup", oracles.PREFIX_FREE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


@query("op7_html_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


@query("op8_mixing", oracles.MIXING)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op9_secret_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), 4) == 2)


@query("op11_spelling_groups", oracles.SPELLING)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(read_table(spark, sf_dir, "documents"))


@query("op12_jaccard_join", oracles.SIMILAR_SETS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(read_table(spark, sf_dir, "documents"))


@query("op13_ranked_search", oracles.RANKED)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
