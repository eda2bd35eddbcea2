"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from marketflow.llm import stages
from marketflow.session import scratch_path
from marketflow.sources import store

STAGES = [
    ("toxicity", stages.reject_toxic),
    ("simhash_near_dedup", stages.simhash_near_dedup),
    ("benchmark_decontamination", stages.decontaminate),
    ("secret_scans", stages.redact_secrets),
    ("mixing", stages.mixing),
]

#: Fingerprints and trained models cannot be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table, in order, through Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = scratch_path(spark, f"corpus-pipeline-{uuid.uuid4().hex}"), None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before is not None:
            store.remove(spark, before)  # what the next stage has written does not need it any more
        before = out
    return docs
