"""A training corpus from documents: quality, near duplicates, secrets, mix, tokens.

Every stage takes what its predecessor kept, as Parquet. All but the last return the columns of documents.

Edge cases, in every stage: a null text is a text without words, judged by its statistics in the first stage, linked with
nothing in the second, left as it is in the third, never taken by the fourth; an empty text likewise; a null doc_id is a
document of its own throughout; of repeated rows of a doc_id one passes the second stage; ties go by the smallest doc_id
there and by hashes in the fourth; texts of any length are handled whole; an empty table gives an empty table of the same
columns; further columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.llm.bpe import bpe_round_trip
from auditweave.llm.mixing import resampled
from auditweave.llm.ngram_join import deduplicated
from auditweave.llm.rulefit import accepted
from auditweave.llm.secrets import redacted
from auditweave.llm.shared import delete, ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labelled rows outside its held-out fold."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars in step."""
    kept = redacted(docs)
    return kept.withColumn("n_chars", F.when(F.contains("text", F.lit("[SECRET]")), F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else kept


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks; some not at all."""
    return resampled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of ids and decoded text."""
    return bpe_round_trip(docs, keep_ids=True)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("mixing sources", mixing), ("BPE encoding", tokens)]

#: Trained models and hashed random choices are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over documents. Stages in between are written to the shared checkpoint folder; each goes when the next is there.

    The result is read lazily from the last of them, which stays as long as the result may be asked for."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
