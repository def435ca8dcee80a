"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditweave.llm import sql
from auditweave.llm.bpe import bpe_round_trip
from auditweave.llm.forest import quality_rules
from auditweave.llm.media import store_and_sniff
from auditweave.llm.mixing import mixed
from auditweave.llm.negatives import mined
from auditweave.llm.ngram_join import near_duplicates
from auditweave.llm.periodic import periodic_runs, run_digest, with_repeats
from auditweave.llm.pii import personal_digest
from auditweave.llm.rulefit import quality_scores
from auditweave.llm.secrets import secret_digest
from auditweave.llm.substrings import removed_passages
from auditweave.llm.toxicity import toxicity_scores
from auditweave.llm.warc import derivatives, responses


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_passages(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_sniff(table(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "embeddings"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_digest(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(periodic_runs(with_repeats(table(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_rules": op4_rules,
    "op5_mixing": op5_mixing,
    "op6_ngram_join": op6_ngram_join,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_media": op10_media,
    "op11_negatives": op11_negatives,
    "op12_pii": op12_pii,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {"op1_substrings": sql.OP1, "op2_secrets": sql.OP2, "op6_ngram_join": sql.OP6, "op7_warc": sql.OP7, "op11_negatives": sql.OP11}
