"""The driver's tables read as the relations that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.operators.patterns import Rule, pattern_findings

LANGS = ("en", "fr", "de", "es")
#: A small rule dimension for prose; ASCII patterns without word borders, which Java and RE2 see differently beside other letters.
TEXT_RULES = (
    Rule("TXT-SECRET-TOKEN", "Token assigned in text", "CWE-798", "High", 'token = "[0-9a-f]{40}"', LANGS, mask=True, case_sensitive=True, python_dialect=False),
    Rule("TXT-SECRET-HEX", "Long hexadecimal string", "CWE-798", "Medium", "[0-9a-f]{32,}", LANGS, confidence="medium", mask=True, superseded_by=("TXT-SECRET-TOKEN",), python_dialect=False),
    Rule("TXT-PII-MAIL", "Mail address", "CWE-359", "Medium", r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]*[A-Za-z0-9]", LANGS, python_dialect=False),
    Rule("TXT-PII-CARD", "Number of sixteen digits or more", "CWE-311", "Critical", "[0-9]{16,19}", LANGS, python_dialect=False),
    Rule("TXT-NET-IPV4", "IPv4 address", "CWE-200", "Low", "(?:[0-9]{1,3}[.]){3}[0-9]{1,3}", LANGS, suppress_line_if="127[.]0[.]0[.]1", python_dialect=False),
    Rule("TXT-STYLE-SHOUT", "Shouted words", "CWE-1078", "Informational", "[A-Z]{4,}!!", LANGS, once_per_file=True, python_dialect=False),
    Rule("TXT-STYLE-SYMBOLS", "Symbols in a row", "CWE-1078", "Informational", r"[#*$%&]{3}", LANGS, once_per_file=True, requires_in_file=r"[#*$%&]{3}\s+\S+[#*$%&]{3}", python_dialect=False),
    Rule("TXT-LICENSE-LINE", "License line", "CWE-1357", "Low", r"(?:[Ll]icensed|[Cc]opyright) ", ("en",), suppress_if=r"All rights waived", python_dialect=False),
)
SUPERSEDED = {r.id: r.superseded_by for r in TEXT_RULES if r.superseded_by}
ORDER = ["rule_ord", "start"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return table(spark, sf_dir, "documents").select(path.alias("file"), F.col("lang").alias("ext"), F.coalesce("text", F.lit("")).alias("text"), "doc_id", "source")


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_findings(files(spark, sf_dir).withColumnRenamed("source", "origin"), TEXT_RULES, ["doc_id", "origin"])


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern tier and two tiers that other tools would give over the same files, from one scan: each finding is repeated for the tiers that its document's number chooses."""
    of_doc = lambda k, n: F.when(F.col("doc_id") % n == 0, F.array(F.lit(k))).otherwise(F.array().cast("array<int>"))
    rows = scan(spark, sf_dir).withColumn("tier", F.explode(F.concat(F.array(F.lit(0)), of_doc(1, 2), of_doc(2, 3))))
    by_tier = lambda name, second, third: F.when(F.col("tier") == 1, second).when(F.col("tier") == 2, third).otherwise(F.col(name))
    return rows.withColumns({"source": by_tier("source", F.lit("gitleaks"), F.lit("taint")), "evidence": by_tier("evidence", F.lit("tool"), F.col("evidence")), "detector_id": by_tier("detector_id", F.col("detector_id"), F.concat(F.lit("T-"), "detector_id"))})


TIER_ORDER = ["tier", "rule_ord", "start"]
