"""The portable part of the rule dimension as a rule pack of another scanner."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.operators.patterns import Rule

#: Fixed value: a counted repeat that other engines would unroll.
UNROLLED = 1000
THREE = {"Critical": "ERROR", "High": "ERROR", "Medium": "WARNING", "Low": "INFO", "Informational": "INFO"}


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """One row a rule, with the reason that keeps it from being exported (empty: it is portable)."""

    def withheld(r: Rule) -> str:
        if r.code_shape:
            return "matches a view without comments and literals"
        if r.suppress_if:
            return "cleared by a pattern anywhere in the file"
        if r.suppress_line_if:
            return "cleared by a pattern on the line"
        if r.requires_in_file:
            return "asks for a pattern elsewhere in the file"
        if any(int(n) > UNROLLED for n in re.findall(r"\{\d*,(\d+)\}", r.pattern)):
            return "repeats a group too often to be unrolled"
        return ""

    rows = [(k, r.id, r.title, r.cwe, r.severity, r.confidence, r.owasp, r.pattern, r.case_sensitive, list(r.exts), withheld(r)) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, "ord int, id string, title string, cwe string, severity string, confidence string, owasp string, pattern string, case_sensitive boolean, exts array<string>, withheld string")


def rule_pack(rules: DataFrame) -> DataFrame:
    """One row: the portable rules as a JSON rule pack (JSON is YAML)."""
    severity = F.create_map(*(F.lit(x) for kv in THREE.items() for x in kv))
    pattern = F.concat(F.when(F.col("case_sensitive"), F.lit("(?m)")).otherwise("(?im)"), "pattern")
    paths = F.transform("exts", lambda e: F.when(e.startswith("."), F.concat(F.lit("*"), e)).otherwise(e))
    item = F.struct(F.lower("id").alias("id"), F.col("title").alias("message"), severity[F.col("severity")].alias("severity"), F.array(F.lit("generic")).alias("languages"), pattern.alias("pattern-regex"), F.struct(paths.alias("include")).alias("paths"), F.struct(F.array("cwe").alias("cwe"), "owasp", "confidence").alias("metadata"))
    items = rules.filter("withheld = ''").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("rule")))), lambda x: x["rule"]).alias("rules"))
    return items.select(F.to_json(F.struct("rules")).alias("value"))
