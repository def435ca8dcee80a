"""Six calls for tools that drive the engine: each takes a session and plain values, and gives DataFrames or plain rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.functions.rules import RULES, SUPERSEDED, group_of, rules_of
from auditweave.operators import compliance, findings, flow, php, redos, ruleindex, structural
from auditweave.sources import exports, files, reports


def scan_source(spark: SparkSession, root: str, only: set[str] | None = None) -> DataFrame:
    """All source tiers over a tree, resolved: patterns, data flow (PHP values too), structural rules, costly expressions. Build folders that a manifest publishes belong to the tree."""
    tree = files.with_vendored(files.with_own_release(files.project_files(spark, root))).filter("not vendored")
    own = ruleindex.indexed_findings(files.with_code_view(tree), rules_of(only))
    tiers = [own.select("detector_id", "severity", "confidence", "cwe", "file", "line", "evidence", "source", "rule_ord", "start")]
    lines = tree.select("file", F.split("text", "\n", -1).alias("_lines"))
    for found, source in ((flow.project_paths(tree).withColumnRenamed("sink_id", "detector_id"), "taint"), (structural.structural_findings(tree), "structural"), (redos.redos_findings(tree), "redos"), (php.php_paths(tree, None).withColumnRenamed("sink_id", "detector_id"), "taint")) if only is None else ():
        shown = F.substring(F.trim(F.try_element_at("_lines", F.col("line"))), 1, 200)
        rows = found.drop("evidence").join(lines, "file", "left")
        tiers.append(rows.select("detector_id", "severity", "confidence", "cwe", "file", "line", F.coalesce(shown, F.lit("")).alias("evidence"), F.lit(source).alias("source"), F.lit(0).alias("rule_ord"), F.lit(0).alias("start")))
    return findings.deduplicated(findings.union_of_tiers(tiers), SUPERSEDED, ["tier", "rule_ord", "start"])


def scan_dependencies(spark: SparkSession, audit: str) -> DataFrame:
    """Advisories of a package audit report."""
    return reports.npm_audit_findings(reports.documents(spark, audit))


def generate_sbom(components: DataFrame, name: str, version: str) -> DataFrame:
    return exports.cyclonedx_document(components, name, version)


def compliance_pack(found: DataFrame) -> DataFrame:
    return compliance.register(found)


def explain_finding(detector_id: str) -> dict[str, str]:
    """What a rule looks for; empty for an unknown one."""
    return next(({"id": r.id, "title": r.title, "cwe": r.cwe, "severity": r.severity, "confidence": r.confidence, "owasp": r.owasp, "group": group_of(r.id)} for r in RULES if r.id == detector_id), {})


def coverage(spark: SparkSession) -> DataFrame:
    """(group, n): rules by group."""
    return spark.createDataFrame([(group_of(r.id),) for r in RULES], "group string").groupBy("group").agg(F.count("*").alias("n"))
