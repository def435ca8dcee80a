"""Sinks: findings and components as JSON documents, built by Spark.

Each function returns a DataFrame with one ``value`` column, ready for ``write.text``; a document's rows are gathered by
one aggregation, since a report is one document. For sets that no document should hold, write the frames themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.functions.levels import SEVERITIES, severity_rank
from auditweave.functions.text import purl, spdx_id

#: SARIF scores and levels, and the three severities of the other report form.
SARIF_SCORE = {"Critical": "9.5", "High": "8.0", "Medium": "5.0", "Low": "3.0", "Informational": "1.0"}
SARIF_LEVEL = {"Critical": "error", "High": "error", "Medium": "warning", "Low": "note", "Informational": "note"}
THREE = {"Critical": "ERROR", "High": "ERROR", "Medium": "WARNING", "Low": "INFO", "Informational": "INFO"}


def mapped(value: Column, words: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in words.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def rank_order(*then: str) -> list[Column]:
    return [severity_rank(F.col("severity")).desc(), F.col("file"), F.col("line"), *map(F.col, then)]


def gathered(rows: DataFrame, item: Column, order: list[Column]) -> DataFrame:
    """One row: items, the structs in order."""
    numbered = rows.withColumn("_at", F.row_number().over(Window.orderBy(*order)))
    return numbered.agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", item.alias("item")))), lambda x: x["item"]).alias("items"))


def json_report(findings: DataFrame, target: str) -> DataFrame:
    counts = findings.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    body = gathered(findings, F.struct(*findings.columns), rank_order("detector_id"))
    return body.crossJoin(counts).select(F.to_json(F.struct(F.lit(target).alias("target"), F.struct(*SEVERITIES).alias("counts"), F.col("items").alias("findings"))).alias("value"))


def sarif_report(findings: DataFrame, tool: str = "auditweave", version: str = "1.0.0") -> DataFrame:
    """findings need fingerprint (operators.diff.sarif_fingerprint), title, owasp. Rules in order of first appearance."""
    order = rank_order("detector_id")
    rows = findings.withColumn("_at", F.row_number().over(Window.orderBy(*order)))
    first = rows.groupBy("detector_id").agg(F.min(F.struct("_at", "title", "cwe", "owasp", "severity")).alias("f")).withColumn("rule_index", F.row_number().over(Window.orderBy("f._at")) - 1)
    rule = F.struct(F.col("detector_id").alias("id"), F.replace("detector_id", F.lit(":"), F.lit("_")).alias("name"), F.struct(F.substring("f.title", 1, 120).alias("text")).alias("shortDescription"),
                    F.struct(F.array("f.cwe", F.concat(F.lit("OWASP-"), "f.owasp"), F.lit("security")).alias("tags"), mapped(F.col("f.severity"), SARIF_SCORE, "5.0").alias("security-severity")).alias("properties"))
    rules = gathered(first, rule, [F.col("rule_index")]).withColumnRenamed("items", "rules")
    place = F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.col("line"), F.lit(1)).alias("startLine")).alias("region"))
    result = F.struct(F.col("detector_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), mapped(F.col("severity"), SARIF_LEVEL, "warning").alias("level"), F.struct(F.concat("title", F.lit(" ("), "cwe", F.lit(", OWASP "), "owasp", F.lit(")."),).alias("text")).alias("message"),
                      F.array(F.struct(place.alias("physicalLocation"))).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"))
    results = gathered(rows.join(first.select("detector_id", "rule_index"), "detector_id"), result, [F.col("_at")])
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.col("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("items").alias("results"))
    return results.crossJoin(rules).select(F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("value"))


def scanner_report(findings: DataFrame) -> DataFrame:
    """The report form with three severities and the scanned paths."""
    point = F.struct(F.greatest(F.col("line"), F.lit(1)).alias("line"), F.lit(1).alias("col"))
    item = F.struct(F.col("detector_id").alias("check_id"), F.col("file").alias("path"), point.alias("start"), point.alias("end"), F.struct(F.col("title").alias("message"), mapped(F.col("severity"), THREE, "WARNING").alias("severity"), F.col("evidence").alias("lines"), F.struct(F.array("cwe").alias("cwe"), "confidence", "source").alias("metadata")).alias("extra"))
    paths = findings.agg(F.array_sort(F.collect_set("file")).alias("scanned"))
    return gathered(findings, item, rank_order("detector_id")).crossJoin(paths).select(F.to_json(F.struct(F.col("items").alias("results"), F.struct("scanned").alias("paths"))).alias("value"))


def vex_document(findings: DataFrame, document_id: str, author: str, timestamp: str) -> DataFrame:
    """Statements of findings with a package and a status; empty justifications are left out."""
    rows = findings.filter("package <> '' and vex_status <> ''")
    item = F.struct(F.struct(F.col("detector_id").alias("name")).alias("vulnerability"), F.array(F.struct(F.concat(F.lit("pkg:npm/"), "package").alias("@id"))).alias("products"), F.col("vex_status").alias("status"), F.nullif("vex_justification", F.lit("")).alias("justification"))
    head = [F.lit("https://openvex.dev/ns/v0.2.0").alias("@context"), F.lit(document_id).alias("@id"), F.lit(author).alias("author"), F.lit(timestamp).alias("timestamp"), F.lit(1).alias("version")]
    return gathered(rows, item, [F.col("package"), F.col("detector_id")]).select(F.to_json(F.struct(*head, F.col("items").alias("statements"))).alias("value"))


def resolved_components(declared: DataFrame, locked: DataFrame) -> DataFrame:
    """name, version (empty if unresolved), purl of declared packages."""
    version = F.coalesce("version", F.lit(""))
    return declared.select(F.col("package").alias("name")).distinct().join(locked.withColumnRenamed("package", "name"), "name", "left").select("name", version.alias("version"), purl(F.col("name"), version).alias("purl"))


def cyclonedx_document(components: DataFrame, name: str, version: str) -> DataFrame:
    found = F.when(F.col("version") != "", F.col("version"))
    item = F.struct(F.lit("library").alias("type"), "name", found.alias("version"), "purl", F.col("purl").alias("bom-ref"), F.when(F.col("version") == "", F.array(F.struct(F.lit("version").alias("name"), F.lit("unresolved").alias("value")))).alias("properties"))
    head = [F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"), F.lit(1).alias("version"), F.struct(F.struct(F.lit("application").alias("type"), F.lit(name).alias("name"), F.lit(version).alias("version")).alias("component")).alias("metadata")]
    return gathered(components, item, [F.col("name")]).select(F.to_json(F.struct(*head, F.col("items").alias("components"))).alias("value"))


def spdx_document(components: DataFrame, name: str, namespace: str, created: str) -> DataFrame:
    pid = F.concat(F.lit("SPDXRef-Package-"), spdx_id(F.col("name")))
    item = F.struct(pid.alias("SPDXID"), "name", F.when(F.col("version") != "", F.col("version")).alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"))
    edges = F.concat(F.array(F.struct(F.lit("SPDXRef-DOCUMENT").alias("spdxElementId"), F.lit("DESCRIBES").alias("relationshipType"), F.lit("SPDXRef-Root").alias("relatedSpdxElement"))),
                     F.transform("items", lambda x: F.struct(F.lit("SPDXRef-Root").alias("spdxElementId"), F.lit("DEPENDS_ON").alias("relationshipType"), x["SPDXID"].alias("relatedSpdxElement"))))
    head = [F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.lit(name).alias("name"), F.lit(namespace).alias("documentNamespace"), F.struct(F.lit(created).alias("created")).alias("creationInfo")]
    return gathered(components, item, [F.col("name")]).select(F.to_json(F.struct(*head, F.col("items").alias("packages"), edges.alias("relationships"))).alias("value"))
