"""Other tools' reports and feeds as findings and dimensions. Each takes a DataFrame with one JSON document in ``value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.functions.levels import score_band
from auditweave.functions.text import first_cwe, masked

#: Severity words of the tools.
LEVELS = {"error": "High", "warning": "Medium", "note": "Low", "none": "Informational"}
WORDS = {"critical": "Critical", "high": "High", "moderate": "Medium", "medium": "Medium", "low": "Low"}
TEXT = 200


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def named(value: Column, words: dict[str, str], default: str = "Medium") -> Column:
    out = F.lit(default)
    for k, v in words.items():
        out = F.when(F.lower(value) == k, v).otherwise(out)
    return out


def finding(rows: DataFrame, source: str, verdict: str, **columns: Column) -> DataFrame:
    path = F.replace(F.coalesce(columns.pop("file"), F.lit("?")), F.lit("\\"), F.lit("/"))
    package = columns.pop("package", F.lit(""))
    return rows.select(*(c.alias(n) for n, c in columns.items()), F.lit("high").alias("confidence"), path.alias("file"), F.lit(source).alias("source"), F.lit(verdict).alias("verdict"), package.alias("package"))


SARIF = """runs array<struct<tool: struct<driver: struct<rules: array<struct<id: string, name: string, properties: struct<`security-severity`: string, tags: array<string>, cwe: array<string>>>>>>,
  results: array<struct<ruleId: string, level: string, message: struct<text: string>, properties: struct<`security-severity`: string, tags: array<string>, cwe: array<string>>,
  locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>>>>>>"""


def sarif_findings(docs: DataFrame) -> DataFrame:
    """Results joined to their run's rules by id; a result's own properties win over its rule's."""
    runs = docs.select(F.explode(F.from_json("value", SARIF)["runs"]).alias("run"))
    rows = runs.select(F.explode("run.results").alias("r"), F.col("run.tool.driver.rules").alias("rules"))
    rule_id = F.coalesce("r.ruleId", F.lit("semgrep-rule"))
    rows = rows.withColumn("id", rule_id).withColumn("rule", F.try_element_at(F.filter("rules", lambda x: x["id"] == rule_id), F.lit(-1)))
    pick = lambda k: F.coalesce(F.col("r.properties")[k], F.col("rule.properties")[k])
    tags = F.array_join(F.coalesce(F.when(F.size(pick("tags")) > 0, pick("tags")), pick("cwe"), F.array().cast("array<string>")), " ")
    place, text = F.try_element_at("r.locations", F.lit(1))["physicalLocation"], F.coalesce("r.message.text", F.lit(""))
    severity = F.when(pick("security-severity").isNotNull(), score_band(pick("security-severity"))).otherwise(named(F.coalesce("r.level", F.lit("warning")), LEVELS))
    return finding(rows, "semgrep", "unverified", detector_id=F.concat(F.lit("semgrep:"), "id"), title=F.substring(F.coalesce("r.message.text", "id"), 1, TEXT), severity=severity, cwe=first_cwe(F.coalesce("rule.name", F.lit("")), tags, F.col("id")), owasp=F.lit("A03"),
                   file=place["artifactLocation"]["uri"], line=F.coalesce(F.nullif(place["region"]["startLine"], F.lit(0)), F.lit(1)), evidence=F.substring(text, 1, TEXT))


def gitleaks_findings(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.explode(F.from_json("value", "array<struct<RuleID: string, Description: string, File: string, StartLine: int, Secret: string, Match: string>>")).alias("s")).select("s.*")
    rule, secret = F.coalesce("RuleID", F.lit("secret")), F.coalesce(F.nullif("Secret", F.lit("")), F.nullif("Match", F.lit("")))
    return finding(rows, "gitleaks", "confirmed", detector_id=F.concat(F.lit("gitleaks:"), rule), title=F.substring(F.concat(F.lit("Hardcoded secret: "), F.coalesce("Description", rule)), 1, TEXT), severity=F.lit("High"), cwe=F.lit("CWE-798"), owasp=F.lit("A07"),
                   file=F.col("File"), line=F.coalesce(F.nullif("StartLine", F.lit(0)), F.lit(1)), evidence=F.concat(rule, F.lit(" (masked: "), F.coalesce(masked(secret), F.lit("****")), F.lit(")")))


OSV = "results array<struct<source: struct<path: string>, packages: array<struct<package: struct<name: string, version: string>, vulnerabilities: array<struct<id: string, summary: string, database_specific: struct<severity: string>>>>>>>"


def osv_findings(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.explode(F.from_json("value", OSV)["results"]).alias("r")).select("r.source.path", F.explode("r.packages").alias("p")).select("path", "p.package.name", "p.package.version", F.explode("p.vulnerabilities").alias("v"))
    name, version, vid = F.coalesce("name", F.lit("?")), F.coalesce("version", F.lit("?")), F.coalesce("v.id", F.lit("OSV"))
    return finding(rows, "osv", "confirmed", detector_id=F.concat(F.lit("osv:"), vid), title=F.substring(F.concat(F.lit("Vulnerable dependency: "), name, F.lit("@"), version, F.lit(" ("), vid, F.lit(")")), 1, TEXT),
                   severity=named(F.col("v.database_specific.severity"), WORDS), cwe=first_cwe(F.coalesce("v.summary", F.lit(""))), owasp=F.lit("A06"), file=F.coalesce("path", F.lit("dependencies")), line=F.lit(1),
                   evidence=F.substring(F.coalesce(F.nullif("v.summary", F.lit("")), vid), 1, TEXT), package=name)


def npm_audit_findings(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.explode(F.from_json("value", "vulnerabilities map<string, struct<severity: string>>")["vulnerabilities"]).alias("name", "v"))
    return finding(rows, "npm-audit", "confirmed", detector_id=F.lit("DEP-NPM"), title=F.concat(F.lit("Vulnerable dependency: "), "name"), severity=named(F.coalesce("v.severity", F.lit("moderate")), WORDS | {"info": "Informational"}), cwe=F.lit("CWE-1395"), owasp=F.lit("A06"),
                   file=F.lit("package.json"), line=F.lit(1), evidence=F.concat("name", F.lit(": "), F.coalesce("v.severity", F.lit("?")), F.lit(" severity (npm audit)")), package=F.col("name"))


MANIFEST = "name string, version string, dependencies map<string, string>, optionalDependencies map<string, string>, peerDependencies map<string, string>, devDependencies map<string, string>"


def declared_dependencies(docs: DataFrame) -> DataFrame:
    """package, in_runtime, in_dev of manifests; what is needed at run time is not dev."""
    m = docs.select(F.from_json("value", MANIFEST).alias("m")).select("m.*")
    keys = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    run = F.array_union(F.array_union(keys("dependencies"), keys("optionalDependencies")), keys("peerDependencies"))
    rows = m.select(run.alias("run"), F.array_except(keys("devDependencies"), run).alias("dev"))
    return rows.select(F.explode("run").alias("package"), F.lit(True).alias("r")).union(rows.select(F.explode("dev").alias("package"), F.lit(False))).groupBy("package").agg(F.bool_or("r").alias("in_runtime"), F.bool_and(~F.col("r")).alias("in_dev"))


def locked_versions(docs: DataFrame) -> DataFrame:
    """package, version of lock files; top-level entries of ``packages`` win over ``dependencies``."""
    m = docs.select(F.from_json("value", "dependencies map<string, struct<version: string>>, packages map<string, struct<name: string, version: string>>").alias("m")).select("m.*")
    old = m.select(F.explode("dependencies").alias("package", "v")).select("package", "v.version", F.lit(1).alias("rank"))
    new = m.select(F.explode("packages").alias("path", "v")).filter(F.col("path").rlike(r"^node_modules/(?:@[^/]+/)?[^/]+$")).select(F.coalesce("v.name", F.substring("path", 14, 1 << 20)).alias("package"), "v.version", F.lit(0).alias("rank"))
    return old.union(new).filter("version is not null").groupBy("package").agg(F.min_by("version", F.struct("rank", "version")).alias("version"))


def known_exploited(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.from_json("value", "vulnerabilities array<struct<cveID: string>>")["vulnerabilities"]["cveID"]).alias("cve")).filter("cve <> ''").select(F.upper("cve").alias("cve")).distinct()


def exploit_scores(docs: DataFrame) -> DataFrame:
    """cve, score; rows without a number are left out."""
    rows = docs.select(F.explode(F.from_json("value", "data array<struct<cve: string, epss: string>>")["data"]).alias("d")).select(F.upper("d.cve").alias("cve"), F.col("d.epss").try_cast("double").alias("score"))
    return rows.filter("cve <> '' and score is not null")
