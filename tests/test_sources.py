import json

from pyspark.sql import functions as F

from auditweave.operators.diff import sarif_fingerprint
from auditweave.operators.findings import union_of_tiers
from auditweave.sources import exports, files, reports

DOC = "value string"


def test_file_tree(spark, tmp_path):
    for name, text in {"src/a.py": "x", "node_modules/p/i.js": "x", "dist/d.js": "x", "lib/j.min.js": "x", "lib/b1.js": "/*! one */", "lib/b2.js": "/*! two */", "lib/own.js": "y", "big.txt": "z" * 1_000_001, "w.js": "v" * 600, "Dockerfile": "FROM a"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = {r.file: r for r in files.with_code_view(files.with_vendored(files.source_files(spark, str(tmp_path)))).collect()}
    assert set(got) == {"src/a.py", "lib/j.min.js", "lib/b1.js", "lib/b2.js", "lib/own.js", "w.js", "Dockerfile"}
    assert {f for f, r in got.items() if r.vendored} == {"lib/j.min.js", "lib/b1.js", "lib/b2.js", "lib/own.js", "w.js"}
    assert got["Dockerfile"].code_view is None and got["src/a.py"].code_view == "x"
    assert "dist/d.js" in {r.file for r in files.source_files(spark, str(tmp_path), published=("dist",)).collect()}


def docs(spark, *values):
    return spark.createDataFrame([(json.dumps(v),) for v in values], DOC)


def test_reports_of_other_tools(spark):
    sarif = {"runs": [{"tool": {"driver": {"rules": [{"id": "r1", "name": "CWE-79: xss", "properties": {"security-severity": "9.1"}}]}}, "results": [
        {"ruleId": "r1", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a\\b.js"}, "region": {"startLine": 7}}}]}, {"ruleId": "r2", "level": "note", "message": {"text": "n"}}]}]}
    got = [(r.detector_id, r.severity, r.cwe, r.file, r.line) for r in reports.sarif_findings(docs(spark, sarif)).orderBy("detector_id").collect()]
    assert got == [("semgrep:r1", "Critical", "CWE-79", "a/b.js", 7), ("semgrep:r2", "Low", "CWE-Other", "?", 1)]
    leak = reports.gitleaks_findings(docs(spark, [{"RuleID": "aws", "File": "f", "StartLine": 2, "Secret": "abcdefgh"}])).first()
    assert (leak.detector_id, leak.evidence, leak.verdict) == ("gitleaks:aws", "aws (masked: abcd****)", "confirmed")
    osv = reports.osv_findings(docs(spark, {"results": [{"source": {"path": "p"}, "packages": [{"package": {"name": "n", "version": "1"}, "vulnerabilities": [{"id": "CVE-2020-12345", "database_specific": {"severity": "MODERATE"}}]}]}]})).first()
    assert (osv.detector_id, osv.severity, osv.package, osv.evidence) == ("osv:CVE-2020-12345", "Medium", "n", "CVE-2020-12345")
    npm = reports.npm_audit_findings(docs(spark, {"vulnerabilities": {"x": {"severity": "info"}}})).first()
    assert (npm.severity, npm.package) == ("Informational", "x")
    assert union_of_tiers([reports.sarif_findings(docs(spark, sarif)), reports.npm_audit_findings(docs(spark, {"vulnerabilities": {"x": {}}}))]).count() == 3


def test_manifests_and_feeds(spark):
    declared = reports.declared_dependencies(docs(spark, {"dependencies": {"a": "1"}, "peerDependencies": {"b": "1"}, "devDependencies": {"a": "1", "c": "1"}}))
    assert {r.package: (r.in_runtime, r.in_dev) for r in declared.collect()} == {"a": (True, False), "b": (True, False), "c": (False, True)}
    locked = reports.locked_versions(docs(spark, {"dependencies": {"a": {"version": "0.9"}}, "packages": {"": {}, "node_modules/a": {"version": "1.0"}, "node_modules/a/node_modules/z": {"version": "3"}, "node_modules/@s/c": {"version": "2.0"}}}))
    assert {r.package: r.version for r in locked.collect()} == {"a": "1.0", "@s/c": "2.0"}
    assert [r.cve for r in reports.known_exploited(docs(spark, {"vulnerabilities": [{"cveID": "cve-2020-1"}, {}]})).collect()] == ["CVE-2020-1"]
    assert [(r.cve, r.score) for r in reports.exploit_scores(docs(spark, {"data": [{"cve": "C", "epss": "0.5"}, {"cve": "D", "epss": "x"}]})).collect()] == [("C", 0.5)]
    parts = exports.resolved_components(declared, locked)
    bom = json.loads(exports.cyclonedx_document(parts, "app", "1").first().value)
    assert [(c["name"], c.get("version")) for c in bom["components"]] == [("a", "1.0"), ("b", None), ("c", None)]
    spdx = json.loads(exports.spdx_document(parts, "app", "urn:x", "2024-01-01T00:00:00Z").first().value)
    assert len(spdx["relationships"]) == 4


def test_documents_of_findings(spark):
    rows = [("A", "t", "Low", "high", "CWE-1", "A01", "f", 3, "e", "b", "", "", ""), ("B", "t", "High", "high", "CWE-2", "A02", "g", 1, "e", "b", "pkg", "not_affected", "component_not_present"), ("A", "t", "Low", "high", "CWE-1", "A01", "f", 9, "e", "b", "", "", "")]
    df = spark.createDataFrame(rows, "detector_id string, title string, severity string, confidence string, cwe string, owasp string, file string, line int, evidence string, source string, package string, vex_status string, vex_justification string")
    report = json.loads(exports.json_report(df, "x").first().value)
    assert [f["detector_id"] for f in report["findings"]] == ["B", "A", "A"] and report["counts"]["Low"] == 2 and report["counts"]["Critical"] == 0
    sarif = json.loads(exports.sarif_report(sarif_fingerprint(df, ["line"])).first().value)["runs"][0]
    assert [r["id"] for r in sarif["tool"]["driver"]["rules"]] == ["B", "A"] and [r["ruleIndex"] for r in sarif["results"]] == [0, 1, 1]
    assert len({r["partialFingerprints"]["primary"] for r in sarif["results"]}) == 3
    assert json.loads(exports.scanner_report(df).first().value)["paths"]["scanned"] == ["f", "g"]
    vex = json.loads(exports.vex_document(df, "id", "me", "2024-01-01").first().value)
    assert vex["statements"][0]["justification"] == "component_not_present" and len(vex["statements"]) == 1
