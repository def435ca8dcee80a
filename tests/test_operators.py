import pytest
from pyspark.sql import functions as F

from auditweave.functions import levels, text
from auditweave.operators import dependencies, diff, findings, intervals, patterns, scoring
from auditweave.operators.patterns import Rule

FINDING = "detector_id string, severity string, confidence string, cwe string, file string, line int, source string, evidence string, taint_path string, seq int"


def rows(spark, *data):
    return spark.createDataFrame([(*d, i) for i, d in enumerate(data)], FINDING)


def test_two_close_findings_both_survive(spark):
    code = 'a\nb\ndb.query("x" + a)\nc\n\ndb.query("y" + b)\n'
    rule = Rule("T-JS-SQLI", "t", "CWE-89", "Critical", r"\bdb\.query\(\"\w\" \+ \w", (".js",))
    found = patterns.pattern_findings(spark.createDataFrame([("src/a.js", ".js", code), ("tests/a.js", ".js", code)], "file string, ext string, text string"), [rule])
    assert [(r.file, r.line) for r in found.orderBy("line").collect()] == [("src/a.js", 3), ("src/a.js", 6)]


def test_rule_conditions(spark):
    files = spark.createDataFrame([("a.py", ".py", "x = 1\nx = 2 # ok\nX = 3"), ("b.py", ".py", "x = 1\nwaived"), ("Dockerfile", "", "x = 1")], "file string, ext string, text string")
    got = lambda **k: sorted((r.file, r.line) for r in patterns.pattern_findings(files, [Rule("T-PY-X", "t", "CWE-1", "Low", r"^x = \d", (".py", "Dockerfile"), **k)]).collect())
    assert got() == [("Dockerfile", 1), ("a.py", 1), ("a.py", 2), ("a.py", 3), ("b.py", 1)]
    assert got(case_sensitive=True) == [("Dockerfile", 1), ("a.py", 1), ("a.py", 2), ("b.py", 1)]
    assert got(suppress_if="waived", suppress_line_if="# ok", once_per_file=True) == [("Dockerfile", 1), ("a.py", 1)]
    assert got(requires_in_file="waived") == [("b.py", 1)]


def test_corroboration_is_one_to_one_and_nearest(spark):
    df = rows(
        spark, ("P1", "High", "medium", "CWE-89", "f", 3, "builtin", "", ""), ("P2", "High", "medium", "CWE-89", "f", 6, "builtin", "", ""), ("Q1", "High", "high", "CWE-89", "f", 5, "taint", "", "p"),
        ("Q2", "High", "medium", "CWE-89", "f", 20, "taint", "", "q"), ("P3", "High", "medium", "CWE-79", "f", 5, "builtin", "", ""),
    )
    got = {r.detector_id: (r.confidence, r.taint_path) for r in findings.corroborated(df, ["seq"]).collect()}
    assert got == {"P1": ("medium", ""), "P2": ("high", "p"), "Q2": ("medium", "q"), "P3": ("medium", "")}


def test_dedupe_stages(spark):
    df = rows(
        spark, ("A", "High", "high", "CWE-1", "f", 1, "builtin", "first", ""), ("A", "High", "high", "CWE-1", "f", 1, "semgrep", "second", ""), ("B", "High", "high", "CWE-1", "f", 1, "taint", "", ""),
        ("GENERIC", "Low", "high", "CWE-2", "f", 2, "builtin", "", ""), ("PRECISE", "Low", "high", "CWE-3", "f", 2, "builtin", "", ""), ("GENERIC", "Low", "high", "CWE-2", "f", 9, "builtin", "", ""),
    )
    got = sorted((r.detector_id, r.line) for r in findings.deduplicated(df, {"GENERIC": ("PRECISE",)}, ["seq"]).collect())
    assert got == [("B", 1), ("GENERIC", 9), ("PRECISE", 2)]


def test_diff_of_drifting_and_repeated_lines(spark):
    old = rows(spark, ("A", "High", "high", "C", "f", 1, "b", "same  line", ""), ("A", "High", "high", "C", "f", 2, "b", "same line", ""), ("A", "High", "high", "C", "f", 9, "b", "gone", ""))
    new = rows(spark, ("A", "High", "high", "C", "f", 6, "b", "same line", ""), ("A", "High", "high", "C", "f", 7, "b", "same line ", ""), ("A", "High", "high", "C", "f", 8, "b", "same line", ""))
    got = sorted((r.change, r.line, r.baseline_line) for r in diff.snapshot_diff(old, new, ["seq"]).collect())
    assert got == [("introduced", 8, None), ("moved", 6, 1), ("moved", 7, 2), ("resolved", 9, 9), ("unchanged", 6, 1), ("unchanged", 7, 2)]


@pytest.mark.parametrize(
    ("indexable", "run", "dev", "in_dev", "in_run", "want"),
    [
        (False, 1, 1, True, True, ("under_investigation", "")), (True, 1, 1, True, True, ("affected", "")), (True, 0, 1, True, False, ("not_affected", "component_not_present")), (True, 0, 1, False, True, ("under_investigation", "")),
        (True, 0, 0, True, True, ("not_affected", "component_not_present")), (True, 0, 0, False, True, ("not_affected", "vulnerable_code_not_present")), (True, 0, 0, False, False, ("under_investigation", "")),
    ],
)
def test_vex_decisions(spark, indexable, run, dev, in_dev, in_run, want):
    a = spark.createDataFrame([("p", indexable, "Critical")], "package string, indexable boolean, severity string")
    i = spark.createDataFrame([("p", run, dev)], "package string, runtime_importers long, dev_importers long")
    d = spark.createDataFrame([("p", in_dev, in_run)], "package string, in_dev boolean, in_runtime boolean")
    r = dependencies.vex_verdicts(a, i, d).first()
    assert (r.vex_status, r.vex_justification) == want and r.severity == ("Medium" if want[0] == "not_affected" else "Critical")


def test_watch_never_falls_and_blocked_is_not_quiet(spark):
    state = spark.createDataFrame([("c1", "exploited", ""), ("c2", "listed", ""), ("c3", "elevated", ""), ("c4", "unknown", "")], "cve string, exploitation string, exploited_since string")
    now = spark.createDataFrame([("c1", "listed"), ("c2", "exploited"), ("c4", "listed")], "cve string, exploitation string")
    compared = dependencies.watch_compare(state, now)
    assert {r.cve: r.outcome for r in compared.collect()} == {"c1": "still_exploited", "c2": "triggered", "c3": "unchanged", "c4": "escalated"}
    after = {r.cve: (r.exploitation, r.exploited_since) for r in dependencies.watch_advance(state, compared, "2024-05-05").collect()}
    assert after == {"c1": ("exploited", ""), "c2": ("exploited", "2024-05-05"), "c3": ("elevated", ""), "c4": ("listed", "")}
    assert dependencies.watch_compare(state, now, blocked=True).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("@scope/pkg/sub", "pkg/x", "./a", "node:fs")], "a string, b string, c string, d string")
    r = df.select(*(text.package_of(F.col(c)).alias(c) for c in "abcd"), text.masked(F.lit("secret12")).alias("m"), text.first_cwe(F.lit("no"), F.lit("cwe 79 x")).alias("w"), text.cve_of(F.lit("x"), F.lit("osv:cve-2024-12345")).alias("v"),
                  text.extension(F.lit("d/.env")).alias("e"), text.extension(F.lit("d/a.B.JS")).alias("f"), levels.score_band(F.lit("7.5")).alias("s"), levels.lowered(F.lit("Low"), 2).alias("l")).first()
    assert tuple(r) == ("@scope/pkg", "pkg", None, None, "secr****", "CWE-79", "CVE-2024-12345", "", ".js", "High", "Informational")


def test_intervals_and_labels(spark):
    df = spark.createDataFrame([("f", x) for x in (1, 3, 4, 8, 40)], "file string, line int")
    assert sorted((r.start_line, r.end_line, r.n) for r in intervals.islands(df, ["file"], "line", 3).collect()) == [(1, 4, 3), (8, 8, 1), (40, 40, 1)]
    assert sorted((r.start_line, r.end_line) for r in intervals.merged_windows(df, ["file"], "line", 2).collect()) == [(1, 10), (38, 42)]
    labels = spark.createDataFrame([("a", "app/f.js", 5, 6, ["CWE-1"]), ("b", "g.js", 1, 2, ["CWE-2"])], "id string, file string, start_line int, end_line int, cwes array<string>")
    results = spark.createDataFrame([("root/app/f.js", 15, "CWE-9"), ("lib/g.js", 3, "CWE-2")], "file string, line int, cwe string")
    assert {r.id: (r.loose, r.strict) for r in scoring.label_hits(labels, results, 10).collect()} == {"a": (True, False), "b": (True, True)}
    assert {r.id: r.loose for r in scoring.label_hits(labels, results).collect()} == {"a": False, "b": False}


def test_copies_of_a_position_merge_as_one(spark):
    """Windows with equal ends have no order among them; none may fall out of the span that they open."""
    once = [("f", x) for x in (1, 3, 40, 90, 130)]
    want = [("f", 1, 17), ("f", 26, 54), ("f", 76, 104), ("f", 116, 144)]
    for times in (1, 50):
        df = spark.createDataFrame(once * times, "file string, line int").repartition(4)
        assert sorted(map(tuple, intervals.merged_windows(df, ["file"], "line", 14).collect())) == want
