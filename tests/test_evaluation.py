"""Evaluation rows that no registered query covers, and the merges of model replies in odd cases."""

import pytest
from pyspark.sql import functions as F

from auditweave.operators import evaluation as E
from auditweave.operators import model_merge as M


def test_markers_and_golden_rows(spark):
    text = "a\n// V1 — one\nb\n# S8 - two\nc\nd\n"
    regions = E.marker_regions(spark.createDataFrame([("f", text), ("g", "none")], "file string, text string"))
    assert [tuple(r) for r in regions.orderBy("start_line").collect()] == [("f", "V1", 2, 3), ("f", "S8", 4, 6)]
    lines = spark.createDataFrame([("| V1 | SQL injection | A05 / CWE-502/94/95 | `db.js` line |",), ("| V2 | Odd | none | x |",), ("| id | class | m | p |",)], "value string")
    assert [(r.id, r["class"], r.owasp, r.cwes) for r in E.golden_rows(lines).collect()] == [("V1", "SQL injection", "A05", ["CWE-502", "CWE-94", "CWE-95"]), ("V2", "Odd", "", ["CWE-Other"])]


def test_sink_hits_samples_and_unmatched(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"class": "redos", "package": "p", "version": "1", "sink": "lib/a.js:18:3"}\n{"class": "path-traversal", "package": "q", "version": "1", "sink": "b.js:2"}\n')
    entries = E.sink_entries(spark, str(tmp_path)).withColumn("id", F.col("package"))
    files = spark.createDataFrame([("p", "lib/a.js", 40), ("q", "b.js", 9)], "package string, file string, lines int")
    found = spark.createDataFrame([("p", "lib/a.js", 26, "CWE-1321"), ("p", "lib/a.js", 28, "CWE-1333"), ("q", "b.js", 13, "CWE-22")], "package string, file string, line int, cwe string")
    hits = E.sink_hits(E.resolved_sinks(entries, files), found)
    assert {r.id: r.hit for r in hits.collect()} == {"p": True, "q": False}
    misses = hits.filter("not hit").withColumn("sealed", F.lit(False))
    assert [r.id for r in E.samples_of_class(misses, "class", ["id"]).collect()] == ["q"]
    regions = spark.createDataFrame([("lib/a.js", 20, 27)], "file string, start_line int, end_line int")
    assert sorted(r.line for r in E.unmatched(found, regions).collect()) == [13, 28]


def test_consistency_digests_and_caches(spark):
    overall = spark.createDataFrame([(3, 1)], "tp int, fp int")
    parts = spark.createDataFrame([(1, 1), (2, 0)], "tp int, fp int")
    assert E.consistent(overall, parts, ["tp", "fp"]).first().consistent and not E.consistent(overall, parts.limit(1), ["tp", "fp"]).first().consistent and E.consistent(overall, parts.limit(0), ["tp", "fp"]).first().consistent
    runs = spark.createDataFrame([("a",), ("a",), ("b",)], "engine_digest string")
    assert (E.one_engine(runs).first().comparable, E.one_engine(runs.limit(2)).first().comparable) == (False, True)
    tree = spark.createDataFrame([("b", bytearray(b"2")), ("a", bytearray(b"1"))], "file string, content binary")
    assert E.engine_digest(tree).first() == E.engine_digest(tree.orderBy("file")).first() != E.engine_digest(tree.limit(1)).first()
    work = spark.createDataFrame([("c", "x"), ("c", "y")], "corpus string, entry string")
    done = spark.createDataFrame([("c", "x", "d1"), ("c", "y", "d0")], "corpus string, entry string, engine_digest string")
    assert [r.entry for r in E.pending(work, done, "d1").collect()] == ["y"]
    cards = spark.createDataFrame([("r1", [("idor", 0, 5), ("xss", 0, 90)]), ("r2", [("idor", 0, 3)]), ("r3", [("idor", 0, 2)])], "repo string, families array<struct<family:string,tp:int,fn:int>>")
    assert [(r.repo, r.missed, r.share) for r in E.worst_repos(cards, ["idor"], 2).orderBy(F.desc("missed")).collect()] == [("r1", 5, 0.5), ("r2", 3, 0.8)]
    register = spark.createDataFrame([("a; b",), ("b; c",), (None,)], "cra string")
    assert {r.clause for r in E.clause_coverage(register, "cra", ["z"]).collect()} == {"a", "b", "c", "z"}
    assert {r.group: r.n for r in E.rules_by_group(spark.createDataFrame([("SEC-JS-A",), ("SEC-JS-B",), ("X",)], "detector_id string")).collect()} == {"js": 2, "other": 1}


def test_replies_that_cannot_be_read_and_extra_findings(spark, tmp_path):
    (tmp_path / "r1.txt").write_text('Sure:\n```json\n{"extra": [{"title": "t", "file": "a\\\\b.py", "line": 4, "severity": "High"}, {"file": "a/b.py", "line": 4}, {"file": "no.py", "line": 1}, {"file": "a/b.py"}]}\n```')
    (tmp_path / "r2.txt").write_text("I will not answer {this")
    replies = M.read_replies(M.recorded_replies(spark, str(tmp_path))).cache()
    assert sorted(r.readable for r in replies.collect()) == [False, True]
    found = spark.createDataFrame([("LLM-LOGIC", "a/b.py", 1)], "detector_id string, file string, line int")
    got = M.grounded_extra(found, M.items(replies, "extra"), spark.createDataFrame([("a/b.py",)], "file string"))
    assert [(r.ord, r.line, r.severity, r.title, r.outcome) for r in got.orderBy("ord").collect()] == [(0, 4, "High", "t", "merged"), (1, 4, "Medium", "Logic flaw", "repeated"), (2, 1, "Medium", "Logic flaw", "ungrounded"), (3, 1, "Medium", "Logic flaw", "known")]


def test_logic_outcomes(spark):
    item = lambda k, c, f, line, h="", s="Critical": ("r", k, None, c, h, None, line, None, s, "n", f)
    logic = spark.createDataFrame([item(0, "missing_ownership", "a.py", 5), item(1, "missing_ownership", "a.py", 6), item(2, "odd", "a.py", 5), item(3, "workflow_skip", "x.py", 5), item(4, "workflow_skip", "a.py", 90), item(5, "workflow_skip", "a.py", 5, "other"), item(6, "missing_authorization", "a.py", 5, "h")],
                                  "reply_id string, ord int, detector_id string, class string, handler string, title string, line int, verdict string, severity string, note string, file string")
    spans = spark.createDataFrame([("a.py", "h", 4, 9)], "file string, name string, line int, end_line int")
    found = spark.createDataFrame([("AUTHZ-PY-NOAUTH", "a.py", 4, "CWE-306")], "detector_id string, file string, line int, cwe string")
    rows = M.logic_outcomes(found, logic, spans, spans.select("file")).orderBy("ord").collect()
    assert [r.outcome for r in rows] == ["merged", "repeated", "unknown_class", "ungrounded", "outside", "outside", "restated"]
    assert (rows[0].detector_id, rows[0].severity, rows[0].handler, rows[0].cwe) == ("LOGIC-IDOR", "High", "h", "CWE-639")


def test_chunks_are_filled_in_order(spark):
    df = spark.createDataFrame([("a", 60), ("b", 30), ("c", 20), ("d", 200), ("e", 10), ("f", 95)], "file string, n int")
    assert {r.file: r.chunk for r in M.packed_chunks(df, 100, 3, ["file"]).collect()} == {"a": 0, "b": 0, "c": 1, "d": 2, "e": None, "f": None}


def test_enrich_and_patches(spark):
    found = spark.createDataFrame([("A-1", "a.py", 5, "Low", "CWE-1", "e1"), ("B-1", "b.py", 2, "High", "CWE-2", "e2")], "detector_id string, file string, line int, severity string, cwe string, evidence string")
    spans = spark.createDataFrame([("a.py", "h", 4, 9)], "file string, name string, line int, end_line int")
    replies = spark.createDataFrame([("r1", '{"triage": [{"detector_id": "A-1", "file": "a.py", "line": 5, "verdict": "refuted", "note": "n"}, {"detector_id": "X", "file": "a.py", "line": 5}], "extra": [{"file": "b.py", "line": 9, "title": "t"}], "logic": [{"class": "workflow_skip", "file": "a.py", "line": 6}]}'), ("r2", "no")], "reply_id string, text string")
    out, said = M.enriched(found, "replay", replies, found.select("file"), spans)
    assert sorted((r.detector_id, r.file, r.line, r.verdict) for r in out.collect()) == [("A-1", "a.py", 5, "refuted"), ("B-1", "b.py", 2, "unverified"), ("LLM-LOGIC", "b.py", 9, "plausible"), ("LOGIC-WORKFLOW", "a.py", 6, "plausible")]
    assert sorted((r.channel, r.outcome) for r in said.collect()) == [("extra", "merged"), ("logic", "merged"), ("reply", "unreadable"), ("triage", "merged"), ("triage", "unknown_finding")]
    assert M.enriched(found, "none", None, found.select("file"), spans)[0].count() == 2
    with pytest.raises(ValueError, match="other"):
        M.enriched(found, "other", None, found.select("file"), spans)
    patches = spark.createDataFrame([(k, "A-1", "a.py", 5, t) for k, t in (("good", ["a.py"]), ("wide", ["a.py", "b.py"]), ("idle", ["a.py"]), ("worse", ["a.py"]))], "patch_id string, detector_id string, file string, line int, touched array<string>")
    after = spark.createDataFrame([("good", "B-1", "b.py", 2, "e2"), ("wide", "B-1", "b.py", 2, "e2"), ("idle", "A-1", "a.py", 7, "e1"), ("idle", "B-1", "b.py", 2, "e2"), ("worse", "C-1", "a.py", 5, "e3")], "patch_id string, detector_id string, file string, line int, evidence string")
    got = {r.patch_id: r.reason for r in M.patch_verdicts(found, after, patches, ["line"]).collect()}
    assert got == {"good": "", "wide": "edits other files", "idle": "finding is still there", "worse": "introduces findings"}
    ranked = spark.createDataFrame([("b/util.py",), ("z/views.py",), ("a/x.py",)], "file string").orderBy(*M.discovery_order(F.col("file")))
    assert [r.file for r in ranked.collect()] == ["z/views.py", "a/x.py", "b/util.py"]
