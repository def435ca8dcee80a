"""Readers' documents, watch state, git snapshots, the rule pack and the calls for tools."""

import json
import subprocess

import pytest

from auditweave.functions.codeview import blanked_literals, without_comments
from auditweave.functions.rules import RULES
from auditweave.operators import api, rulepack
from auditweave.operators.diff import snapshot_diff
from auditweave.operators.scoring import confusion
from auditweave.sources import files, gitrefs, renders, state

COLUMNS = "detector_id string, title string, severity string, cwe string, file string, line int, evidence string, source string, taint_path string, package string"
ROWS = [
    ("B-1", "<b>bold</b>", "Low", "CWE-1", "a`b.js", 3, "x = `tick` ‮", "builtin", "", ""), ("A-1", "first", "Critical", "CWE-2", "z.py", 9, "<script>", "taint", "L1: a", ""), ("C-1", "dep", "High", "CWE-3", "package.json", 1, "e|f", "npm-audit", "", "left"),
]


def test_findings_for_readers(spark):
    df = spark.createDataFrame(ROWS, COLUMNS)
    text = renders.markdown_report(df, "tree", {"title": "Rapport"}).first().value
    assert text.startswith("# Rapport: tree\n\n## Summary") and "| Critical | 1 |" in text and "Findings in all: 3" in text
    assert text.index("first") < text.index("dep") < text.index("bold") and "- **Evidence:** `` x = `tick` <U+202E> ``" in text and "- **Data flow:** `L1: a`" in text
    page = renders.html_report(df, "a<b>").first().value
    assert "<title>a&lt;b&gt;</title>" in page and "&lt;script&gt;" in page and "<script>" not in page and "&lt;U+202E&gt;" in page and page.index("A-1") < page.index("B-1")
    empty = df.limit(0)
    assert "No findings." in renders.markdown_report(empty, "t").first().value and "</html>" in renders.html_report(empty, "t").first().value


def test_differences_for_readers(spark):
    old = spark.createDataFrame(ROWS[:1] + ROWS[2:], COLUMNS)
    new = spark.createDataFrame([("B-1", "t", "Low", "CWE-1", "a`b.js", 8, ROWS[0][6], "builtin", "", ""), *ROWS[1:]], COLUMNS)
    changes = snapshot_diff(old, new, ["line"])
    text = renders.diff_markdown(changes, "tree", "main").first().value
    assert "**1 introduced, 0 resolved, 1 unchanged**" in text and "| Critical | `A-1` | `z.py:9` |" in text and "This change resolves none." in text and "| High | `C-1` |" in text and "e\\|f" in text and "1 of them moved" in text
    document = json.loads(renders.diff_json(changes, "tree", "main").first().value)
    assert document["counts"] == {"introduced": 1, "resolved": 0, "unchanged": 1, "moved": 1, "not_compared": 1} and document["moved"][0]["baseline_line"] == 3


def test_watch_state_and_report(spark, tmp_path):
    watched = spark.createDataFrame([("CVE-1", "p", "affected", "High", "listed", "2024-01-01", ""), ("CVE-2", "", "", "Low", "exploited", "2024-01-01", "2024-01-01"), ("CVE-3", "q", "", "Low", "listed", "2024-01-01", "")], state.WATCHED)
    path = str(tmp_path / "state")
    assert state.read_state(spark, path) is None
    state.write_state(watched, path, "tree", "2024-01-02")
    assert sorted(map(tuple, state.read_state(spark, path).collect())) == sorted(map(tuple, watched.collect()))
    (tmp_path / "odd").write_text('{"schema": 2, "watched": []}')
    (tmp_path / "broken").write_text("{")
    for name in ("odd", "broken"):
        with pytest.raises(ValueError, match=name):
            state.read_state(spark, str(tmp_path / name))
    compared = spark.createDataFrame([("CVE-1", "listed", "exploited", "triggered"), ("CVE-2", "exploited", "listed", "still_exploited"), ("CVE-3", "listed", "listed", "unchanged")], "cve string, previous string, current string, outcome string")
    text = renders.watch_markdown(compared, watched, "tree").first().value
    assert "## 1 became actively exploited" in text and "| `CVE-1` | p | affected | listed | exploited |" in text and "- `CVE-2` — unknown package since 2024-01-01" in text and "3 watched, 1 unchanged" in text
    assert state.alerting(compared) and not state.alerting(compared.filter("outcome <> 'triggered'")) and state.alerting(compared.limit(0), blocked=True)
    assert "Could not be established" in renders.watch_markdown(compared.limit(0), watched, "tree", blocked=True).first().value


def test_scorecard(spark):
    rows = spark.createDataFrame([("x", True, True), ("x", False, True), ("y", True, False)], "class string, v boolean, h boolean")
    scored = confusion(rows, ["class"], rows.v, rows.h)
    assert "| all  | 1 | 1 | 1 | 0.5000 | 0.5000 | 0.5000 |" in renders.scorecard_markdown(scored, "Scores").first().value


def test_git_snapshot(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("one\n")
    (tmp_path / "b.js").symlink_to("src/a.py")
    git("add", "-A")
    git("commit", "-qm", "first")
    (tmp_path / "src" / "a.py").write_text("two\n")
    git("commit", "-qam", "second")
    assert [(r.scan_id, r.file, r.ext, r.text) for r in gitrefs.snapshot(spark, str(tmp_path), "HEAD~1").collect()] == [("baseline", "src/a.py", ".py", "one\n")]
    assert gitrefs.snapshot(spark, str(tmp_path), "HEAD", "gone").count() == 0
    with pytest.raises(subprocess.CalledProcessError):
        gitrefs.snapshot(spark, str(tmp_path), "--help")


def test_rule_pack(spark):
    rules = rulepack.rule_table(spark, RULES)
    pack = json.loads(rulepack.rule_pack(rules).first().value)["rules"]
    held = {r.id: r.withheld for r in rules.collect()}
    assert {r["id"] for r in pack} == {k.lower() for k, v in held.items() if not v} and held["SEC-PY-PICKLE"] and held["SEC-K8S-HOSTPATH"] and held["SEC-JS-PATHTRAV"]
    aws = next(r for r in pack if r["id"] == "sec-secret-aws")
    assert aws["severity"] == "ERROR" and "*.py" in aws["paths"]["include"] and "Dockerfile" in aws["paths"]["include"] and aws["pattern-regex"].startswith("(?m)")


def test_calls_for_tools(spark, tmp_path):
    tree = {
        "app.py": "import os\ndef view(request):\n    os.system(request.GET['c'])\n", "lib/x.js": "const r = /^(a+)+$/\n", "Dockerfile": "FROM node:latest\n", "web/a.php": "<?php\n$id = $_GET['id'];\nsystem($id); //" + " x" * 1500 + "\n",
        "ui/package.json": json.dumps({"main": "./dist/main.js"}), "ui/dist/main.js": "b = eval(a);\n", "ui/build/old.js": "b = eval(a);\n", "other/dist/main.js": "b = eval(a);\n", "ui/dist/node_modules/z/z.js": "b = eval(a);\n",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    got = {(r.detector_id, r.file, r.line) for r in api.scan_source(spark, str(tmp_path)).collect()}
    assert {("TAINT-PY-CMDI", "app.py", 3), ("REDOS", "lib/x.js", 1), ("SEC-DOCKER-LATEST", "Dockerfile", 1), ("TAINT-PHP-CMDI", "web/a.php", 3), ("SEC-JS-EVAL", "ui/dist/main.js", 1)} <= got
    assert {f for _, f, _ in got if f.endswith(".js")} == {"lib/x.js", "ui/dist/main.js"}
    assert {r.file: r.project for r in files.project_files(spark, str(tmp_path), (".js", ".py")).collect()} == {"app.py": "", "lib/x.js": "", "ui/dist/main.js": "ui"}
    assert {r.detector_id for r in api.scan_source(spark, str(tmp_path), {"docker"}).collect()} == {"SEC-DOCKER-LATEST"}
    assert api.explain_finding("SEC-DOCKER-LATEST")["group"] == "docker" and api.explain_finding("no") == {}
    assert sum(r.n for r in api.coverage(spark).collect()) == len(RULES)


def test_views_keep_offsets():
    code = "const a = require('./x'); // require('y')\n/* z\n */ f(\"q\")"
    assert without_comments(code) == "const a = require('./x');                \n    \n    f(\"q\")"
    assert blanked_literals(code, ".js") == "const a = require('   '); // require('y')\n/* z\n */ f(\" \")"


def test_manifests_decide_what_is_published(spark):
    rows = [("package.json", "", json.dumps({"main": "./dist/i.js", "exports": {".": {"import": "./build/m.mjs"}}})), ("sub/package.json", "sub", "{broken"), ("sub/p/package.json", "sub/p", json.dumps({"files": ["build"], "module": "src/a.js"}))]
    df = spark.createDataFrame([(f, d, t, ".json") for f, d, t in rows], "file string, dir string, text string, ext string")
    assert {r.dir for r in files.published_build_dirs(df).collect()} == {"dist", "build", "sub/p/build"}
