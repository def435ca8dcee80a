"""A database of fix commits, read by several tasks."""

import sqlite3

from pyspark.sql import functions as F

from auditweave.operators import evaluation
from auditweave.sources.sqlite import fix_commits, sqlite_table


def database(path, n=5000):
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE file_change (hash TEXT, filename TEXT, old_path TEXT, change_type TEXT, diff TEXT, diff_parsed TEXT, code_before TEXT, code_after TEXT, programming_language TEXT)")
    con.execute("CREATE TABLE commits (hash TEXT, repo_url TEXT, msg TEXT)")
    con.execute("CREATE TABLE fixes (cve_id TEXT, hash TEXT, PRIMARY KEY (cve_id, hash)) WITHOUT ROWID")
    con.execute("CREATE TABLE cwe_classification (cve_id TEXT, cwe_id TEXT)")
    con.execute("CREATE TABLE empty (a INTEGER)")
    con.executemany("INSERT INTO file_change VALUES (?,?,?,?,?,?,?,?,?)", [(f"h{i}", f"src/f{i}.py", None, "ModificationType.MODIFY", "", str({"added": [(1, "x")], "deleted": [(i % 9 + 1, "y"), (i % 9 + 2, "z [3, 4]")]}), "code é", "", "Python") for i in range(n)])
    con.executemany("INSERT INTO commits VALUES (?,?,?)", [(f"h{i}", f"r{i % 7}", "m") for i in range(n)])
    con.executemany("INSERT INTO fixes VALUES (?,?)", [(f"CVE-2024-{i:05}", f"h{i}") for i in range(0, n, 2)])
    con.executemany("INSERT INTO cwe_classification VALUES (?,?)", [(f"CVE-2024-{i:05}", f"CWE-{i % 50}") for i in range(n)])
    con.execute("DELETE FROM file_change WHERE rowid % 10 = 3")
    con.commit()
    con.close()


def test_ranges_of_rows(spark, tmp_path):
    path = str(tmp_path / "fixes.db")
    database(path)
    df = sqlite_table(spark, path, "file_change", "hash string, filename string", 6)
    assert df.rdd.getNumPartitions() == 6 and df.count() == 4500 and df.columns == ["hash", "filename"]
    assert df.select(F.count_distinct("hash")).first()[0] == 4500
    assert sqlite_table(spark, path, "fixes", "cve_id string", 6).count() == 2500
    assert sqlite_table(spark, path, "empty", "a long").count() == 0
    assert spark.read.format("sqlite_rows").option("path", path).option("table", "commits").load().dtypes == [("hash", "string"), ("repo_url", "string"), ("msg", "string")]


def test_labels_from_a_database(spark, tmp_path):
    path = str(tmp_path / "fixes.db")
    database(path, 300)
    t = fix_commits(spark, path, 3)
    rows = evaluation.with_skip_reason(evaluation.fixed_files(t["changes"], t["commits"], t["fixes"], ["python"], ["MODIFY"]), evaluation.weaknesses(t["classification"]))
    labels = {r.cve_id: (r.start_line, r.end_line, r.primary_cwe) for r in evaluation.fix_labels(rows).collect()}
    assert labels == {f"CVE-2024-{i:05}": (i % 9 + 1, i % 9 + 2, f"CWE-{i % 50}") for i in range(0, 300, 2) if (i + 1) % 10 != 3}
