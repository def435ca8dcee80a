from auditweave.operators.redos import redos_findings


def test_patterns_in_code(spark):
    files = spark.createDataFrame([
        ("a.py", ".py", "import re\nBAD = r'(a+)+$'\ndef f(x):\n    return re.search(BAD, x)\nre.compile(r'\\d+')\n"),
        ("b.js", ".js", "const re = /(\\w+\\s?)*$/;\nfoo(x);\nif (re.test(x)) {}\nconst q = new RegExp(\"\\\\S+@\\\\S+$\");\nvar d = a / b / c;\n"),
        ("tests/c.js", ".js", "const re = /(a+)+/;\n"), ("d.txt", ".txt", "/(a+)+/"),
    ], "file string, ext string, text string")
    got = [(r.file, r.line, r.severity, r.cwe) for r in redos_findings(files).orderBy("file", "line").collect()]
    assert got == [("a.py", 4, "High", "CWE-1333"), ("b.js", 1, "High", "CWE-1333"), ("b.js", 3, "High", "CWE-1333"), ("b.js", 4, "Medium", "CWE-1333")]
