import pytest

from auditweave.functions.pyflow import paths
from auditweave.operators.pyflow import python_paths


def ids(code):
    return [(p[0], p[3], p[6]) for p in paths(code)]


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("def ping(host):\n    subprocess.call('ping ' + host, shell=True)\n", [("TAINT-PY-CMDI-SHELL", 2, "parameter")]),
        ("def ping(host):\n    subprocess.call(['ping', host])\n", []),
        ("def ping(host):\n    if not ok(host):\n        raise ValueError\n    subprocess.call('ping ' + host, shell=True)\n", []),
        ("@app.get('/x')\ndef h(q):\n    x = f'select {q}'\n    db.execute(x)\n", [("TAINT-PY-SQLI", 4, "request")]),
        ("@app.get('/x')\ndef h(q=Depends(f)):\n    db.execute(q)\n", [("TAINT-PY-SQLI", 3, "parameter")]),
        ("def v(request, pk):\n    n = int(request.GET['n'])\n    open(n)\n    return redirect(request.GET['to'])\n", [("TAINT-PY-OPENREDIR", 4, "request")]),
        ("def run(c):\n    os.system(c)\ndef h():\n    run(request.args['c'])\n", [("TAINT-PY-CMDI", 2, "request")]),
        ("def clean(c):\n    return int(c)\ndef h():\n    os.system(clean(request.args['c']))\n", []),
        ("def same(c):\n    return c\ndef h():\n    x = same(request.args['c'])\n    x = 'ok'\n    os.system(x)\n    eval(same(request.form['c']))\n", [("TAINT-PY-EVAL", 7, "request")]),
        ("logger.info(request.headers['authorization'])\nlogger.info(request.path)\n", [("TAINT-PY-LOG-SENSITIVE", 1, "request")]),
        ("def (:\n", []),
    ],
)
def test_paths(code, want):
    assert ids(code) == want


def test_order_of_functions_does_not_matter():
    a, b = "def run(c):\n    os.system(c)\n", "def h():\n    run(request.args['c'])\n"
    assert [p[0] for p in paths(a + b)] == [p[0] for p in paths(b + a)] == ["TAINT-PY-CMDI"]


def test_over_files(spark):
    code = "def ping(host):\n    os.system(host)\n"
    df = spark.createDataFrame([("a.py", code), ("tests/a.py", code), ("a.js", code), ("b.py", None)], "file string, text string")
    assert [(r.file, r.sink_id, r.line, r.confidence, r.severity) for r in python_paths(df).collect()] == [("a.py", "TAINT-PY-CMDI", 2, "medium", "High")]
