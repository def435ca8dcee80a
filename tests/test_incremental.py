"""An incremental scan gives what a whole one gives, and reads only what it must."""

from auditweave.operators.flow import project_paths
from auditweave.operators.incremental import digests, import_edges, rescanned, stale

TREE = {
    "a/app.py": "from helpers import pick\ndef view(request):\n    eval(pick(request.GET['q']))\n", "a/helpers.py": "def pick(x):\n    return x\n", "a/alone.py": "def view(request):\n    eval(request.GET['q'])\n",
    "b/deep.js": "const { execSync } = require('child_process')\nexport function sh(x) {\n  execSync('a ' + x)\n}\n", "b/web.js": "import { sh } from './deep'\nexport default (req) => sh(req.query.c)\n", "b/old.js": "import { sh } from './deep'\nsh(1)\n",
}


def frame(spark, tree):
    return spark.createDataFrame(list(tree.items()), "file string, text string")


def test_changes_reach_all_that_is_connected(spark):
    before = frame(spark, TREE)
    edges, found = import_edges(before), project_paths(before).checkpoint()
    assert {(r.importer, r.imported) for r in edges.collect()} == {("a/app.py", "a/helpers.py"), ("b/web.js", "b/deep.js"), ("b/old.js", "b/deep.js")}
    cases = [
        ({"a/helpers.py": "def pick(x):\n    return 'x'\n"}, {"a/helpers.py": "changed", "a/app.py": "depends"}),
        ({"b/web.js": "import { sh } from './deep'\nexport default (req) => sh('c')\n"}, {"b/web.js": "changed", "b/deep.js": "depends", "b/old.js": "depends"}),
        ({"a/helpers.py": None}, {"a/helpers.py": "gone", "a/app.py": "depends"}),
        ({"a/new.py": "import alone\n"}, {"a/new.py": "new", "a/alone.py": "depends"}),
        ({}, {}),
    ]
    for change, want in cases:
        tree = {f: t for f, t in (TREE | change).items() if t is not None}
        now = frame(spark, tree)
        again = stale(digests(now), digests(before), edges.union(import_edges(now)))
        assert {r.file: r.reason for r in again.collect()} == want
        read = []
        got = rescanned(now, digests(before), edges, found, lambda files: (read.extend(r.file for r in files.select("file").collect()), project_paths(files))[1])
        assert sorted(map(str, got.collect())) == sorted(map(str, project_paths(now).select(got.columns).collect()))
        assert set(read) == {f for f, why in want.items() if why != "gone"}
