"""Flow over projects: the joins against the fixed point on one machine, and planted chains over files and languages."""

import random

import pytest

from auditweave.functions import flowfacts, jsflow, pyflow
from auditweave.operators.flow import project_paths

CHAINS = {
    "app/views.py": "from .helpers import pick\nfrom app import store\ndef view(request):\n    a = pick(request.GET['q'])\n    store.save(a)\n    store.safe(a)\n    b = store.ask()\n    eval(b)\n",
    "app/helpers.py": "def pick(x, y=None):\n    return x or y\ndef loop(x):\n    return loop(x)\n",
    "app/store.py": "import os\ndef save(v):\n    os.system('x ' + v)\ndef safe(v):\n    os.system(int(v))\ndef ask():\n    return flask.request.args['z']\n",
    "tests/t.py": "import os\ndef f(x):\n    os.system(x)\n",
    "web/a.js": "const { run } = require('./lib/util');\nmodule.exports = (req, res) => { run(req.query.c); res.send(tidy(req.query.d)) }\nfunction tidy(x) { return encodeURIComponent(x) }\n",
    "web/lib/util.js": "import { sh as q } from './deep'\nfunction run(c) { return q(c) }\nmodule.exports = { run };\n",
    "web/lib/deep.ts": "const { execSync } = require('child_process')\nexport function sh(x) {\n  execSync('a ' + x)\n}\n",
    "web/b.mjs": "import * as u from './lib/deep.ts'\nexport default function (req) { const { p } = req.body; u.sh(p); if (!ok(p)) return; u.sh(p) }\n",
}


def small(files):
    facts = {f: (pyflow if f.endswith(".py") else jsflow).facts_of(t, f) for f, t in files.items() if not f.startswith("tests/")}
    return {(t.file, t.name, t.line, o.name, o.line, o.file, "parameter" if o.kind == "param" else o.kind) for o, t in flowfacts.best_paths(flowfacts.solved(facts))}


def joined(spark, files):
    rows = project_paths(spark.createDataFrame(list(files.items()), "file string, text string").repartition(3)).collect()
    return {(r.file, r.sink_id, r.line, r.source, r.source_line, r.source_file, r.kind) for r in rows}


def test_chains_over_files(spark):
    got = joined(spark, CHAINS)
    assert got == small(CHAINS) == {
        ("app/store.py", "TAINT-PY-CMDI", 3, "request.GET['q']", 4, "app/views.py", "request"),
        ("app/views.py", "TAINT-PY-EVAL", 8, "flask.request.args['z']", 7, "app/store.py", "request"),
        ("web/lib/deep.ts", "TAINT-JS-CMDI", 3, "req.query.c", 2, "web/a.js", "request"),
    }


def test_joins_equal_the_small_fixed_point_on_random_projects(spark):
    """Random call graphs with cycles, over three files, in both languages."""
    rnd = random.Random(7)
    for seed in range(2):
        files = {}
        for m in range(3):
            py, js = [f"from m{(m + 1) % 3} import *\nimport m{(m + 1) % 3}, m{(m + 2) % 3}\n"], [f"import * as m{(m + 1) % 3} from './m{(m + 1) % 3}'\nimport * as m{(m + 2) % 3} from './m{(m + 2) % 3}'\n"]
            for k in range(5):
                call = lambda a: (lambda to, g: (f"f{g}({a})" if to == m else f"m{to}.f{g}({a})"))(rnd.randrange(3), rnd.randrange(6))  # noqa: E731, B023
                value = rnd.choice(["x", "y", "request.args", "1"])
                nested = call(call(value))
                end = rnd.choice(["eval(z)", "pass", "eval(int(z))"])
                py.append(f"def f{k}(x, y=0):\n    z = {nested}\n    {end}\n    return {rnd.choice(['z', 'x', '1', 'request.form'])}\n")
                js.append(f"export function f{k}(x, y) {{\n  let z = {nested.replace('request.args', 'req.query')}\n  {end.replace('int', 'parseInt').replace('pass', '')}\n  return {rnd.choice(['z', 'x', '1', 'req.body'])}\n}}\n")
            files |= {f"m{m}.py": "".join(py), f"m{m}.js": "".join(js)}
        assert joined(spark, files) == small(files), seed


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("const cp = require('child_process');\napp.get('/x', (req, res) => {\n  const { host } = req.query;\n  cp.exec('ping ' + host);\n  const n = parseInt(req.query.n);\n  cp.exec(`ping ${n}`);\n});\n", [("TAINT-JS-CMDI", 4, "request")]),
        ("function run(c) {\n  eval(c);\n}\nfunction h(req, res) {\n  run(req.body.c)\n}\n", [("TAINT-JS-EVAL", 2, "request")]),
        ("const clean = c => parseInt(c);\nfunction h(req) {\n  eval(clean(req.body.c));\n  eval(same(req.query.q));\n}\nfunction same(x) { return x }\n", [("TAINT-JS-EVAL", 4, "request")]),
        ("function h(req, res) {\n  let x = req.query.u\n  if (!ok(x)) { return res.end() }\n  res.redirect(x)\n  el.innerHTML = location.hash\n}\n", [("TAINT-JS-XSS-DOM", 5, "request")]),
        ("class A {\n  async go(req) {\n    for (const f of req.body.files) {\n      fs.readFile(f, 'utf8', cb)\n    }\n  }\n}\n", [("TAINT-JS-PATH", 4, "request")]),
        ("import vm from 'vm'\nexport const go = (code) => vm.runInNewContext(code)\n", [("TAINT-JS-VM", 2, "param")]),
        ("const _ = require('lodash')\nfunction f(c) { return _.runInContext(c) }\n", []),
        ("const sh = util.promisify(require('child_process').exec)\nfunction f(c) { return sh(c) }\n", [("TAINT-JS-CMDI", 2, "param")]),
        ("let x = req.query.a // eval(x)\nlet s = 'eval(x)', r = /eval(x)/\nx = 'ok'\neval(x)\n", []),
        ("function f(req) { return `a ${g(`b ${eval(req.body.x)}`)}` }\n", [("TAINT-JS-EVAL", 1, "request")]),
        ("items.map(i => db.query('a' + i))\nreq.body.ids.forEach(function (i) { db.query('a' + i) })\n", [("TAINT-JS-SQLI", 2, "request")]),
        ("((((", []),
    ],
)
def test_javascript(code, want):
    assert [(t.name, t.line, o.kind) for o, t in flowfacts.best_paths(flowfacts.solved({"a.js": jsflow.facts_of(code, "a.js")}))] == want
