"""Regular expressions written in code, and findings for those that can backtrack without bound."""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.functions.redos import severity_of, verdict
from auditweave.operators.patterns import is_production

#: Functions that run a pattern, and extensions with a front end.
RE_FUNCTIONS = {"match", "search", "fullmatch", "findall", "finditer", "sub", "subn", "split", "compile"}
PYTHON, SCRIPTS = (".py",), (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts")
LITERAL = re.compile(r"(?:(?:^|[=(,:;!&|?{}\[+])|\breturn\b|\btypeof\b)\s*/(?![*/])((?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+)/[a-z]*", re.M)
CONSTRUCTED = re.compile(r"""\bnew\s+RegExp\(\s*(["'])((?:\\.|(?!\1)[^\\\n])*)\1""")
BOUND = re.compile(r"(?:const|let|var)\s+(\w+)\s*=\s*$")


def python_patterns(text: str) -> list[tuple[int, str]]:
    """(line, pattern) of re calls whose pattern is a string or a module-level name of one."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    names = {t.id: s.value.value for s in tree.body if isinstance(s, ast.Assign) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str) for t in s.targets if isinstance(t, ast.Name)}
    out = []
    for c in ast.walk(tree):
        if isinstance(c, ast.Call) and isinstance(c.func, ast.Attribute) and c.func.attr in RE_FUNCTIONS and isinstance(c.func.value, ast.Name) and c.func.value.id == "re" and c.args:
            p = c.args[0]
            value = p.value if isinstance(p, ast.Constant) else names.get(p.id) if isinstance(p, ast.Name) else None
            if isinstance(value, str):
                out.append((c.lineno, value))
    return out


def script_patterns(text: str) -> list[tuple[int, str]]:
    """(line, pattern) of literals and constructed expressions, and of the lines where a name bound to one is run."""
    found = [(m.start(1), m[1], text.rfind("/", 0, m.start(1))) for m in LITERAL.finditer(text)]
    found += [(m.start(2), re.sub(r"\\(.)", r"\1", m[2]), m.start()) for m in CONSTRUCTED.finditer(text)]
    out = []
    for at, pattern, begin in found:
        out.append((text.count("\n", 0, at) + 1, pattern))
        if bound := BOUND.search(text[max(0, begin - 200) : begin]):
            use = re.compile(rf"\b{bound[1]}\s*\.\s*(?:test|exec)\s*\(|\.\s*(?:match|matchAll|replace|replaceAll|search|split)\s*\(\s*{bound[1]}\b")
            out += [(text.count("\n", 0, m.start()) + 1, pattern) for m in use.finditer(text)]
    return out


def redos_findings(files: DataFrame) -> DataFrame:
    """files: file, ext, text. One row for each line with a costly pattern (the worse verdict wins)."""

    def run(batches):
        for b in batches:
            rows = []
            for f, e, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                worst: dict[int, tuple[str, str, str]] = {}
                for line, p in (python_patterns if e in PYTHON else script_patterns)(t or ""):
                    if (v := verdict(p)) and (line not in worst or v[0] < worst[line][0]):
                        worst[line] = (*v, p)
                rows += [(f, line, *v) for line, v in sorted(worst.items())]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.string()) for k, c in enumerate(columns)], ["file", "line", "degree", "why", "pattern"])

    code = files.filter(F.col("ext").isin(*PYTHON, *SCRIPTS) & is_production(F.col("file"))).select("file", "ext", "text")
    found = code.mapInArrow(run, "file string, line int, degree string, why string, pattern string")
    return found.select(F.lit("REDOS").alias("detector_id"), severity_of(F.col("degree")).alias("severity"), F.lit("medium").alias("confidence"), F.lit("CWE-1333").alias("cwe"), "file", "line", "degree", "why", F.substring("pattern", 1, 60).alias("evidence"), F.lit("redos").alias("source"))
