"""What each function of a Python file says, as rows that rules can be asked about.

A row holds words and places, no judgement: dotted names, strings, calls, comparisons that decide a branch, values read
from the request, what is returned, how the function is mounted. A row named ``<module>`` speaks for the whole file. The
rules over these rows are column expressions (``operators.structural``).
"""

from __future__ import annotations

import ast
import re

from auditweave.functions.flowfacts import MODULE

SCHEMA = (
    "file string, func string, line int, end_line int, mounted boolean, path string, methods array<string>, decorators array<string>, params array<string>, refs array<string>, words array<string>, strings array<struct<line:int,text:string>>, "
    "calls array<struct<line:int,callee:string,words:array<string>,spread:boolean,dynamic:boolean>>, branches array<struct<line:int,words:array<string>,text:boolean>>, reads array<struct<line:int,name:string,source:string,key:string,whole:boolean>>, "
    "returns array<struct<line:int,words:array<string>,caught:boolean>>, fields array<struct<line:int,name:string,type:string>>"
)
VERBS = {"get", "post", "put", "delete", "patch", "head", "options"}
REQUEST = re.compile(r"^(?:self\.)?(?:flask\.)?req(?:uest)?\.(\w+)")


def dotted(node: ast.AST) -> str:
    text = ast.unparse(node) if isinstance(node, (ast.Name, ast.Attribute)) else ""
    return text.lower() if re.fullmatch(r"[\w.]+", text) else ""


def words_of(*nodes: ast.AST) -> list[str]:
    """Dotted names (whole ones only) and argument names below the nodes, lower case, each once, in order."""
    out: dict[str, None] = {}
    todo = list(reversed(nodes))
    while todo:
        n = todo.pop()
        if name := dotted(n):
            out[name] = None
            continue
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            out |= dict.fromkeys([(getattr(n, "module", "") or "").lower(), *(x.lower() for a in n.names for x in (a.name, a.asname or ""))])
        if isinstance(n, ast.Attribute):
            out[n.attr.lower()] = None
        if isinstance(n, (ast.keyword, ast.arg)) and n.arg:
            out[n.arg.lower()] = None
        todo += reversed(list(ast.iter_child_nodes(n)))
    return [w for w in out if w]


def texts_of(node: ast.AST) -> list[dict]:
    return [{"line": n.lineno, "text": n.value} for n in ast.walk(node) if isinstance(n, ast.Constant) and isinstance(n.value, str)]


def request_read(node: ast.AST) -> dict | None:
    """One value or one whole mapping taken from the request."""
    key, at = None, node
    if isinstance(node, ast.Call):
        key = node.args[0].value if node.args and isinstance(node.args[0], ast.Constant) else None
        at = node.func
        if isinstance(at, ast.Attribute) and at.attr in ("get", "getlist", "pop") and (m := REQUEST.match(dotted(at.value))):
            return {"source": m[1], "key": str(key or "").lower(), "whole": False}
        m = REQUEST.match(dotted(at))
        return {"source": m[1], "key": "", "whole": True} if m and m[1] in ("get_json", "json", "form", "get_data") else None
    if isinstance(node, ast.Subscript):
        key = node.slice.value if isinstance(node.slice, ast.Constant) else ""
        return {"source": m[1], "key": str(key or "").lower(), "whole": False} if (m := REQUEST.match(dotted(node.value))) else None
    if isinstance(node, ast.Attribute) and (m := REQUEST.match(dotted(node))) and m[1] in ("json", "data", "form", "body", "post", "values", "files"):
        return {"source": m[1], "key": "", "whole": True}
    return None


def reads_of(f: ast.AST) -> list[dict]:
    """Reads of the request with the name that they are bound to, if any (through ``int``, ``or`` and the like)."""
    inner, out, seen = {id(c): t.id for n in ast.walk(f) if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name) for c in ast.walk(n.value)}, [], set()
    for n in ast.walk(f):
        if id(n) not in seen and (r := request_read(n)):
            seen |= {id(c) for c in ast.walk(n)}
            out.append({"line": n.lineno, "name": inner.get(id(n), "").lower(), **r})
    return out


def mount_of(f: ast.AST) -> tuple[bool, str, list[str]]:
    """Whether decorators mount the function, under which path, for which methods."""
    mounted, path, methods = False, "", []
    for d in getattr(f, "decorator_list", []):
        name = dotted(getattr(d, "func", d))
        last = name.rpartition(".")[2]
        if "." not in name or (last != "route" and last not in VERBS):
            continue
        mounted = True
        args, kws = getattr(d, "args", []), {k.arg: k.value for k in getattr(d, "keywords", [])}
        path = next((a.value for a in args if isinstance(a, ast.Constant) and isinstance(a.value, str)), path)
        methods += [last] if last in VERBS else [e.value.lower() for e in getattr(kws.get("methods"), "elts", []) if isinstance(e, ast.Constant)] or ["get"]
    return mounted, path, methods


def call_row(c: ast.Call) -> dict:
    values = [*c.args, *(k.value for k in c.keywords)]
    spread = any(k.arg is None for k in c.keywords) or any(isinstance(a, ast.Starred) for a in c.args)
    dynamic = any(not isinstance(n, (ast.Constant, ast.List, ast.Tuple, ast.Load)) for v in values for n in ast.walk(v))
    return {"line": c.lineno, "callee": dotted(c.func) or getattr(c.func, "attr", "").lower(), "words": [*words_of(*values), *(t["text"].lower() for v in values for t in texts_of(v))], "spread": spread, "dynamic": dynamic}


def function_row(f: ast.AST, name: str, local: set[str]) -> dict:
    body = getattr(f, "body", [])
    nodes = list(ast.walk(f))
    caught = {h.name for h in nodes if isinstance(h, ast.ExceptHandler) and h.name}
    tests = [c for n in nodes if isinstance(n, (ast.If, ast.IfExp, ast.While, ast.Assert)) for c in ast.walk(n.test) if isinstance(c, ast.Compare)]
    mounted, path, methods = mount_of(f)
    args = f.args if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) else None
    answers = [n for n in nodes if isinstance(n, ast.Return) and n.value is not None]
    return {
        "func": name, "line": getattr(f, "lineno", 1), "end_line": getattr(f, "end_lineno", None) or max((getattr(n, "end_lineno", 0) or 0 for n in nodes), default=1), "mounted": mounted, "path": path, "methods": methods,
        "decorators": [dotted(getattr(d, "func", d)) for d in getattr(f, "decorator_list", [])], "params": [a.arg.lower() for a in [*args.posonlyargs, *args.args, *args.kwonlyargs]] if args else [],
        "refs": sorted({n.id for n in nodes if isinstance(n, ast.Name)} & local - {name}), "words": words_of(*body, *getattr(f, "decorator_list", []), *([args] if args else [])), "strings": texts_of(f), "calls": [call_row(n) for n in nodes if isinstance(n, ast.Call)],
        "branches": [{"line": c.lineno, "words": words_of(c), "text": any(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in [c.left, *c.comparators])} for c in tests], "reads": reads_of(f),
        "returns": [{"line": n.lineno, "words": words_of(n.value), "caught": any(isinstance(x, ast.Name) and x.id in caught for x in ast.walk(n.value))} for n in answers], "fields": [],
    }


def code_rows(text: str) -> list[dict]:
    """One row for each function and one for the module; none for a file that does not parse."""
    try:
        tree = ast.parse(text)
        functions = {n.name: n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
        rows = [function_row(f, name, set(functions)) for name, f in functions.items()]
        whole = function_row(tree, MODULE, set())
        columns = [(c, s) for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for s in c.body if isinstance(s, (ast.Assign, ast.AnnAssign)) and isinstance(s.value, ast.Call)]
        whole["fields"] = [{"line": s.lineno, "name": t.id.lower(), "type": dotted(s.value.func)} for _, s in columns for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) if isinstance(t, ast.Name)]
        whole |= {"calls": [], "branches": [], "reads": [], "returns": []}
    except (SyntaxError, ValueError, RecursionError):
        return []
    return [*rows, whole]
