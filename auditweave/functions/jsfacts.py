"""What each route and function of a JavaScript or TypeScript file says, in the rows of ``codefacts``.

Routes are mount calls (``app.post('/x', auth, handler)``), decorated methods (``@Post('x')``) and exported functions named
after a method. A mount call's row speaks for everything in its brackets and has the other arguments as decorators.
"""

from __future__ import annotations

from auditweave.functions.flowfacts import MODULE
from auditweave.functions.jsflow import WORDS, File, Token, flat, is_, names_of, parted, tokens

METHODS = {"get", "post", "put", "delete", "patch", "all"}
MOUNTS = {"app", "router", "server", "api", "route", "routes", "fastify"}
#: Parts of the request, by the names that rules ask for.
SOURCES = {"body": "json", "query": "args", "params": "params", "headers": "headers", "cookies": "cookies", "files": "files", "file": "files"}


def chains(row: tuple | list) -> list[tuple[str, Token | None, Token]]:
    """(dotted name in lower case, brackets of its call or None, first token) of every chain at any depth, in order."""
    out, i = [], 0
    while i < len(row):
        t = row[i]
        if t.kind == "name" and t.text not in WORDS:
            name, first = t.text, t
            while i + 2 < len(row) and is_(row[i + 1], "sign", ".", "?.") and row[i + 2].kind == "name":
                name, i = f"{name}.{row[i + 2].text}", i + 2
            call = row[i + 1] if i + 1 < len(row) and is_(row[i + 1], "group", "(") else None
            out.append((name.lower(), call, first))
        elif t.inside:
            out += chains(t.inside)
        i += 1
    return out


def words_of(row: tuple | list) -> list[str]:
    return list(dict.fromkeys(name for name, _, _ in chains(row)))


def texts_of(row: tuple | list) -> list[dict]:
    return [{"line": t.line, "text": t.text[1:-1]} for t in flat(row) if t.kind == "text"]


def reads_of(row: tuple | list) -> list[dict]:
    """Reads of the request: ``const a = req.body.a``, ``const { a } = req.query``, and whole parts."""
    out = []
    everything = [row, *(t.inside for t in flat_groups(row))]
    for part in everything:
        for i, t in enumerate(part):
            if not (t.kind == "name" and t.text in ("req", "request", "ctx") and i + 2 < len(part) and is_(part[i + 1], "sign", ".", "?.")):
                continue
            k = i + 2 + 2 * (t.text == "ctx" and part[i + 2].text == "request" and i + 4 < len(part))
            source = SOURCES.get(part[k].text)
            if not source:
                continue
            member = part[k + 2].text if k + 2 < len(part) and is_(part[k + 1], "sign", ".", "?.") else part[k + 1].inside[0].text.strip("'\"") if k + 1 < len(part) and is_(part[k + 1], "group", "[") and part[k + 1].inside else ""
            eq = next((j for j in range(i - 1, max(i - 12, -1), -1) if is_(part[j], "sign", "=")), None)
            target = names_of([part[eq - 1]]) if eq else []
            if is_(part[eq - 1], "group", "{") if eq else False:
                out += [{"line": t.line, "name": n.lower(), "source": source, "key": (m or n).lower(), "whole": False} for n, m in target]
            else:
                out.append({"line": t.line, "name": target[0][0].lower() if target else "", "source": source, "key": member.lower(), "whole": not member})
    return out


def flat_groups(row: tuple | list) -> list[Token]:
    return [x for t in row if t.inside for x in (t, *flat_groups(t.inside))]


def branches_of(row: tuple | list) -> list[dict]:
    out = []
    for part in (row, *(t.inside for t in flat_groups(row))):
        for i, t in enumerate(part):
            if is_(t, "name", "if", "while") and i + 1 < len(part) and is_(part[i + 1], "group", "("):
                test = part[i + 1].inside
                if any(is_(x, "sign", "===", "==", "!==", "!=", "<", ">", "<=", ">=") for x in flat(test)):
                    out.append({"line": t.line, "words": words_of(test), "text": any(x.kind == "text" for x in flat(test))})
    return out


def answers_of(row: tuple | list) -> list[dict]:
    """What goes into a response, and whether it holds what a catch caught."""
    caught = {n.lower() for part in (row, *(t.inside for t in flat_groups(row))) for i, t in enumerate(part) if is_(t, "name", "catch") and i + 1 < len(part) and is_(part[i + 1], "group", "(") for n, _ in names_of(list(part[i + 1].inside))}
    out = []
    for name, call, first in chains(row):
        if call is not None and name.rpartition(".")[2] in ("send", "json", "end", "write", "render") or (call is not None and name.endswith((".json", ".send"))):
            said = words_of(call.inside)
            out.append({"line": first.line, "words": said, "caught": any(w in caught or w.split(".")[0] in caught and w.split(".")[-1] in ("message", "stack", "tostring", w.split(".")[0]) for w in said)})
    return out


def row_of(name: str, row: tuple | list, line: int, mounted: bool, path: str, methods: list[str], decorators: list[str], params: list[str], local: set[str]) -> dict:
    calls = []
    for callee, call, first in chains(row):
        if call is not None:
            inside = flat(call.inside)
            said = [*words_of(call.inside), *(t.text[1:-1].lower() for t in inside if t.kind == "text")]
            calls.append({"line": first.line, "callee": callee, "words": said, "spread": any(is_(t, "sign", "...") for t in call.inside) or any(w in ("req.body", "request.body", "ctx.request.body") for w in said), "dynamic": any(t.kind == "name" for t in inside)})
    lines = [t.line for t in flat(row)]
    return {
        "func": name, "line": line, "end_line": max(lines, default=line), "mounted": mounted, "path": path, "methods": methods, "decorators": decorators, "params": params, "refs": sorted({w for w in words_of(row)} & local - {name}), "words": words_of(row),
        "strings": texts_of(row), "calls": calls, "branches": branches_of(row), "reads": reads_of(row), "returns": answers_of(row), "fields": [],
    }


def path_ids(path: str) -> list[str]:
    names = [p.lstrip(":").rstrip("?").lower() for p in path.split("/") if p.startswith(":")]
    return [*names, *(f"req.params.{n}" for n in names)]


def keyed_writes(row: tuple | list, params: list[str]) -> list[int]:
    """Lines of ``target[key] = value`` where the key is a parameter or runs over the members of one."""
    keys = {p for p in params if p in ("key", "prop", "path", "name", "k", "field", "property")}
    parts = [row, *(t.inside for t in flat_groups(row))]
    for part in parts:
        for i, t in enumerate(part):
            if is_(t, "name", "for") and i + 1 < len(part) and is_(part[i + 1], "group", "("):
                head = [x for x in part[i + 1].inside if not is_(x, "name", "const", "let", "var")]
                if len(head) > 2 and is_(head[1], "name", "in", "of") and any(x.kind == "name" and x.text.lower() in params for x in flat(head[2:])):
                    keys.add(head[0].text.lower())
    out = []
    for part in parts:
        for i in range(1, len(part) - 1):
            if is_(part[i], "group", "[") and is_(part[i + 1], "sign", "=") and part[i - 1].kind in ("name", "group") and len(part[i].inside) == 1 and part[i].inside[0].text.lower() in keys:
                out.append(part[i].line)
    return out


def code_rows(text: str, path: str = "") -> list[dict]:
    """Rows of routes, functions and the module; ``fields`` of a function holds its writes under a chosen key."""
    try:
        whole = tokens(text)
        functions = dict(File(text, path).facts.params)
        bodies = named_bodies(whole)
    except RecursionError:
        return []
    local = {n.lower() for n in functions}
    rows = []
    for name, (line, params, body) in bodies.items():
        lower = [p.lower() for p in params]
        r = row_of(name, body, line, name.upper() in {m.upper() for m in METHODS} and name.isupper(), "", [name.lower()] if name.isupper() and name.lower() in METHODS else [], [], lower, local)
        r["fields"] = [{"line": n, "name": "keyed write", "type": ""} for n in keyed_writes(body, lower)]
        rows.append(r)
    for name, call, first in chains(whole):
        owner, _, verb = name.rpartition(".")
        if call is None or verb not in METHODS or owner.rpartition(".")[2] not in MOUNTS:
            continue
        args = parted(call.inside)
        if not args or args[0][0].kind not in ("text", "template"):
            continue
        at = args[0][0].text.strip("'\"`")
        between = [w for a in args[1:-1] for w in words_of(a)]
        handler = words_of(args[-1]) if len(args[-1]) == 1 else []
        rows.append(row_of(f"{verb} {at}", call.inside, first.line, True, at, [verb] if verb != "all" else sorted(METHODS - {"all"}), between, path_ids(at), local) | {"refs": sorted(({w for w in words_of(call.inside)} | set(handler)) & local)})
    rows.append(row_of(MODULE, whole, 1, False, "", [], [], [], set()) | {"calls": [], "branches": [], "reads": [], "returns": []})
    return rows


def named_bodies(whole: list[Token]) -> dict[str, tuple[int, list[str], tuple]]:
    """Functions that have a name: their line, parameters and body."""
    reader = File.__new__(File)
    out: dict[str, tuple[int, list[str], tuple]] = {}

    def look(row: tuple | list) -> None:
        row = list(row)
        for i, t in enumerate(row):
            if t.kind == "name" and t.text == "function" and (f := reader.function_at(row, i)) and f[0]:
                out.setdefault(f[0], (t.line, parameters(f[1]), f[2].inside))
            elif is_(t, "sign", "=", ":") and i and i + 1 < len(row) and row[i - 1].kind == "name" and (f := reader.function_at(row, i + 1)):
                out.setdefault(row[i - 1].text, (row[i - 1].line, parameters(f[1]), f[2].inside))
            if t.inside:
                look(t.inside)

    look(whole)
    return out


def parameters(group: Token) -> list[str]:
    return [n for p in (parted(group.inside) if group.kind == "group" else [[group]]) for n, _ in names_of(p)]
