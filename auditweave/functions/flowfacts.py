"""Facts of data flow that any front end gives, and their fixed point on one machine.

A front end reads one file and tells for each function which origins reach which targets inside it:

* origins: ``request`` (an expression that reads a request), ``param`` (a parameter), ``result`` (what call number n gives);
* targets: ``return``, ``sink`` (a dangerous argument), ``arg`` (an argument of call number n, by position or ``=name``).

What happens across functions and files follows from these rows alone: an argument whose parameter reaches the callee's
return goes on as the call's result, one whose parameter reaches a sink reaches that sink, and a request value that a callee
returns is a request value here. Calls of unknown functions pass all arguments on. ``operators.flow`` computes that with
joins; ``solved`` does so for a handful of files and is what tests hold the joins against.
"""

from __future__ import annotations

from typing import NamedTuple

MODULE = "<module>"


class Origin(NamedTuple):
    kind: str
    name: str
    line: int
    file: str = ""


class Target(NamedTuple):
    kind: str
    name: str
    line: int
    file: str = ""
    cwe: str = ""
    severity: str = ""
    call: int = -1


class Facts:
    """What one file tells. ``reach``: (function, origin, target); ``calls``: number to (function, callee's name)."""

    def __init__(self) -> None:
        self.reach: set[tuple[str, Origin, Target]] = set()
        self.calls: dict[int, tuple[str, str]] = {}
        self.params: dict[str, list[str]] = {}
        self.imports: list[tuple[str, list[str], str]] = []  # local name, candidate files in order, exported name or *
        self.exports: dict[str, str] = {}  # exported name to function

    def call(self, function: str, callee: str) -> int:
        self.calls[len(self.calls)] = (function, callee)
        return len(self.calls) - 1


Sink = tuple[str, str, str]


def result_of(call: int) -> Origin:
    return Origin("result", str(call), 0)


def resolved_calls(files: dict[str, Facts]) -> dict[tuple[str, int], tuple[str, str]]:
    """Callee's file and function of each call that has one: the file's own functions first, then bound names, then members of bound modules."""
    out = {}
    for f, facts in files.items():
        bound = {}
        for local, candidates, name in facts.imports:
            if there := next((c for c in candidates if c in files), None):
                bound[local, name == "*"] = (there, name)
        for n, (_, callee) in facts.calls.items():
            head, _, tail = callee.rpartition(".")
            if callee in facts.params:
                out[f, n] = (f, callee)
            elif (callee, False) in bound:
                there, name = bound[callee, False]
                if (name := files[there].exports.get(name, name)) in files[there].params:
                    out[f, n] = (there, name)
            elif head and (head, True) in bound:
                there = bound[head, True][0]
                if (name := files[there].exports.get(tail, tail)) in files[there].params:
                    out[f, n] = (there, name)
    return out


def located(file: str, facts: Facts) -> set[tuple[str, Origin, Target]]:
    """The facts with their file in origins and sinks."""
    return {(g, o._replace(file=file) if o.kind != "result" else o, t._replace(file=file) if t.kind == "sink" else t) for g, o, t in facts.reach}


def solved(files: dict[str, Facts]) -> set[tuple[str, str, Origin, Target]]:
    """(file, function, origin, target) of everything that reaches a sink or a return, over all files."""
    callee = resolved_calls(files)
    rows = {(f, g, o, t) for f, facts in files.items() for g, o, t in located(f, facts) if not (t.kind == "sink" and (f, t.call) in callee)}
    while True:
        by_result: dict[tuple[str, str], set[Target]] = {}
        by_function: dict[tuple[str, str], set[tuple[Origin, Target]]] = {}
        for f, g, o, t in rows:
            if o.kind == "result":
                by_result.setdefault((f, o.name), set()).add(t)
            else:
                by_function.setdefault((f, g), set()).add((o, t))
        new = set()
        for f, g, o, t in rows:
            if t.kind == "arg":
                to = callee.get((f, t.call))
                through = to is None
                for p, u in by_function.get(to, ()) if to else ():
                    params = files[to[0]].params[to[1]]
                    if p.kind == "param" and (t.name == "=" + p.name or (t.name.isdigit() and int(t.name) < len(params) and params[int(t.name)] == p.name)):
                        through |= u.kind == "return"
                        if u.kind == "sink":
                            new.add((f, g, o, u))
                if through:
                    new |= {(f, g, o, u) for u in by_result.get((f, str(t.call)), ())}
        for (f, n), to in callee.items():
            for p, u in by_function.get(to, ()):
                if p.kind == "request" and u.kind == "return":
                    new |= {(f, files[f].calls[n][0], p, t) for t in by_result.get((f, str(n)), ())}
        if new <= rows:
            return {r for r in rows if r[2].kind != "result" and r[3].kind in ("sink", "return")}
        rows |= new


def best_paths(rows: set[tuple[str, str, Origin, Target]]) -> list[tuple[Origin, Target]]:
    """One path for each sink, line and file: from a request if there is one, then from the earliest place."""
    best: dict[tuple, tuple] = {}
    for _, _, o, t in rows:
        if t.kind == "sink":
            key, value = (t.file, t.line, t.name), (o.kind == "param", o.file, o.line, o.name, o, t)
            if key not in best or value[:4] < best[key][:4]:
                best[key] = value
    return [best[k][4:] for k in sorted(best)]
