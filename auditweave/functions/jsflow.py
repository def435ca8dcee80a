"""Data flow of one JavaScript or TypeScript file, as facts (see ``flowfacts``).

Text becomes tokens and brackets a tree; statements are read from the tree without a grammar: declarations, assignments,
destructuring, returns, tests that leave, loops, functions in all forms that have a name, classes' methods, and expressions
as chains of names, members and calls. Names stand for sets of origins, as in ``pyflow``. Functions written in place (call
backs) belong to the function around them; their parameters take what the call's receiver holds.

What is not followed: values kept in object members, computed calls, nested patterns, and code that is built at run time.
"""

from __future__ import annotations

import posixpath
import re
from typing import NamedTuple

from auditweave.functions.flowfacts import MODULE, Facts, Origin, Sink, Target, result_of

#: Fixed value: expressions that read a request or a location.
REQUEST = re.compile(
    r"\breq(?:uest)?\.(?:query|params|body|headers|cookies|files)(?:\.\w+)?|\breq(?:uest)?\.(?:url|originalUrl|path|baseUrl)\b|\bctx\.(?:query|params|request|url|path|querystring|originalUrl)\b"
    r"|\blocation\.(?:search|hash|href)\b|\bdocument\.(?:URL|documentURI|referrer)\b|\bwindow\.name\b|\bprocess\.argv\b"
)
#: Calls whose result is harmless.
SANITIZER = re.compile(r"(?:^|.*\.)(?:has|includes)|(?:.*\.)?DOMPurify\.sanitize|(?:.*\.)?(?:encodeURIComponent|parseInt|Number|escapeHtml)")
#: Fixed values: (sink, weakness, severity), the callee, and the argument that is dangerous (-1: any).
SQLI, CMDI, EVAL, SSTI = ("TAINT-JS-SQLI", "CWE-89", "Critical"), ("TAINT-JS-CMDI", "CWE-78", "Critical"), ("TAINT-JS-EVAL", "CWE-95", "Critical"), ("TAINT-JS-SSTI", "CWE-94", "Critical")
VM, WRITE, REDIRECT, PATH = ("TAINT-JS-VM", "CWE-94", "Critical"), ("TAINT-JS-XSS-WRITE", "CWE-79", "High"), ("TAINT-JS-OPENREDIR", "CWE-601", "Medium"), ("TAINT-JS-PATH", "CWE-22", "High")
REFLECTED, DOM, SSRF, ASSIGN = ("TAINT-JS-XSS-REFLECTED", "CWE-79", "High"), ("TAINT-JS-XSS-DOM", "CWE-79", "High"), ("TAINT-JS-SSRF", "CWE-918", "High"), ("TAINT-JS-MASSASSIGN", "CWE-915", "High")
FILES = "readFile|readFileSync|createReadStream|createWriteStream|writeFile|writeFileSync|appendFile|appendFileSync|readdir|readdirSync|unlink|unlinkSync|rm|rmSync|rmdir|rmdirSync|rename|renameSync|copyFile|copyFileSync|open|openSync|mkdir|mkdirSync"
CALLEES: tuple[tuple[str, Sink, int], ...] = (
    (r"(?:.*\.)?(?:db|conn|connection|pool|client|sequelize|knex)\.(?:query|raw)", SQLI, 0), (r"exec(?:Sync)?|(?:.*\.)?child_process\.exec(?:Sync)?", CMDI, 0), (r"eval", EVAL, 0), (r"Function", SSTI, -1),
    (r"(?:.*\.)?document\.write(?:ln)?", WRITE, 0), (r"(?:.*\.)?res(?:ponse)?\.redirect", REDIRECT, 0), (r"(?:.*\.)?res(?:ponse)?\.writeHead", REDIRECT, 1), (rf"(?:.*\.)?fs\.(?:promises\.)?(?:{FILES})", PATH, 0),
    (r"(?:.*\.)?res(?:ponse)?\.(?:sendFile|download)", PATH, 0), (r"(?:.*\.)?res(?:ponse)?\.(?:send|write|end)", REFLECTED, 0), (r".*\.insertAdjacentHTML", DOM, 1),
    (r"(?:.*\.)?https?\.(?:get|request)|(?:.*\.)?axios\.(?:get|post)|fetch", SSRF, 0), (r"(?:.*\.)?Object\.assign", ASSIGN, 1),
)
CALLEE = [(re.compile(p), s, k) for p, s, k in CALLEES]
HTML_MEMBERS = ("innerHTML", "outerHTML")
SHELL_METHODS, VM_METHODS = re.compile(r"exec(?:Sync|File|FileSync)?"), re.compile(r"runInThisContext|runInNewContext|runInContext|compileFunction|Script")
SHELL_MODULES, VM_MODULES, WEB_MODULES = ("child_process", "node:child_process", "shelljs", "node:shelljs"), ("vm", "node:vm"), ("http", "https")
#: Fixed value: endings that a module name may lack, in the order in which they are tried.
RESOLVE = (".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", "/index.js", "/index.ts", "/index.jsx", "/index.tsx")
SHOWN = 120

TOKEN = re.compile(
    r"(?P<skip>[ \t\r]+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<line>\n)|(?P<text>'(?:\\[\s\S]|[^'\\\n])*'?|\"(?:\\[\s\S]|[^\"\\\n])*\"?)|(?P<tick>`)|(?P<number>\.?\d[\w.]*)|(?P<name>[A-Za-z_$][\w$]*|\#[A-Za-z_$][\w$]*)"
    r"|(?P<sign>=>|\.\.\.|\?\.|===|!==|==|!=|<=|>=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\+\+|--|\*\*=?|[-+*/%&|^]=|<<=?|>>>?=?|[-+*/%=<>!?:;,.&|^~@])|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<other>[\s\S])"
)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: Words after which a slash begins a regular expression, and words that never are values.
BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield"}
WORDS = BEFORE_VALUE | {"const", "let", "var", "function", "class", "if", "for", "while", "switch", "try", "catch", "finally", "import", "export", "default", "async", "extends", "static", "get", "set", "null", "true", "false", "undefined", "as", "instanceof", "break", "continue"}


class Token(NamedTuple):
    kind: str  # name, text, number, sign, regex, group, template
    text: str
    line: int
    inside: tuple = ()  # tokens of a group; expressions of a template
    fresh: bool = False  # first of its line


def template(text: str, at: int) -> tuple[int, list[str]]:
    """End of a template literal that begins at ``at``, and its expressions."""
    i, out = at + 1, []
    while i < len(text) and text[i] != "`":
        if text[i] == "\\":
            i += 2
        elif text.startswith("${", i):
            depth, j = 1, i + 2
            while j < len(text) and depth:
                if text[j] == "`":
                    j = template(text, j)[0]
                    continue
                depth += {"{": 1, "}": -1}.get(text[j], 0)
                j += 1
            out.append(text[i + 2 : j - 1])
            i = j
        else:
            i += 1
    return min(i + 1, len(text)), out


def tokens(text: str, line: int = 1) -> list[Token]:
    """Tokens with brackets as groups; unbalanced brackets close at the end."""
    stack: list[tuple[str, int, list[Token], bool]] = [("", line, [], False)]
    i, fresh = 0, True
    while i < len(text):
        row = stack[-1][2]
        last = row[-1] if row else None
        ends_value = last is not None and (last.kind in ("text", "number", "template", "regex", "group") or (last.kind == "name" and last.text not in BEFORE_VALUE))
        if text[i] == "/" and not ends_value and (m := REGEX.match(text, i)):
            row.append(Token("regex", m.group(), line, (), fresh))
            i, fresh = m.end(), False
            continue
        m = TOKEN.match(text, i)
        kind, i = m.lastgroup, m.end()
        if kind == "line":
            line, fresh = line + 1, True
            continue
        if kind == "skip":
            fresh |= "\n" in m.group()
        elif kind == "tick":
            end, inner = template(text, i - 1)
            row.append(Token("template", "`", line, tuple(t for x in inner for t in [*tokens(x, line), Token("sign", ",", line)]), fresh))
            line, i = line + text.count("\n", i, end), end
            fresh = False
            continue
        elif kind == "open":
            stack.append((m.group(), line, [], fresh))
            fresh = False
        elif kind == "close":
            if len(stack) > 1:
                bracket, at, inner, was = stack.pop()
                stack[-1][2].append(Token("group", bracket, at, tuple(inner), was))
            fresh = False
        elif kind != "other":
            row.append(Token(kind, m.group(), line, (), fresh))
            fresh = False
        line += m.group().count("\n")
    while len(stack) > 1:
        bracket, at, inner, was = stack.pop()
        stack[-1][2].append(Token("group", bracket, at, tuple(inner), was))
    return stack[0][2]


def parted(row: list[Token] | tuple, sign: str = ",") -> list[list[Token]]:
    out: list[list[Token]] = [[]]
    for t in row:
        if t.kind == "sign" and t.text == sign:
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


def is_(t: Token | None, kind: str, *texts: str) -> bool:
    return t is not None and t.kind == kind and (not texts or t.text in texts)


def names_of(pattern: list[Token]) -> list[tuple[str, str]]:
    """(name, member) that a parameter or a declared target binds; member is empty where it is not one member's value."""
    if not pattern:
        return []
    t = pattern[0]
    if is_(t, "sign", "..."):
        return [(n, "") for n, _ in names_of(pattern[1:])]
    if t.kind == "name":
        return [(t.text, "")]
    out = []
    if t.kind == "group" and t.text in "{[":
        for p in parted(t.inside):
            spread = is_(p[0], "sign", "...")
            p = p[1:] if spread else p
            if t.text == "{" and len(p) > 2 and is_(p[1], "sign", ":"):
                out += [(p[2].text, p[0].text)] if p[2].kind == "name" else []
            elif p and p[0].kind == "name":
                out.append((p[0].text, p[0].text if t.text == "{" and not spread else ""))
    return out


Values = dict[str, frozenset[Origin]]
NOTHING: frozenset[Origin] = frozenset()


class File:
    def __init__(self, text: str, path: str) -> None:
        self.facts, self.path = Facts(), path
        self.modules: dict[str, str] = {}  # local name to module (namespaces)
        self.members: dict[str, tuple[str, str]] = {}  # local name to (module, member)
        self.later: list[tuple[str, list[list[tuple[str, str]]], tuple, Values]] = []
        self.block(tokens(text), {}, MODULE)
        while self.later:
            name, params, body, env = self.later.pop(0)
            inner = dict(env)
            for k, names in enumerate(params):
                inner |= {n: frozenset([Origin("param", self.facts.params[name][k], body[0])]) for n, _ in names}
            self.block(list(body[1]), inner, name)

    # --- functions

    def define(self, name: str, params: Token, body: Token, env: Values) -> None:
        if name in self.facts.params:
            return
        names = [names_of(p) for p in parted(params.inside)] if params.kind == "group" else [[(params.text, "")]]
        self.facts.params[name] = [n[0][0] if len(n) == 1 else f"#{k}" for k, n in enumerate(names)]  # a pattern's parts stand for the whole argument
        self.later.append((name, names, (params.line, body.inside), env))

    def function_at(self, row: list[Token], i: int) -> tuple[str, Token, Token, int] | None:
        """Name (or empty), parameters, body and end of a function expression that begins at i; the body of ``a => b`` is one group of b."""
        j = i + 1 if is_(row[i], "name", "async") and i + 1 < len(row) else i
        if is_(row[j], "name", "function"):
            j += 1
            j += j < len(row) and is_(row[j], "sign", "*")
            name = row[j].text if j < len(row) and row[j].kind == "name" else ""
            j += bool(name)
            if j < len(row) and is_(row[j], "group", "("):
                for k in range(j + 1, len(row)):
                    if is_(row[k], "group", "{"):
                        return name, row[j], row[k], k + 1
            return None
        if row[j].kind == "name" or is_(row[j], "group", "("):
            k = j + 1
            if is_(row[j], "group", "(") and k < len(row) and is_(row[k], "sign", ":"):  # a result type
                while k < len(row) and not is_(row[k], "sign", "=>", ",", ";"):
                    k += 1
            if k + 1 < len(row) and is_(row[k], "sign", "=>"):
                if is_(row[k + 1], "group", "{"):
                    return "", row[j], row[k + 1], k + 2
                end = k + 1
                while end < len(row) and not is_(row[end], "sign", ",", ";"):
                    end += 1
                return "", row[j], Token("group", "{", row[k].line, (Token("name", "return", row[k].line), *row[k + 1 : end])), end
        return None

    # --- statements

    def statements(self, row: list[Token]) -> list[list[Token]]:
        """Cut at semicolons, behind blocks, and at lines that begin a new statement."""
        out: list[list[Token]] = [[]]
        for t in row:
            now = out[-1]
            last = now[-1] if now else None
            if is_(t, "sign", ";"):
                out.append([])
                continue
            done = last is not None and (last.kind in ("text", "number", "template", "regex", "group") or (last.kind == "name" and last.text not in BEFORE_VALUE) or is_(last, "sign", "++", "--"))
            opens = t.kind in ("name", "text", "number", "template") or is_(t, "sign", "@") or (is_(t, "group", "{") and not is_(last, "group", "("))
            heads = t.kind == "name" and t.text in ("const", "let", "var", "function", "class", "if", "for", "while", "return", "import", "export", "switch", "try", "throw", "async")
            block = is_(last, "group", "{") and now[0].kind == "name" and now[0].text in ("if", "else", "for", "while", "function", "try", "catch", "finally", "class", "async", "switch", "export", "do")
            goes_on = is_(t, "name", "else", "catch", "finally", "from", "as", "of", "in", "instanceof", "extends")
            if done and not goes_on and ((t.fresh and opens) or (heads and t.fresh) or (block and t.kind != "sign" and not is_(t, "group", "("))):
                out.append([])
            out[-1].append(t)
        return [s for s in out if s]

    def block(self, row: list[Token], env: Values, function: str) -> Values:
        for s in self.statements(row):
            env = self.statement(s, env, function)
        return env

    def statement(self, s: list[Token], env: Values, function: str) -> Values:
        while s and (is_(s[0], "name", "export", "default", "declare", "public", "private", "protected", "abstract") and len(s) > 1 and not is_(s[1], "sign", "=", ".", "(")):
            if is_(s[0], "name", "export"):
                env = self.exported(s[1:], env, function)
                if is_(s[1], "group", "{") or is_(s[1], "sign", "*"):
                    return env
            s = s[1:]
        if not s:
            return env
        head = s[0].text if s[0].kind == "name" else ""
        if head == "import":
            self.imported(s)
            return env
        if head in ("const", "let", "var"):
            for part in parted(s[1:]):
                env = self.declared(part, env, function)
            return env
        if head in ("function", "async") and (f := self.function_at(s, 0)) and f[0]:
            self.define(f[0], f[1], f[2], env)
            return env
        if head == "class":
            body = next((t for t in s if is_(t, "group", "{")), None)
            name = s[1].text if len(s) > 1 and s[1].kind == "name" else "class"
            inner = list(body.inside) if body else []
            for k in range(len(inner) - 2):
                if inner[k].kind == "name" and inner[k].text not in WORDS and is_(inner[k + 1], "group", "("):
                    found = next((t for t in inner[k + 2 : k + 8] if is_(t, "group", "{")), None)
                    if found is not None:
                        self.define(f"{name}.{inner[k].text}", inner[k + 1], found, env)
            return env
        if head == "return" or head == "throw":
            for o in self.value(s[1:], env, function):
                if head == "return":
                    self.facts.reach.add((function, o, Target("return", "", 0)))
            return env
        if head in ("if", "while", "switch") and len(s) > 1 and is_(s[1], "group", "("):
            return self.branch(s, env, function)
        if head == "for":
            at = next((k for k, t in enumerate(s) if is_(t, "group", "(")), None)
            return self.loop(s[at], s[at + 1 :], env, function) if at is not None else env
        if head in ("try", "else", "do", "finally", "catch"):
            for t in s:
                if is_(t, "group", "{"):
                    env = self.joined(env, self.block(list(t.inside), env, function))
            return env
        if is_(s[0], "group", "{") and len(s) == 1:
            return self.block(list(s[0].inside), env, function)
        return self.assigned(s, env, function)

    def joined(self, one: Values, other: Values) -> Values:
        return {k: one.get(k, NOTHING) | other.get(k, NOTHING) for k in one.keys() | other.keys()}

    def branch(self, s: list[Token], env: Values, function: str) -> Values:
        self.value(list(s[1].inside), env, function)
        rest, ends, left = s[2:], [], False
        parts: list[list[Token]] = [[]]
        for t in rest:
            if is_(t, "name", "else"):
                parts.append([])
            else:
                parts[-1].append(t)
        for p in (p for p in parts if p):
            body = list(p[0].inside) if is_(p[0], "group", "{") else p
            if is_(p[0], "name", "if"):
                ends.append(self.branch(p, env, function))
                continue
            ends.append(self.block(body, env, function))
            left |= any(is_(t, "name", "return", "throw") or (is_(t, "name", "next") and len(body) > 1) for t in body)
        out = env
        for e in ends:
            out = self.joined(out, e)
        if left and is_(s[0], "name", "if"):
            asked = {t.text for t in flat(s[1].inside) if t.kind == "name"}
            out = {k: NOTHING if k in asked else v for k, v in out.items()}
        return out

    def loop(self, head: Token, body: list[Token], env: Values, function: str) -> Values:
        row = list(head.inside)
        of = next((k for k, t in enumerate(row) if is_(t, "name", "of", "in")), None)
        inside = env
        if of is not None:
            target = row[1:of] if row and is_(row[0], "name", "const", "let", "var") else row[:of]
            inside = env | {n: self.value(row[of + 1 :], env, function) for n, _ in names_of(target)}
        else:
            inside = self.block(row, env, function)
        rows = list(body[0].inside) if body and is_(body[0], "group", "{") else body
        once = self.joined(inside, self.block(rows, inside, function))
        return self.joined(env, self.block(rows, once, function))

    def declared(self, part: list[Token], env: Values, function: str) -> Values:
        eq = next((k for k, t in enumerate(part) if is_(t, "sign", "=")), None)
        if eq is None:
            return env
        target, right = part[:1], part[eq + 1 :]
        if not right:
            return env
        if spec := required(right):
            self.bind_module(target, spec, [t.text for t in right[2:] if t.kind == "name"])
        if (f := self.function_at(right, 0)) and target[0].kind == "name":
            self.define(target[0].text, f[1], f[2], env)
            return env
        if target[0].kind == "name" and any(is_(t, "name", "promisify") for t in right) and any(is_(t, "name", "exec", "execSync") for t in flat(right)):
            self.members[target[0].text] = ("child_process", "exec")
        value = self.value(right, env, function)
        text = spelled(right)
        bound = {}
        for n, member in names_of(target):
            asked = REQUEST.fullmatch(f"{text}.{member}") if member else None
            bound[n] = frozenset([Origin("request", f"{text}.{member}"[:SHOWN], target[0].line)]) if asked else value
        return env | bound

    def assigned(self, s: list[Token], env: Values, function: str) -> Values:
        eq = next((k for k, t in enumerate(s) if is_(t, "sign", "=", "+=", "||=", "??=", "&&=")), None)
        if eq is None or eq == 0:
            self.value(s, env, function)
            return env
        left, right, whole = s[:eq], s[eq + 1 :], spelled(s[:eq])
        if not right:
            return env
        own = re.fullmatch(r"(?:module\.)?exports(?:\.(\w+))?", whole)
        if f := self.function_at(right, 0):
            name = (own[1] or f[0] or "default") if own else whole
            self.define(name, f[1], f[2], env)
            if own:
                self.facts.exports[own[1] or "default"] = name
            return env
        if own and not own[1] and is_(right[0], "group", "{"):
            return self.exported(right, env, function)
        if own and right[0].kind == "name" and len(right) == 1:
            self.facts.exports[own[1] or "default"] = right[0].text
        value = self.value(right, env, function)
        if left[-1].kind == "name" and left[-1].text in HTML_MEMBERS and len(left) > 1:
            for o in value:
                self.facts.reach.add((function, o, Target("sink", DOM[0], left[-1].line, "", DOM[1], DOM[2])))
        if len(left) == 1:
            keep = s[eq].text != "="
            return env | {n: value | (env.get(n, NOTHING) if keep else NOTHING) for n, _ in names_of(left)}
        if left[0].kind == "name" and left[0].text in env and value:
            return env | {left[0].text: env[left[0].text] | value}
        return env

    # --- modules

    def bind_module(self, target: list[Token], spec: str, members: list[str]) -> None:
        files = candidates(spec, self.path)
        if target[0].kind == "name" and not members:
            self.modules[target[0].text] = spec
            self.facts.imports += [(target[0].text, files, "*"), (target[0].text, files, "default")]
        elif target[0].kind == "name":
            self.members[target[0].text] = (spec, members[0])
            self.facts.imports.append((target[0].text, files, members[0]))
        else:
            for n, member in names_of(target):
                self.members[n] = (spec, member or n)
                self.facts.imports.append((n, files, member or n))

    def imported(self, s: list[Token]) -> None:
        spec = next((t.text[1:-1] for t in reversed(s) if t.kind == "text"), "")
        files = candidates(spec, self.path)
        if len(s) > 3 and is_(s[2], "sign", "=") and (asked := required(s[3:])):
            return self.bind_module(s[1:2], asked, [])
        for k, t in enumerate(s[1:], 1):
            if is_(t, "name", "from"):
                break
            if is_(t, "group", "{"):
                for p in parted(t.inside):
                    p = p[1:] if is_(p[0], "name", "type") and len(p) > 1 else p
                    self.members[p[-1].text] = (spec, p[0].text)
                    self.facts.imports.append((p[-1].text, files, p[0].text))
            elif t.kind == "name" and t.text not in ("type", "as"):
                self.modules[t.text] = spec
                self.facts.imports += [(t.text, files, "*")] + ([(t.text, files, "default")] if not is_(s[k - 1], "name", "as") else [])

    def exported(self, s: list[Token], env: Values, function: str) -> Values:
        if is_(s[0], "name", "default") and len(s) > 1:
            if f := self.function_at(s, 1):
                self.define(f[0] or "default", f[1], f[2], env)
                self.facts.exports["default"] = f[0] or "default"
            elif s[1].kind == "name":
                self.facts.exports["default"] = s[1].text
        elif is_(s[0], "group", "{"):
            for p in parted(s[0].inside):
                if len(p) > 2 and is_(p[1], "sign", ":") and (f := self.function_at(p, 2)):
                    self.define(p[0].text, f[1], f[2], env)
                elif len(p) > 2 and is_(p[1], "group", "(") and is_(p[-1], "group", "{"):  # a method in short form
                    self.define(p[0].text, p[1], p[-1], env)
                elif len(p) > 2 and (is_(p[1], "sign", ":") or is_(p[1], "name", "as")) and p[2].kind == "name":
                    short = is_(p[1], "name", "as")
                    self.facts.exports[p[2 if short else 0].text] = p[0 if short else 2].text
        return env

    # --- expressions

    def value(self, row: list[Token], env: Values, function: str) -> frozenset[Origin]:
        """Origins that may be in the value of an expression; calls in it leave their facts."""
        out, i = NOTHING, 0
        while i < len(row):
            t = row[i]
            if t.kind in ("name", "group") and (f := self.function_at(row, i)):
                self.in_place(f, NOTHING, env, function)
                i = f[3]
            elif t.kind == "template":
                out |= self.value(list(t.inside), env, function)
                i += 1
            elif t.kind == "name" and t.text not in WORDS or t.kind == "group":
                if t.kind == "name" and i + 1 < len(row) and is_(row[i + 1], "sign", ":") and not (i and is_(row[i - 1], "sign", "?")):
                    i += 2  # a member's name in an object
                    continue
                got, i = self.chain(row, i, env, function)
                out |= got
            else:
                i += 1
        return out

    def in_place(self, f: tuple[str, Token, Token, int], given: frozenset[Origin], env: Values, function: str) -> None:
        names = [n for p in (parted(f[1].inside) if f[1].kind == "group" else [[f[1]]]) for n, _ in names_of(p)]
        self.block(list(f[2].inside), env | dict.fromkeys(names, given), function)

    def chain(self, row: list[Token], i: int, env: Values, function: str) -> tuple[frozenset[Origin], int]:
        """A name or group with its members and calls."""
        t, text = row[i], ""
        if t.kind == "name":
            got, text = env.get(t.text, NOTHING), t.text
        else:
            got = self.value(list(t.inside), env, function)
        line, i = t.line, i + 1
        while i < len(row):
            t = row[i]
            if is_(t, "sign", ".", "?.") and i + 1 < len(row) and row[i + 1].kind == "name":
                text += "." + row[i + 1].text
                i += 2
            elif is_(t, "sign", "!") and i + 1 < len(row) and is_(row[i + 1], "sign", "."):
                i += 1
            elif is_(t, "sign", "?.") and i + 1 < len(row) and row[i + 1].kind == "group":
                i += 1
            elif is_(t, "group", "["):
                got |= self.value(list(t.inside), env, function)
                i += 1
            elif is_(t, "group", "("):
                spec = required([Token("name", text, line), t])
                got, text = self.called(text, t, got, env, function, line), f"require('{spec}')" if spec else text + "()"
                i += 1
            elif is_(t, "template", "`") and not t.fresh:
                got |= self.value(list(t.inside), env, function)
                i += 1
            else:
                break
            if m := REQUEST.match(text):
                got = frozenset([Origin("request", (m.group() if "(" in text else text)[:SHOWN], line)])
        return got, i

    def called(self, name: str, group: Token, owner: frozenset[Origin], env: Values, function: str, line: int) -> frozenset[Origin]:
        given = []
        for part in parted(group.inside):
            if f := self.function_at(part, 0):
                self.in_place(f, owner, env, function)
                given.append(NOTHING)
            else:
                given.append(self.value(part[1:] if is_(part[0], "sign", "...") else part, env, function))
        if SANITIZER.fullmatch(name):
            return NOTHING
        n = self.facts.call(function, name)
        for key, origins in [*((str(k), v) for k, v in enumerate(given)), ("self", owner)]:
            for o in origins:
                self.facts.reach.add((function, o, Target("arg", key, 0, call=n)))
        for sink, k in self.sinks(name, group):
            for o in frozenset().union(*given) if k < 0 else given[k] if k < len(given) else NOTHING:
                self.facts.reach.add((function, o, Target("sink", sink[0], line, "", sink[1], sink[2], n)))
        return frozenset([result_of(n)])

    def sinks(self, name: str, group: Token) -> list[tuple[Sink, int]]:
        head, _, last = name.rpartition(".")
        module = self.modules.get(head) or (required_text(head) if head.startswith("require(") else "")
        if name in self.members:
            module, last = self.members[name]
            head = module
        if module in SHELL_MODULES and SHELL_METHODS.fullmatch(last):
            return [(CMDI, 0)]
        if (module in VM_MODULES or head == "vm") and VM_METHODS.fullmatch(last):
            return [(VM, 0)]
        if module in WEB_MODULES and last in ("get", "request"):
            return [(SSRF, 0)]
        found = next(((s, k) for p, s, k in CALLEE if p.fullmatch(name)), None)
        return [found] if found else []


def flat(row: tuple | list) -> list[Token]:
    return [x for t in row for x in ([t, *flat(t.inside)] if t.inside else [t])]


def spelled(row: list[Token]) -> str:
    return "".join(t.text for t in row if t.kind in ("name", "sign") and t.text not in ("await", "?")).replace("?.", ".")


def required(row: list[Token]) -> str:
    """The module of ``require('x')`` at the beginning of an expression."""
    if len(row) > 1 and is_(row[0], "name", "require") and is_(row[1], "group", "(") and row[1].inside and row[1].inside[0].kind == "text":
        return row[1].inside[0].text[1:-1]
    return ""


def required_text(head: str) -> str:
    m = re.match(r"require\(['\"]([^'\"]+)", head)
    return m[1] if m else ""


def candidates(spec: str, path: str) -> list[str]:
    """Files that a relative module specifier may be, in order of preference."""
    if not spec.startswith("."):
        return []
    base = posixpath.normpath(posixpath.join(posixpath.dirname(path), spec))
    return [base, *(base + x for x in RESOLVE)]


def facts_of(text: str, path: str = "") -> Facts:
    try:
        return File(text, path).facts
    except RecursionError:
        return Facts()
