"""Matches, lines and derived strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: evidence is cut to so many characters.
EVIDENCE = 200
#: Makes java.util.regex read ^, $, ., case and classes as Python does.
DIALECT, DIALECT_CASED = "(?imdU)", "(?mdU)"


def newlines(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))


def bind(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, join=lambda a, b: a + b) -> Column:
    """Running sums of an array (or any associative join), in log2(size) passes: no array grows by one item at a time."""

    def scanned(x: Column) -> Column:
        strides = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda d: d < F.size(x))
        return F.aggregate(strides, x, lambda acc, d: F.transform(acc, lambda v, i: F.when(i >= d, join(F.get(acc, i - d), v)).otherwise(v)))

    return bind(values, scanned)


def located(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """array<struct<start,line,text,tail>> of all matches, left to right; start counts code points from 0, line from 1, tail is the length of a group. No zero-width patterns.

    A text is cut at its matches once; lengths and line ends of the pieces are summed together, so the cost follows the text."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = lambda x: F.length(x).cast("long") * (1 << 32) + newlines(x)

    def placed(hits: Column, pieces: Column, tails: Column) -> Column:
        one = lambda h, i, sums: F.struct((F.shiftright(F.get(sums, i), 32).cast("int") - F.length(h)).alias("start"), ((F.get(sums, i) % (1 << 32)).cast("int") - newlines(h) + 1).alias("line"), h.alias("text"), F.length(F.get(tails, i)).alias("tail"))
        return bind(running(F.transform(hits, lambda h, i: both(F.get(pieces, i)) + both(h))), lambda sums: F.transform(hits, lambda h, i: one(h, i, sums)))

    all_of = lambda k: F.regexp_extract_all(text, regex, F.lit(k))
    found = bind(all_of(0), lambda hits: bind(F.split(text, regex, -1), lambda pieces: bind(all_of(group), lambda tails: placed(hits, pieces, tails)) if group else placed(hits, pieces, hits)))
    return F.when(F.regexp_like(text, regex), found).otherwise(F.array().cast("array<struct<start:int,line:int,text:string,tail:int>>"))


def matches(text: Column, pattern: str | Column) -> Column:
    """array<struct<start,line,text>> of all matches, left to right."""
    return F.transform(located(text, pattern), lambda m: F.struct(m["start"].alias("start"), m["line"].alias("line"), m["text"].alias("text")))


def line_at(text: Column, line: Column) -> Column:
    return F.element_at(F.split(text, "\n", -1), line)


def evidence(line: Column) -> Column:
    return F.substring(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""), 1, EVIDENCE)


def squeezed(x: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def masked(secret: Column) -> Column:
    """First four characters, the rest as stars."""
    return F.concat(F.substring(secret, 1, 4), F.repeat(F.lit("*"), F.greatest(F.length(secret) - 4, F.lit(0))))


def first_cwe(*texts: Column) -> Column:
    found = [F.nullif(F.regexp_extract(F.upper(t), r"CWE[-\s]?(\d+)", 1), F.lit("")) for t in texts]
    return F.coalesce(F.concat(F.lit("CWE-"), F.coalesce(*found)), F.lit("CWE-Other"))


def cve_of(*texts: Column) -> Column:
    """First CVE id over the texts in order, upper case; empty if none has one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.upper(t), r"CVE-\d{4}-\d{4,}", 0), F.lit("")) for t in texts], F.lit(""))


def rule_group(detector_id: Column) -> Column:
    parts = F.split(detector_id, "-")
    return F.when(F.size(parts) >= 3, F.lower(parts[1])).otherwise("other")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-cased, with the dot; a leading dot makes no extension."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*(\.[^.]*)$", 1))


def package_of(specifier: Column) -> Column:
    """npm package of an import specifier; null for relative, absolute and built-in ones."""
    bare = F.split(specifier, "/")
    own = F.when(specifier.startswith("@"), F.concat_ws("/", F.slice(bare, 1, 2))).otherwise(bare[0])
    return F.when((specifier == "") | specifier.startswith(".") | specifier.startswith("/") | specifier.startswith("node:"), F.lit(None)).otherwise(own)


def purl(name: Column, version: Column) -> Column:
    return F.concat(F.lit("pkg:npm/"), F.replace(name, F.lit("@"), F.lit("%40")), F.when(version != "", F.concat(F.lit("@"), version)).otherwise(""))


def spdx_id(x: Column) -> Column:
    return F.regexp_replace(x, r"[^A-Za-z0-9.-]", "-")


def in_sealed_fifth(name: Column) -> Column:
    """Hash-chosen holdout: the first 32 bits of sha256 below a fifth of their range."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long") < (1 << 32) // 5


def visible_controls(x: Column) -> Column:
    """Control and format characters spelled as ``<U+XXXX>``, so that nothing in a report is hidden or reordered."""
    found = F.array_distinct(F.regexp_extract_all(x, F.lit(r"[\p{Cc}\p{Cf}]"), F.lit(0)))
    number = lambda c: F.hex(F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long"))
    spelt = F.aggregate(found, x, lambda a, c: F.replace(a, c, F.concat(F.lit("<U+"), F.when(F.length(number(c)) < 4, F.lpad(number(c), 4, "0")).otherwise(number(c)), F.lit(">"))))
    return F.when(F.regexp_like(x, F.lit(r"[\p{Cc}\p{Cf}]")), spelt).otherwise(x)


#: Fixed value: languages by extension.
LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python", ".go": "go", ".java": "java", ".php": "php", ".rb": "ruby", ".cs": "csharp",
    ".rs": "rust", ".kt": "kotlin", ".dart": "dart", ".tf": "terraform", ".yaml": "yaml", ".yml": "yaml", ".plist": "plist", ".json": "json",
}


def language_of(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.when(base_name(path) == "Dockerfile", "docker").otherwise(F.coalesce(F.try_element_at(known, extension(path)), F.lit("other")))


def touched_files(diff: Column) -> Column:
    """Files that a unified diff names as changed, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(diff, F.lit(r"(?m)^\+\+\+ (?:b/)?([^\t\r\n]+)"), F.lit(1)))


def shown_and_more(names: Column, shown: int = 3) -> Column:
    """The first names in order, and how many more there are."""
    ordered = F.array_sort(F.array_distinct(names))
    more = F.size(ordered) - shown
    return F.concat(F.array_join(F.slice(ordered, 1, shown), ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))


def in_words(key: Column, wanted: dict[str, str], otherwise: dict[str, str]) -> Column:
    """A string of the wanted language, key by key in the other one where it is missing, the key itself where both lack it."""
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv)) if d else F.lit(None).cast("map<string,string>")
    return F.coalesce(F.try_element_at(table(wanted), key), F.try_element_at(table(otherwise), key), key)


#: Names, endings and folders of credential material.
SECRET_NAMES = (".env", "id_rsa", "id_ed25519", "id_ecdsa", "credentials.json", "secrets.json", "serviceaccountkey.json", "kubeconfig", "npmrc", ".npmrc", ".pypirc", ".netrc")
SECRET_ENDINGS = (".pem", ".key", ".p12", ".pfx", ".jks", ".keystore", ".tfstate", ".kubeconfig", ".ppk")
SECRET_FOLDERS = ("secrets", ".ssh", ".gnupg")


def is_secret_path(path: Column) -> Column:
    """Whether a file is credential material, by its name, its ending or a folder above it."""
    low = F.lower(F.regexp_replace(path, r"\\", "/"))
    base, folders = F.regexp_extract(low, r"([^/]*)$", 1), F.split(low, "/")
    ends = F.lit(False)
    for e in SECRET_ENDINGS:
        ends = ends | low.endswith(e)
    return base.isin(*SECRET_NAMES) | base.startswith(".env") | ends | F.arrays_overlap(F.slice(folders, 1, F.size(folders) - 1), F.array(*map(F.lit, SECRET_FOLDERS)))


#: Fixed value: tools that test a running system. The patterns of requests below it are our own.
ACTIVE_TOOL_NAMES = (
    "nuclei", "nmap", "masscan", "zaproxy", "zap-cli", "zap-baseline", "zap-full-scan", "sqlmap", "hydra", "medusa", "patator", "ncrack", "gobuster", "dirb", "dirbuster", "feroxbuster", "ffuf", "wfuzz", "nikto", "wpscan", "joomscan", "arjun", "dalfox",
    "xsstrike", "commix", "tplmap", "crackmapexec", "msfconsole", "msfvenom", "msfdb", "metasploit", "beef-xss", "sqlninja", "netexec", "responder", "whatweb", "wafw00f",
)
ACTIVE_TOOLS = rf"(?i)\b({'|'.join(ACTIVE_TOOL_NAMES)})\b"
CHANGING_REQUEST = r"(?i)\bcurl\b[^|;&\n]*\s(?:-X\s*(?:POST|PUT|PATCH|DELETE)|--request[= ]\s*(?:POST|PUT|PATCH|DELETE)|-d\b|--data\b|--data-\w+|-F\b|--form\b|-T\b|--upload-file\b)"
PROBE_REQUEST = r"(?i)\b(?:curl|wget|http)\b[^|;&\n]*(?:\.\./|%2e%2e|<script|%3cscript|\bunion\b[^\n]{0,40}\bselect\b|'\s*or\s*'|\bsleep\(|/etc/passwd)"


def active_command(command: Column) -> Column:
    """Why a shell command counts as active testing; null where it does not."""
    tool = F.regexp_extract(command, ACTIVE_TOOLS, 1)
    return F.when(tool != "", F.concat(F.lit("active-scanning tool "), F.lower(tool))).when(F.regexp_like(command, F.lit(CHANGING_REQUEST)), "request that changes state").when(F.regexp_like(command, F.lit(PROBE_REQUEST)), "probe in a request")
