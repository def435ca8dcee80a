"""The code view of a source file: comments and the contents of string literals blanked, every offset kept.

One regular expression per language group finds comments and literals in one pass; what is inside becomes spaces, line
ends and delimiters stay. Extensions without a known lexical shape give null, which means the raw text is scanned.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: String delimiters, line comment, block comment, triple quotes, by language group.
GROUPS = {
    "py": ("'\"", "#", None, True),
    "js": ("'\"`", "//", ("/*", "*/"), False),
    "go": ("'\"`", "//", ("/*", "*/"), False),
    "java": ("'\"", "//", ("/*", "*/"), False),
    "cs": ("'\"", "//", ("/*", "*/"), False),
    "php": ("'\"", "//", ("/*", "*/"), False),
    "rb": ("'\"", "#", None, False),
    "rs": ('"', "//", ("/*", "*/"), False),
    "html": ("", None, ("<!--", "-->"), False),
}
#: Extensions of each group.
EXTENSIONS = {
    "py": (".py",), "js": (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts"), "go": (".go",), "java": (".java",), "cs": (".cs",), "php": (".php",), "rb": (".rb",), "rs": (".rs",),
    "html": (".html", ".htm", ".jinja", ".jinja2", ".j2", ".twig", ".hbs", ".mustache", ".ejs", ".erb"),
}
GROUP_OF = {e: g for g, es in EXTENSIONS.items() for e in es}


def lexer(group: str) -> re.Pattern[str]:
    quotes, line, block, triple = GROUPS[group]
    parts = []
    if block:
        parts.append(f"(?P<c>{re.escape(block[0])}[\\s\\S]*?(?:{re.escape(block[1])}|\\Z)" + (f"|{re.escape(line)}[^\\n]*" if line else "") + ")")
    elif line:
        parts.append(f"(?P<c>{re.escape(line)}[^\\n]*)")
    for k, q in enumerate(quotes):
        if triple:
            parts.append(f"(?P<o{k}t>{q * 3})(?P<i{k}t>(?:\\\\[\\s\\S]|(?!{q * 3})[\\s\\S])*)(?P<e{k}t>{q * 3}|\\Z)")
        parts.append(f"(?P<o{k}>{q})(?P<i{k}>(?:\\\\[\\s\\S]|[^\\\\{q}\\n])*)(?P<e{k}>{q}|(?=\\n)|\\\\?\\Z)")
    return re.compile("|".join(parts))


LEXERS = {g: lexer(g) for g in GROUPS}


def blanked(s: str) -> str:
    return re.sub(r"[^\n]", " ", s)


def view_of(text: str, ext: str) -> str | None:
    group = GROUP_OF.get(ext)
    if group is None:
        return None

    def cover(m: re.Match[str]) -> str:
        named = {k: v for k, v in m.groupdict().items() if v is not None}
        if "c" in named:
            return blanked(named["c"])
        opening = next(v for k, v in named.items() if k[0] == "o")
        closing = next((v for k, v in named.items() if k[0] == "e"), "")
        inside = len(m.group(0)) - len(opening) - len(closing)
        return opening + blanked(m.group(0)[len(opening) : len(opening) + inside]) + (closing if closing == opening else blanked(closing))

    return LEXERS[group].sub(cover, text)


def code_view(text: Column, ext: Column) -> Column:
    """Arrow batches; files without a group never reach Python."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, exts: pd.Series) -> pd.Series:
        return pd.Series([view_of(t, e) for t, e in zip(texts, exts, strict=True)], dtype=object)

    return F.when(ext.isin(*GROUP_OF), run(F.coalesce(text, F.lit("")), ext))


def blanked_literals(text: str, ext: str) -> str:
    """The inside of string literals blanked, comments kept, every offset kept; texts without a known lexical shape stay as they are."""
    group = GROUP_OF.get(ext)

    def cover(m: re.Match[str]) -> str:
        named = {k: v for k, v in m.groupdict().items() if v is not None}
        if "c" in named:
            return m.group(0)
        opening = next(v for k, v in named.items() if k[0] == "o")
        inside = next(v for k, v in named.items() if k[0] == "i")
        return opening + blanked(inside) + m.group(0)[len(opening) + len(inside) :]

    return LEXERS[group].sub(cover, text) if group else text


def without_comments(text: str, ext: str = ".js") -> str:
    """Comments blanked, literals kept (module names are literals), every offset kept."""
    group = GROUP_OF.get(ext)
    return LEXERS[group].sub(lambda m: blanked(m.group(0)) if m.groupdict().get("c") is not None else m.group(0), text) if group else text
