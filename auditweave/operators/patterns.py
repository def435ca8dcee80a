"""The pattern tier: rules over files.

Rules are data; each is compiled into a column expression with its patterns as literals, so a file's text is read once and
no Python runs. The order of first-wins steps is (tier, file, rule, offset), carried as columns instead of a global
sequence, which would need a total sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.functions.literals import possible
from auditweave.functions.text import DIALECT, DIALECT_CASED, bind, evidence, matches

#: What marks a path as not production. Fragments anywhere; then starts or ends of the base name.
NOT_PRODUCTION = ("/tests/", "/test/", "/migrations/", "/fixtures/", "/scripts/", "/examples/", "/samples/", "/benchmarks/", "/management/commands/", "/seeders/", "/seeds/", "/factories/")
NOT_PRODUCTION_NAMES = ("test_", "_test.py", "tests.py", "test.py", "conftest.py", "seed.py", "seeds.py", "seed_", "_seed.py", "seeds.rb", "_factory.py")


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    cwe: str
    severity: str
    pattern: str
    exts: tuple[str, ...]
    owasp: str = ""
    confidence: str = "high"
    suppress_if: str = ""
    suppress_line_if: str = ""
    requires_in_file: str = ""
    once_per_file: bool = False
    about_committed_text: bool = False
    mask: bool = False
    case_sensitive: bool = False
    code_shape: bool = False
    superseded_by: tuple[str, ...] = ()
    maps_to: str = ""
    python_dialect: bool = True

    def regex(self, pattern: str) -> str:
        return ((DIALECT_CASED if self.case_sensitive else DIALECT) if self.python_dialect else "") + pattern


def is_production(path: Column) -> Column:
    base, there = F.regexp_extract(path, r"([^/]*)$", 1), F.concat(F.lit("/"), path)
    bad = F.lit(False)
    for x in NOT_PRODUCTION:
        bad = bad | F.contains(there, F.lit(x))
    for x in NOT_PRODUCTION_NAMES:
        bad = bad | base.startswith(x) | base.endswith(x)
    return ~bad


FOUND = "array<struct<rule_ord:int,start:int,line:int>>"


def rule_matches(rule: Rule, order: int, text: Column, view: Column, ext: Column, base: Column, production: Column, lowered: Column) -> Column:
    """Matches of one rule in one file, after its file-level conditions and a test for literals that each match must have."""
    scanned = F.coalesce(view, text) if rule.code_shape else text
    applies = ext.isin(*rule.exts) | ((base == "Dockerfile") & F.lit("Dockerfile" in rule.exts))
    if not rule.about_committed_text:
        applies = applies & production
    cased = rule.case_sensitive or not rule.python_dialect
    if (may := possible(text, lowered, rule.pattern, cased)) is not None:  # a code view only blanks
        applies = applies & may
    if rule.requires_in_file:
        applies = applies & F.regexp_like(scanned, F.lit(rule.regex(rule.requires_in_file)))
    if rule.suppress_if:
        applies = applies & ~F.regexp_like(scanned, F.lit(rule.regex(rule.suppress_if)))
    found = F.transform(matches(scanned, rule.regex(rule.pattern)), lambda m: F.struct(F.lit(order).alias("rule_ord"), m["start"].alias("start"), m["line"].alias("line")))
    return F.when(applies, found).otherwise(F.array().cast(FOUND))


def pattern_findings(files: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ()) -> DataFrame:
    """files: file, ext, text, and optionally code_view (null: raw text). keep: further columns to carry.

    Result: detector_id, title, severity, confidence, cwe, owasp, file, line, evidence, source, rule_ord, start. A text is
    split into lines once, and only if a rule matches; line suppressors and once-per-file act there, evidence is cut there,
    and the text itself goes no further."""
    view = F.col("code_view") if "code_view" in files.columns else F.lit(None).cast("string")
    base, production = F.regexp_extract("file", r"([^/]*)$", 1), is_production(F.col("file"))
    lowered = [] if all(r.case_sensitive or not r.python_dialect for r in rules) else [F.lower("text").alias("_lowered")]
    files = files.select("*", base.alias("_base"), production.alias("_production"), *lowered)
    low = F.col("_lowered") if lowered else F.col("text")
    every = F.flatten(F.array(*(rule_matches(r, i, F.col("text"), view, F.col("ext"), F.col("_base"), F.col("_production"), low) for i, r in enumerate(rules))))
    of = lambda ord, name: F.element_at(F.array(*(F.lit(getattr(r, name)) for r in rules)), ord + 1)
    quiet = [(i, r.regex(r.suppress_line_if)) for i, r in enumerate(rules) if r.suppress_line_if]
    once = [i for i, r in enumerate(rules) if r.once_per_file]

    def kept(m: Column, line: Column) -> Column:
        out = F.lit(True)
        for i, pattern in quiet:
            out = out & ~((m["rule_ord"] == i) & F.regexp_like(line, F.lit(pattern)))
        return out

    def shown(found: Column) -> Column:
        def with_lines(lines: Column) -> Column:
            at = lambda m: F.element_at(lines, m["line"])
            left = F.filter(found, lambda m: kept(m, at(m))) if quiet else found
            first = lambda all_: F.filter(all_, lambda m, k: ~m["rule_ord"].isin(once) | (k == 0) | (F.element_at(all_, F.greatest(k, F.lit(1)))["rule_ord"] != m["rule_ord"]))
            cut = lambda m: F.when(of(m["rule_ord"], "mask"), F.lit("[redacted]")).otherwise(evidence(at(m)))
            one = lambda m: F.struct(m["rule_ord"].alias("rule_ord"), m["start"].alias("start"), m["line"].alias("line"), cut(m).alias("evidence"))
            return F.transform(bind(left, first) if once else left, one)

        return F.when(F.size(found) > 0, bind(F.split("text", "\n", -1), with_lines))

    hit = files.select("file", *keep, F.explode(bind(every, shown)).alias("m"))
    named = {name: of(F.col("m.rule_ord"), name).alias(to) for name, to in (("id", "detector_id"), ("title", "title"), ("severity", "severity"), ("confidence", "confidence"), ("cwe", "cwe"), ("owasp", "owasp"))}
    return hit.select(*named.values(), "file", F.col("m.line").alias("line"), F.col("m.evidence").alias("evidence"), F.lit("builtin").alias("source"), F.col("m.rule_ord").alias("rule_ord"), F.col("m.start").alias("start"), *keep)
