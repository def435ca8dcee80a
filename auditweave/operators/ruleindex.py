"""The pattern tier for a large rule dimension: an index from literals to rules, then a join of files with their candidates.

Every match of a rule contains one of the rule's literals (``functions.literals``). One automaton over all literals reads a
file once, whatever the number of rules, and names the rules that can match at all; conditions on the file's extension are
part of the index. Candidates are joined with the rule table (a row a rule, broadcast), whose patterns are ordinary column
values from there on, so the plan has one expression instead of one for each rule. The result equals ``pattern_findings``,
which suits a handful of rules.

A null text has no matches; rules without a literal are candidates of every file of their extensions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditweave.functions.literals import needed
from auditweave.functions.text import bind, evidence, matches
from auditweave.operators.patterns import Rule, is_production



class Index:
    """Which rules can match a text, by its extension, its name and the literals that it has."""

    def __init__(self, rules: Sequence[Rule]):
        self.by_ext: dict[str, frozenset[int]] = {}
        for x in {e for r in rules for e in r.exts}:
            self.by_ext[x] = frozenset(i for i, r in enumerate(rules) if x in r.exts)
        self.always, of = set(), {}
        for i, r in enumerate(rules):
            literals = needed(r.pattern, r.case_sensitive or not r.python_dialect)
            for x in literals:  # lower-cased here and in the text: finds more, never less
                of.setdefault(x.lower(), set()).add(i)
            if not literals:
                self.always.add(i)
        self.found = ahocorasick.Automaton()
        for k, (x, owners) in enumerate(sorted(of.items())):
            self.found.add_word(x, (k, tuple(owners)))
        if of:
            self.found.make_automaton()
        self.empty = not of

    def candidates(self, text: str, ext: str, docker: bool) -> list[int]:
        applies = self.by_ext.get(ext, frozenset()) | (self.by_ext.get("Dockerfile", frozenset()) if docker else frozenset())
        if not applies:
            return []
        hit = {} if self.empty else dict(v for _, v in self.found.iter(text.lower()))
        return sorted(applies & self.always.union(*hit.values()))


def with_candidates(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """files (file, ext, text, ...) and ``_rules``: ordinals of the rules that can match. Columns pass through as they are."""
    names = files.columns
    at = {c: names.index(c) for c in ("file", "ext", "text")}
    rules = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules)
        for batch in batches:
            if batch.num_rows:
                rows = zip(*(batch.column(at[c]).to_pylist() for c in ("file", "ext", "text")), strict=True)
                found = [index.candidates(t, e or "", (f or "").rpartition("/")[2] == "Dockerfile") if t else [] for f, e, t in rows]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], [*names, "_rules"])

    schema = T.StructType([*files.schema.fields, T.StructField("_rules", T.ArrayType(T.IntegerType()))])
    return files.mapInArrow(run, schema)


def rule_rows(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rule dimension as a table, patterns in the dialect of the JVM; one row a rule."""
    of = lambda r, x: r.regex(x) if x else ""
    rows = [(i, r.id, r.title, r.severity, r.confidence, r.cwe, r.owasp, r.regex(r.pattern), of(r, r.requires_in_file), of(r, r.suppress_if), of(r, r.suppress_line_if), r.code_shape, r.about_committed_text, r.once_per_file, r.mask) for i, r in enumerate(rules)]
    schema = "rule_ord int, detector_id string, title string, severity string, confidence string, cwe string, owasp string, _pattern string, _requires string, _suppress string, _suppress_line string, _code boolean, _committed boolean, _once boolean, _mask boolean"
    return files.sparkSession.createDataFrame(rows, schema)


def indexed_findings(files: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ()) -> DataFrame:
    """The findings of ``pattern_findings``, by way of the index. files: file, ext, text, and optionally code_view; keep: further columns to carry."""
    view = F.col("code_view") if "code_view" in files.columns else F.lit(None).cast("string")
    rows = files.select("file", "ext", "text", view.alias("code_view"), *keep)
    rows = with_candidates(rows, rules).withColumn("_production", is_production(F.col("file")))
    rows = rows.withColumn("rule_ord", F.explode("_rules")).join(F.broadcast(rule_rows(files, rules)), "rule_ord").filter(F.col("_committed") | F.col("_production"))
    scanned = F.when(F.col("_code"), F.coalesce("code_view", "text")).otherwise(F.col("text"))
    rows = rows.withColumn("_scanned", scanned).filter((F.col("_requires") == "") | F.regexp_like("_scanned", F.col("_requires")))
    rows = rows.filter((F.col("_suppress") == "") | ~F.regexp_like("_scanned", F.col("_suppress")))

    def with_lines(found: Column) -> Column:
        quiet = lambda line: (F.col("_suppress_line") != "") & F.regexp_like(line, F.col("_suppress_line"))
        shown = lambda line: F.when(F.col("_mask"), F.lit("[redacted]")).otherwise(evidence(line))
        at = lambda lines: F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["line"].alias("line"), F.element_at(lines, m["line"]).alias("of")))
        left = bind(F.split("text", "\n", -1), lambda lines: F.filter(at(lines), lambda m: ~quiet(m["of"])))
        first = bind(left, lambda all_: F.when(F.col("_once"), F.slice(all_, 1, 1)).otherwise(all_))
        return F.transform(first, lambda m: F.struct(m["start"].alias("start"), m["line"].alias("line"), shown(m["of"]).alias("evidence")))

    hit = rows.withColumn("_found", matches(F.col("_scanned"), F.col("_pattern"))).filter(F.size("_found") > 0)
    hit = hit.withColumn("m", F.explode(bind(F.col("_found"), with_lines)))
    return hit.select("detector_id", "title", "severity", "confidence", "cwe", "owasp", "file", F.col("m.line").alias("line"), F.col("m.evidence").alias("evidence"), F.lit("builtin").alias("source"), "rule_ord", F.col("m.start").alias("start"), *keep)
