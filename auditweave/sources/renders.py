"""Reports for readers: Markdown and HTML of findings, differences, watches and scores.

Each function returns a DataFrame with one ``value`` column and one row, the document. Lines are made where the rows are and
gathered by one aggregation in report order; a report is one document, so its findings must fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.functions.levels import SEVERITIES
from auditweave.functions.text import in_words, visible_controls
from auditweave.sources.exports import gathered, rank_order

#: Words of the reports' own furniture; other languages give some of the keys and fall back to these.
ENGLISH = {
    "title": "Security report", "summary": "Summary", "severity": "Severity", "count": "Count", "total": "Findings in all", "findings": "Findings", "none": "No findings.", "location": "Location", "class": "Class", "detector": "Rule",
    "evidence": "Evidence", "path": "Data flow", "vex": "Reachability", "exploitation": "Exploitation", "triage": "Note", "clean": "An empty list means that these rules found nothing, not that nothing is there.",
}


def code_span(x: Column) -> Column:
    """Inline code that its content cannot leave: a fence longer than any run of backticks inside."""
    runs = F.transform(F.regexp_extract_all(x, F.lit("`+"), F.lit(0)), F.length)
    fence = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    return F.when(F.contains(x, F.lit("`")), F.concat(fence, F.lit(" "), x, F.lit(" "), fence)).otherwise(F.concat(F.lit("`"), x, F.lit("`")))


def cell(x: Column) -> Column:
    return F.regexp_replace(F.replace(x, F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")


def escaped(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def column(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def counted(df: DataFrame, by: str, values: tuple[str, ...]) -> list[Column]:
    return [F.count_if(F.col(by) == v).alias(f"n_{v}") for v in values]


def joined(rows: DataFrame, item: Column, order: list[Column], counts: list[Column]) -> DataFrame:
    """One row: body (the items as one text, in order) and the counts, which are aggregated apart and meet as single rows."""
    return gathered(rows, item, order).select(F.array_join("items", "\n").alias("body")).join(F.broadcast(rows.agg(F.count("*").alias("n"), *counts)))


def markdown_report(findings: DataFrame, target: str, words: dict[str, str] | None = None) -> DataFrame:
    """Ranked findings; words: furniture of another language. Control characters are spelled out, evidence cannot leave its span."""
    t = lambda key: in_words(F.lit(key), words or {}, ENGLISH)
    field = lambda key, value: F.concat(F.lit("- **"), t(key), F.lit(":** "), value)
    optional = lambda key, name: F.when(column(findings, name) != "", F.concat(F.lit("\n"), field(key, code_span(visible_controls(column(findings, name))))) ).otherwise("")
    place = code_span(visible_controls(F.concat("file", F.lit(":"), F.col("line").cast("string"))))
    item = F.concat(
        F.lit("### ["), "severity", F.lit("] "), visible_controls(column(findings, "title")), F.lit("\n"), field("location", place), F.lit("\n"), field("class", F.col("cwe")), F.lit("\n"), field("detector", code_span(F.col("detector_id"))), F.lit("\n"),
        field("evidence", code_span(visible_controls(column(findings, "evidence")))), optional("path", "taint_path"), optional("vex", "vex_status"), optional("exploitation", "exploitation"), optional("triage", "triage_note"), F.lit("\n"),
    )
    rows = joined(findings, item, rank_order("detector_id"), counted(findings, "severity", SEVERITIES))
    table = F.concat_ws("\n", *(F.concat(F.lit(f"| {s} | "), F.col(f"n_{s}").cast("string"), F.lit(" |")) for s in SEVERITIES))
    head = F.concat(F.lit("# "), t("title"), F.lit(f": {target}\n\n## "), t("summary"), F.lit("\n\n| "), t("severity"), F.lit(" | "), t("count"), F.lit(" |\n|---|---|\n"), table, F.lit("\n\n"), t("total"), F.lit(": "), F.col("n").cast("string"), F.lit("\n\n## "), t("findings"), F.lit("\n\n"))
    return rows.select(F.concat(head, F.when(F.col("n") == 0, t("none")).otherwise(F.col("body")), F.lit("\n> "), t("clean"), F.lit("\n")).alias("value"))


def html_report(findings: DataFrame, target: str) -> DataFrame:
    """One page without outside resources; everything from the scanned files is escaped."""
    cells = [F.col("severity"), F.col("detector_id"), F.concat("file", F.lit(":"), F.col("line").cast("string")), F.col("cwe"), column(findings, "title"), column(findings, "evidence")]
    item = F.concat(F.lit('<tr class="'), F.lower("severity"), F.lit('">'), *(F.concat(F.lit("<td>"), escaped(visible_controls(c)), F.lit("</td>")) for c in cells), F.lit("</tr>"))
    rows = joined(findings, item, rank_order("detector_id"), counted(findings, "severity", SEVERITIES))
    counts = F.concat_ws(" ", *(F.concat(F.lit(f"<li>{s}: "), F.col(f"n_{s}").cast("string"), F.lit("</li>")) for s in SEVERITIES))
    title = escaped(F.lit(target))
    style = "body{font:14px sans-serif;margin:2em}td{border-bottom:1px solid #ccc;padding:4px 8px;vertical-align:top}.critical,.high{background:#fdecea}"
    head = F.concat(F.lit('<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>'), title, F.lit(f"</title><style>{style}</style></head><body><h1>"), title, F.lit("</h1><ul>"), counts, F.lit("</ul><table>\n"))
    return rows.select(F.concat(head, F.col("body"), F.lit("\n</table></body></html>\n")).alias("value"))


CHANGES = ("introduced", "resolved", "unchanged", "moved", "not_compared")


def diff_markdown(changes: DataFrame, target: str, since: str) -> DataFrame:
    """changes: as operators.diff gives them. Tables of what came, went and was not compared; a sentence on what stayed."""
    item = F.concat(F.lit("| "), "severity", F.lit(" | "), code_span(F.col("detector_id")), F.lit(" | "), code_span(visible_controls(cell(F.concat("file", F.lit(":"), F.col("line").cast("string"))))), F.lit(" | "), cell(visible_controls(column(changes, "evidence"))), F.lit(" |"))
    items = gathered(changes.filter(F.col("change").isin("introduced", "resolved", "not_compared")), F.struct("change", item.alias("line")), [F.col("change"), *rank_order("detector_id")])
    rows = items.join(F.broadcast(changes.agg(*counted(changes, "change", CHANGES))))
    head = "\n\n| Severity | Rule | Location | Evidence |\n|---|---|---|---|\n"

    def section(title: str, change: str, empty: str) -> Column:
        lines = F.transform(F.filter("items", lambda x: x["change"] == change), lambda x: x["line"])
        return F.concat(F.lit(f"## {title}"), F.when(F.size(lines) == 0, F.lit(f"\n\n{empty}")).otherwise(F.concat(F.lit(head), F.array_join(lines, "\n"))), F.lit("\n\n"))

    n = lambda c: F.col(f"n_{c}").cast("string")
    top = F.concat(F.lit(f"# Security difference: {target} since {since}\n\n**"), n("introduced"), F.lit(" introduced, "), n("resolved"), F.lit(" resolved, "), n("unchanged"), F.lit(" unchanged**\n\n"))
    stayed = F.when(F.col("n_unchanged") > 0, F.concat(n("unchanged"), F.lit(" findings were there before and are still open; "), n("moved"), F.lit(" of them moved. They do not fail the gate.\n"))).otherwise("")
    return rows.select(F.concat(top, section("Introduced", "introduced", "This change adds no finding."), section("Resolved", "resolved", "This change resolves none."), section("Not compared (dependencies)", "not_compared", "None."), stayed).alias("value"))


def diff_json(changes: DataFrame, target: str, since: str) -> DataFrame:
    """The same as one JSON document: counts, and the rows of each change."""
    kept = [c for c in changes.columns if c != "change"]
    items = gathered(changes, F.struct("change", F.struct(*kept).alias("finding")), rank_order("detector_id"))
    rows = items.join(F.broadcast(changes.agg(*(F.count_if(F.col("change") == c).alias(c) for c in CHANGES))))
    of = lambda c: F.transform(F.filter("items", lambda x: x["change"] == c), lambda x: x["finding"]).alias(c)
    return rows.select(F.to_json(F.struct(F.lit(target).alias("target"), F.lit(since).alias("since"), F.struct(*CHANGES).alias("counts"), *map(of, CHANGES))).alias("value"))


def watch_markdown(compared: DataFrame, state: DataFrame, target: str, blocked: bool = False) -> DataFrame:
    """compared: cve, previous, current, outcome; state: cve, package, vex_status, exploited_since. A blocked comparison says so instead of being quiet."""
    spark = compared.sparkSession
    if blocked:
        return spark.createDataFrame([(f"# Exploitation watch: {target}\n\n## Could not be established\n\nNo feed could be read, so nothing was compared. This counts as an alert, not as a quiet night.\n",)], "value string")
    rows = compared.join(state.select("cve", "package", "vex_status", "exploited_since"), "cve", "left")
    risen = F.concat(F.lit("| "), code_span(F.col("cve")), F.lit(" | "), F.coalesce(F.nullif("package", F.lit("")), F.lit("—")), F.lit(" | "), F.coalesce(F.nullif("vex_status", F.lit("")), F.lit("unknown")), F.lit(" | "), "previous", F.lit(" | "), "current", F.lit(" |"))
    still = F.concat(F.lit("- "), code_span(F.col("cve")), F.lit(" — "), F.coalesce(F.nullif("package", F.lit("")), F.lit("unknown package")), F.when(column(rows, "exploited_since") != "", F.concat(F.lit(" since "), "exploited_since")).otherwise(""))
    reach = F.when(F.col("vex_status") == "affected", 0).when(F.col("vex_status") == "not_affected", 2).otherwise(1)
    items = gathered(rows.filter("outcome <> 'unchanged'"), F.struct("outcome", F.when(F.col("outcome") == "still_exploited", still).otherwise(risen).alias("line")), [reach, F.col("cve")])
    rows = items.join(F.broadcast(rows.agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "unchanged").alias("quiet"))))

    def section(title: str, outcome: str, head: str) -> Column:
        lines = F.transform(F.filter("items", lambda x: x["outcome"] == outcome), lambda x: x["line"])
        return F.when(F.size(lines) == 0, "").otherwise(F.concat(F.lit("## "), F.size(lines).cast("string"), F.lit(f" {title}\n\n{head}"), F.array_join(lines, "\n"), F.lit("\n\n")))

    table = "| CVE | Package | Reachability | Was | Now |\n|---|---|---|---|---|\n"
    triggered = section("became actively exploited", "triggered", table)
    body = F.concat(F.lit(f"# Exploitation watch: {target}\n\n"), F.when(triggered == "", F.lit("## Nothing became actively exploited since the last run\n\n")).otherwise(triggered), section("rose without being exploited", "escalated", table), section("still exploited, reported before", "still_exploited", ""))
    return rows.select(F.concat(body, F.col("n").cast("string"), F.lit(" watched, "), F.col("quiet").cast("string"), F.lit(" unchanged. Not listed does not mean safe.\n")).alias("value"))


def scorecard_markdown(scores: DataFrame, title: str) -> DataFrame:
    """scores: dimension, value, tp, fp, fn, precision, recall, f1 (operators.scoring.confusion), as tables by dimension."""
    number = lambda c: F.format_number(F.col(c), 4)
    line = F.concat(F.lit("| "), cell(F.concat_ws(" ", "dimension", "value")), F.lit(" | "), F.concat_ws(" | ", F.col("tp").cast("string"), F.col("fp").cast("string"), F.col("fn").cast("string"), number("precision"), number("recall"), number("f1")), F.lit(" |"))
    items = gathered(scores, line, [F.col("dimension"), F.col("value")])
    return items.select(F.concat(F.lit(f"# {title}\n\n| | TP | FP | FN | Precision | Recall | F1 |\n|---|---|---|---|---|---|---|\n"), F.array_join("items", "\n"), F.lit("\n")).alias("value"))
