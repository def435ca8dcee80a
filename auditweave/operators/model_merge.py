"""Model replies merged into findings: reading a reply, triage verdicts, grounded extra findings, business-logic findings.

No model is called here: replies are rows of text (recorded ones included). Every refusal is a row with its reason, so that
nothing disappears unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditweave.functions.levels import SEVERITIES, severity_rank
from auditweave.operators.imports import checkpointed
from auditweave.operators.ranges import ordered, running_sums

#: Verdicts, lengths of texts that are kept, and the business-logic classes with the weaknesses that they restate.
VERDICTS = ("unverified", "confirmed", "plausible", "refuted")
NOTE, TITLE = 500, 200
LOGIC_CLASSES = {
    "missing_ownership": ("LOGIC-IDOR", "CWE-639", "A01", "Object accessed by a caller-supplied id with no ownership check", ("CWE-639", "CWE-284", "CWE-285")),
    "missing_authorization": ("LOGIC-AUTHZ", "CWE-862", "A01", "Endpoint performs a privileged action with no authorization", ("CWE-862", "CWE-306")),
    "workflow_skip": ("LOGIC-WORKFLOW", "CWE-841", "A04", "Workflow state advanced without the preceding step", ("CWE-841",)),
    "trusted_client_value": ("LOGIC-CLIENTTRUST", "CWE-602", "A04", "Server trusts a value the client chose", ("CWE-602", "CWE-915")),
}
ITEM = "struct<detector_id:string,class:string,handler:string,title:string,file:string,line:int,verdict:string,severity:string,note:string>"
REPLY = f"triage array<{ITEM}>, extra array<{ITEM}>, logic array<{ITEM}>"


def recorded_replies(spark: SparkSession, path: str) -> DataFrame:
    """reply_id (the file), text: replies recorded one to a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("reply_id"), F.col("value").alias("text"))


def read_replies(replies: DataFrame) -> DataFrame:
    """replies: reply_id, text. Adds reply (the outermost JSON object, whatever stands around it) and readable: false where there is none."""
    body = F.nullif(F.regexp_extract("text", r"(?s)\{.*\}", 0), F.lit(""))
    read = replies.withColumn("reply", F.from_json(body, REPLY, {"mode": "PERMISSIVE"})).withColumn("readable", F.coalesce(F.try_parse_json(body).isNotNull(), F.lit(False)))
    return read.withColumn("reply", F.when(F.col("readable"), F.col("reply")))


def items(replies: DataFrame, channel: str) -> DataFrame:
    """reply_id, ord, and the fields of each item of a channel (triage, extra, logic)."""
    path = F.regexp_replace(F.coalesce("i.file", F.lit("?")), r"\\", "/").alias("file")
    rows = replies.select("reply_id", F.posexplode(F.col(f"reply.{channel}")).alias("ord", "i"))
    return rows.select("reply_id", "ord", *(F.col(f"i.{c}").alias(c) for c in ("detector_id", "class", "handler", "title", "line", "verdict", "severity", "note")), path)


def valid_severity(given: Column, otherwise: Column) -> Column:
    return F.when(given.isin(*SEVERITIES), given).otherwise(otherwise)


def triaged(findings: DataFrame, triage: DataFrame) -> DataFrame:
    """findings with verdict, triage_note and severity of the last triage item for their (detector_id, file, line).

    An unknown verdict is plausible, an unknown severity changes nothing; an item for no finding changes nothing. One row
    for each finding, whatever number of items speaks of it."""
    key = ["detector_id", "file", "line"]
    last = triage.groupBy(*key).agg(F.max_by(F.struct("verdict", "severity", "note"), F.struct("reply_id", "ord")).alias("said"))
    verdict = F.lower(F.coalesce("said.verdict", F.lit("plausible")))
    out = findings.join(last, key, "left")
    has = F.col("said").isNotNull()
    given = {"verdict": F.when(verdict.isin(*VERDICTS), verdict).otherwise("plausible"), "triage_note": F.substring(F.coalesce("said.note", F.lit("")), 1, NOTE), "severity": valid_severity(F.col("said.severity"), F.col("severity"))}
    kept = lambda c: F.col(c) if c in findings.columns else F.lit("unverified" if c == "verdict" else "")
    return out.select(*[c for c in findings.columns if c not in given], *(F.when(has, v).otherwise(kept(c)).alias(c) for c, v in given.items()))


def grounded_extra(findings: DataFrame, extra: DataFrame, shown: DataFrame) -> DataFrame:
    """reply_id, ord, file, line, title, severity, note, outcome (merged, ungrounded, known, repeated) of each extra item.

    shown: file. Merged items become findings LLM-LOGIC; one for each (file, line), none where there is one already."""
    rows = extra.withColumn("line", F.when(F.coalesce("line", F.lit(0)) == 0, 1).otherwise(F.col("line")))
    rows = rows.join(shown.select("file", F.lit(True).alias("_shown")).distinct(), "file", "left")
    have = findings.filter("detector_id = 'LLM-LOGIC'").select("file", "line", F.lit(True).alias("_have")).distinct()
    rows = rows.join(have, ["file", "line"], "left").withColumn("_n", F.row_number().over(Window.partitionBy("file", "line").orderBy("reply_id", "ord")))
    outcome = F.when(F.col("_shown").isNull(), "ungrounded").when(F.col("_have"), "known").when(F.col("_n") > 1, "repeated").otherwise("merged")
    title = F.substring(F.coalesce("title", F.lit("Logic flaw")), 1, TITLE)
    return rows.select("reply_id", "ord", "file", "line", title.alias("title"), valid_severity(F.col("severity"), F.lit("Medium")).alias("severity"), F.substring(F.coalesce("note", F.lit("")), 1, NOTE).alias("note"), outcome.alias("outcome"))


def logic_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, i, c, o, t, list(r)) for k, (i, c, o, t, r) in LOGIC_CLASSES.items()], "class string, logic_id string, logic_cwe string, logic_owasp string, logic_title string, restates array<string>")


def logic_outcomes(findings: DataFrame, logic: DataFrame, handlers: DataFrame, shown: DataFrame) -> DataFrame:
    """reply_id, ord, detector_id, cwe, owasp, title, severity, file, line, handler, note, outcome of each logic item.

    handlers: file, name, line, end_line. Refused, in this order: unknown_class, ungrounded (a file not shown), outside (no
    handler with that name has the line), restated (a finding of the handler has a weakness that the class restates). What is
    left is merged once for each handler and class, the first item; further ones are repeated. Severity is High at most."""
    key = ["reply_id", "ord"]
    rows = logic.join(F.broadcast(logic_classes(logic.sparkSession)), "class", "left")  # four fixed rows
    files = shown.select("file").union(handlers.select("file")).distinct().withColumn("_shown", F.lit(True))
    rows = rows.join(files, "file", "left")
    spans = handlers.select("file", F.col("name").alias("_name"), F.col("line").alias("_from"), F.col("end_line").alias("_to"))
    named = (F.coalesce("handler", F.lit("")) == "") | (F.col("handler") == F.col("_name"))
    inside = rows.select(*key, "file", "line", "handler", "restates", "logic_id").join(spans, "file").filter(F.col("line").between(F.col("_from"), F.col("_to")) & named)
    span = inside.groupBy(*key).agg(F.min(F.struct("_from", "_to", "_name")).alias("span"))
    known = findings.select("file", F.col("line").alias("_at"), F.col("cwe").alias("_cwe"), F.col("detector_id").alias("_id"))
    at = rows.select(*key, "file", "restates", "logic_id").join(span, key).join(known, "file").filter(F.col("_at").between(F.col("span._from"), F.col("span._to")) & (F.array_contains("restates", F.col("_cwe")) | (F.col("_id") == F.col("logic_id"))))
    rows = rows.join(span, key, "left").join(at.select(*key, F.lit(True).alias("_told")).distinct(), key, "left")
    outcome = F.when(F.col("logic_id").isNull(), "unknown_class").when(F.col("_shown").isNull(), "ungrounded").when(F.col("span").isNull(), "outside").when(F.col("_told"), "restated")
    first = F.row_number().over(Window.partitionBy("file", "span", "logic_id", outcome.isNull()).orderBy(*key))
    severity = valid_severity(F.col("severity"), F.lit("Medium"))
    capped = F.when(severity_rank(severity) > severity_rank(F.lit("High")), "High").otherwise(severity)
    title = F.substring(F.coalesce(F.nullif("title", F.lit("")), "logic_title"), 1, TITLE)
    rows = rows.withColumn("outcome", F.coalesce(outcome, F.when(first == 1, "merged").otherwise("repeated")))
    return rows.select(*key, F.col("logic_id").alias("detector_id"), F.col("logic_cwe").alias("cwe"), F.col("logic_owasp").alias("owasp"), title.alias("title"), capped.alias("severity"), "file", "line", F.col("span._name").alias("handler"), F.substring(F.coalesce("note", F.lit("")), 1, NOTE).alias("note"), "outcome")


def packed_chunks(files: DataFrame, budget: int, most: int, order: list[str | Column], scan: list[str] | None = None) -> DataFrame:
    """files: file, n (characters). Adds chunk: files in order fill a chunk until the next one would pass the budget; files beyond the last chunk have none.

    For every file, where a chunk that begins there ends is a place in the running sums: the file whose share of them holds the
    sum before plus the budget (one window over stretches of a budget's length). Following these ends from the first file,
    twice as far in each round, marks the files where chunks begin; their running count numbers the chunks. No step holds a
    scan in one task or array. A file without a size counts as empty; an empty chunk takes a file of any size."""
    kept = scan or []
    one_scan = F.to_json(F.struct(*scan)) if scan else F.lit("")
    by = ["_scan"]
    rows = ordered(files.withColumns({"n": F.coalesce(F.col("n").cast("long"), F.lit(0)), "_scan": one_scan}), by if scan else [], order)
    rows = running_sums(rows, by, {"_pos": F.lit(1), "_to": F.col("n")}).withColumn("_from", F.col("_to") - F.col("n"))
    rows = checkpointed(rows.select(*by, *kept, "file", "n", "_part", "_at", "_pos", "_from", "_to"))
    width = max(budget, 1)
    stretch = lambda x: F.floor(x / F.lit(width)).cast("long")
    takes = rows.filter("n > 0").select(*by, F.explode(F.sequence(stretch(F.col("_from")), stretch(F.col("_to") - 1))).alias("_b"), "_from", F.col("_pos").alias("_p"))
    takes = takes.select(*by, "_b", F.greatest("_from", F.col("_b") * width).alias("_v"), F.lit(0).alias("_k"), F.struct("_p", "_from").alias("_item"), F.lit(None).cast("long").alias("_pos"), F.lit(None).cast("long").alias("_start"))
    asks = rows.select(*by, stretch(F.col("_from") + budget).alias("_b"), (F.col("_from") + budget).alias("_v"), F.lit(1).alias("_k"), F.lit(None).cast("struct<_p:bigint,_from:bigint>").alias("_item"), "_pos", F.col("_from").alias("_start"))
    holds = F.last("_item", True).over(Window.partitionBy(*by, "_b").orderBy("_v", "_k").rowsBetween(Window.unboundedPreceding, 0))
    ends = takes.unionByName(asks).withColumn("_held", holds).filter("_k = 1")
    fits_none = F.col("_held._from") <= F.col("_start")  # nothing before it in the chunk: it is taken, whatever its size
    total = rows.groupBy(*by).agg(F.max("_to").alias("_all"))
    jump = checkpointed(ends.join(total, by).filter(F.col("_v") < F.col("_all")).select(*by, "_pos", (F.col("_held._p") + fits_none.cast("long")).alias("_next")))
    marks, reach, there = checkpointed(rows.filter("_pos = 1").select(*by, "_pos")), 1, -1
    while reach <= most and there < (there := marks.count()):
        both = marks.join(jump, [*by, "_pos"], "left").select(*by, F.explode(F.array("_pos", "_next")).alias("_pos"))
        marks, reach = checkpointed(both.filter("_pos is not null")), 2 * reach
        beyond = jump.select(*by, F.col("_pos").alias("_next"), F.col("_next").alias("_far"))
        jump = checkpointed(jump.join(beyond, [*by, "_next"]).select(*by, "_pos", F.col("_far").alias("_next")))
    begun = marks.withColumn("_begins", F.lit(1))
    chunk = running_sums(rows.join(begun, [*by, "_pos"], "left"), by, {"_chunk": F.coalesce("_begins", F.lit(0))})
    return chunk.select(*kept, "file", F.when(F.col("_chunk") <= most, (F.col("_chunk") - 1).cast("int")).alias("chunk"))


#: Names under which a model may answer; only ``none`` and ``replay`` work without a network.
BACKENDS = ("none", "replay")
HANDLER_HINTS = ("route", "view", "controller", "handler", "endpoint", "api", "resource", "auth", "login", "session", "permission", "admin", "middleware", "serializer")


def discovery_order(path: Column) -> list[Column]:
    """Files that are likely to hold handlers first, then by path."""
    hint = F.lit(False)
    for h in HANDLER_HINTS:
        hint = hint | F.contains(F.lower(path), F.lit(h))
    return [(~hint).cast("int"), path]


def enriched(findings: DataFrame, backend: str, replies: DataFrame | None, shown: DataFrame, handlers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings after all replies of a backend, and the outcome of every item (one row each, unreadable replies included).

    ``none`` changes nothing. Triage goes first, then extra and business-logic findings are added as findings of their own."""
    if backend not in BACKENDS:
        raise ValueError(f"no such backend: {backend}")
    plain = findings.withColumns({c: F.lit(v) for c, v in (("verdict", "unverified"), ("triage_note", ""), ("title", ""), ("source", "builtin")) if c not in findings.columns})
    if backend == "none" or replies is None:
        return plain, plain.sparkSession.createDataFrame([], "reply_id string, ord int, channel string, outcome string")
    read = replies if "reply" in replies.columns else read_replies(replies)
    extra, logic = grounded_extra(plain, items(read, "extra"), shown), logic_outcomes(plain, items(read, "logic"), handlers, shown)
    triage = items(read, "triage")
    known = plain.select("detector_id", "file", "line").distinct().withColumn("_known", F.lit(True))
    said = triage.join(known, ["detector_id", "file", "line"], "left").select("reply_id", "ord", F.lit("triage").alias("channel"), F.when(F.col("_known"), "merged").otherwise("unknown_finding").alias("outcome"))
    for channel, rows in (("extra", extra), ("logic", logic)):
        said = said.union(rows.select("reply_id", "ord", F.lit(channel), "outcome"))
    said = said.union(read.filter("not readable").select("reply_id", F.lit(None).cast("int"), F.lit("reply"), F.lit("unreadable")))
    columns = ["detector_id", "file", "line", "severity", "cwe", "title", "source", "verdict", "triage_note"]
    out = triaged(plain, triage).select(*columns)
    out = out.union(extra.filter("outcome = 'merged'").select(F.lit("LLM-LOGIC"), "file", "line", "severity", F.lit("CWE-284"), "title", F.lit("llm"), F.lit("plausible"), "note"))
    return out.union(logic.filter("outcome = 'merged'").select("detector_id", "file", "line", "severity", "cwe", "title", F.lit("llm-logic"), F.lit("plausible"), "note")), said


def patch_verdicts(before: DataFrame, after: DataFrame, patches: DataFrame, order: list[str]) -> DataFrame:
    """patches: patch_id, detector_id, file, line (the finding to mend), touched (files that the patch edits).

    before: findings; after: findings by patch_id of the patched tree. accepted: the finding is gone, nothing is introduced,
    and the patch edits the finding's file only; else the first reason that holds."""
    from auditweave.operators.diff import fingerprinted

    key = ["detector_id", "file", "norm_evidence", "ordinal"]
    old = fingerprinted(before, order)
    new = fingerprinted(after, order, ["patch_id"])
    introduced = new.join(old.select(*key), key, "left_anti").groupBy("patch_id").agg(F.count("*").alias("introduced"))
    target = patches.join(old.select(*key, "line"), ["detector_id", "file", "line"])
    left = target.join(new.select("patch_id", *key), ["patch_id", *key], "left_semi").select("patch_id", F.lit(True).alias("still"))
    rows = patches.join(introduced, "patch_id", "left").join(left, "patch_id", "left")
    outside = F.size(F.array_except("touched", F.array("file"))) > 0
    reason = F.when(outside, "edits other files").when(F.col("still"), "finding is still there").when(F.coalesce("introduced", F.lit(0)) > 0, "introduces findings").otherwise("")
    return rows.select("patch_id", (reason == "").alias("accepted"), reason.alias("reason"))
