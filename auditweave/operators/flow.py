"""Data flow over a project: facts of every file, then a fixed point of joins.

Each file is read once, by itself, into facts (``functions.flowfacts``); no task sees a whole project. Calls are resolved by
joins of callees with functions, bindings and exports. Then the reach of origins grows round by round: what a callee does
with its parameters is joined to the call's arguments, what a call gives to what its result reaches. Rounds end when nothing
is new, so recursion and cycles of imports end; their number is the longest chain of calls that a value passes. Everything is
keyed by file (and so by project, where paths begin with one).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.functions import jsflow, levels, pyflow
from auditweave.operators.imports import checkpointed
from auditweave.operators.patterns import is_production

SCRIPTS = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts")
COLUMNS = {
    "what": "string", "file": "string", "func": "string", "o_kind": "string", "o_name": "string", "o_line": "int", "t_kind": "string", "t_name": "string", "t_line": "int", "t_cwe": "string", "t_severity": "string", "call": "int", "names": "array<string>",
}
ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}


def flow_facts(files: DataFrame) -> DataFrame:
    """files: file, text. One row a fact: what is reach, call, def, import or export. Production Python and script files only."""

    def rows_of(file: str, text: str) -> list[dict]:
        facts = (pyflow if file.lower().endswith(".py") else jsflow).facts_of(text, file)
        rows = [{"what": "reach", "func": g, "o_kind": o.kind, "o_name": o.name, "o_line": o.line, "t_kind": t.kind, "t_name": t.name, "t_line": t.line, "t_cwe": t.cwe, "t_severity": t.severity, "call": t.call} for g, o, t in sorted(facts.reach)]
        rows += [{"what": "call", "func": g, "o_name": callee, "call": n} for n, (g, callee) in facts.calls.items()]
        rows += [{"what": "def", "func": g, "names": params} for g, params in facts.params.items()]
        rows += [{"what": "import", "o_name": local, "names": there, "t_name": name} for local, there, name in facts.imports if there]
        rows += [{"what": "export", "o_name": name, "func": g} for name, g in facts.exports.items()]
        return rows

    def run(batches):
        for b in batches:
            rows = [{**r, "file": f} for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in rows_of(f, t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], ARROW[t]) for c, t in COLUMNS.items()], list(COLUMNS))

    ext = F.lower(F.regexp_extract("file", r"(\.[^./]+)$", 1))
    code = files.filter(ext.isin(".py", *SCRIPTS) & is_production(F.col("file"))).select("file", "text")
    return code.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in COLUMNS.items()))


def resolved_calls(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(file, call, to_file, to_func): own functions first, then bound names, then members of bound modules."""
    calls = facts.filter("what = 'call' and o_name <> ''").select("file", "call", F.col("o_name").alias("callee"))
    defs = facts.filter("what = 'def'").select(F.col("file").alias("to_file"), F.col("func").alias("to_func"))
    exports = facts.filter("what = 'export'").select(F.col("file").alias("to_file"), F.col("o_name").alias("name"), F.col("func").alias("given"))
    tried = facts.filter("what = 'import'").select("file", F.col("o_name").alias("local"), F.col("t_name").alias("name"), "names", F.monotonically_increasing_id().alias("id"))
    there = tried.select("file", "local", "name", "id", F.posexplode("names").alias("ord", "to_file")).join(files.select(F.col("file").alias("to_file")).distinct(), "to_file", "left_semi")
    bound = there.groupBy("file", "local", "name").agg(F.max_by("to_file", F.struct("id", -F.col("ord"))).alias("to_file"))  # a later binding of a name replaces an earlier one
    parts = calls.withColumn("head", F.regexp_extract("callee", r"^(.*)\.[^.]*$", 1)).withColumn("last", F.regexp_extract("callee", r"([^.]*)$", 1))
    own = parts.select("file", "call", F.lit(0).alias("rank"), F.col("file").alias("to_file"), F.col("callee").alias("name"))
    named = parts.join(bound.filter("name <> '*'").select("file", F.col("local").alias("callee"), "to_file", "name"), ["file", "callee"]).select("file", "call", F.lit(1).alias("rank"), "to_file", "name")
    member = parts.join(bound.filter("name = '*'").select("file", F.col("local").alias("head"), "to_file"), ["file", "head"]).select("file", "call", F.lit(2).alias("rank"), "to_file", F.col("last").alias("name"))
    wanted = named.union(member).join(exports, ["to_file", "name"], "left").select("file", "call", "rank", "to_file", F.coalesce("given", "name").alias("to_func"))
    found = own.withColumnRenamed("name", "to_func").select("file", "call", "rank", "to_file", "to_func").union(wanted).join(defs, ["to_file", "to_func"], "left_semi")
    return found.groupBy("file", "call").agg(F.min(F.struct("rank", "to_file", "to_func")).alias("at")).select("file", "call", "at.to_file", "at.to_func")


KEY = ["file", "func", "o_kind", "o_name", "o_line", "o_file", "t_kind", "t_name", "t_line", "t_file", "t_cwe", "t_severity", "call"]


def reaches(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(file, func, origin, target) of everything that an origin reaches in the project."""
    facts = checkpointed(facts)
    to = checkpointed(resolved_calls(facts, files))
    base = facts.filter("what = 'reach'").withColumn("o_file", F.when(F.col("o_kind") != "result", F.col("file")).otherwise("")).withColumn("t_file", F.when(F.col("t_kind") == "sink", F.col("file")).otherwise(""))
    base = base.select(*KEY).join(to.select("file", "call", F.lit(True).alias("known")), ["file", "call"], "left").filter("t_kind <> 'sink' or known is null").select(*KEY)
    params = facts.filter("what = 'def'").select(F.col("file").alias("to_file"), F.col("func").alias("to_func"), F.posexplode("names").alias("pos", "param"))
    origin, target = ["o_kind", "o_name", "o_line", "o_file"], ["t_kind", "t_name", "t_line", "t_file", "t_cwe", "t_severity", "call"]

    def passed(rows: DataFrame) -> DataFrame:
        """Origins that reach an argument, with the callee's parameter (null: unknown function)."""
        given = rows.filter("t_kind = 'arg'").select("file", "func", *origin, F.col("t_name").alias("arg"), "call").join(to, ["file", "call"], "left")
        by_place = (F.col("arg") == F.col("pos").cast("string")) | (F.col("arg") == F.concat(F.lit("="), "param"))
        return given.join(params, ["to_file", "to_func"], "left").filter(F.col("to_file").isNull() | by_place).select("file", "func", *origin, "call", "to_file", "to_func", "param")

    def uses(rows: DataFrame) -> DataFrame:
        """What the result of a call reaches."""
        return rows.filter("o_kind = 'result'").select("file", F.col("o_name").cast("int").alias("of"), "func", *target)

    def callee(rows: DataFrame, kind: str) -> DataFrame:
        return rows.filter(F.col("o_kind") == kind).select(F.col("file").alias("to_file"), F.col("func").alias("to_func"), *(F.col(c).alias("c_" + c) for c in [*origin, *target]))

    def through(given: DataFrame, used: DataFrame) -> DataFrame:
        return given.join(used.withColumnRenamed("call", "t_call").drop("func"), (given["file"] == used["file"]) & (given["call"] == used["of"])).select(given["file"], "func", *origin, *target[:-1], F.col("t_call").alias("call"))

    def derived(a: DataFrame, b: DataFrame) -> DataFrame:
        """Rows that follow from a row of a and rows of b."""
        given, summary = passed(a), callee(b, "param")
        met = given.join(summary, ["to_file", "to_func"]).filter("param = c_o_name")
        into = met.filter("c_t_kind = 'sink'").select("file", "func", *origin, *(F.col("c_" + c).alias(c) for c in target))
        back = met.filter("c_t_kind = 'return'").select("file", "func", *origin, "call").union(given.filter("to_file is null").select("file", "func", *origin, "call")).distinct()
        asked = callee(b, "request").filter("c_t_kind = 'return'")
        sources = to.join(asked, ["to_file", "to_func"]).select("file", "call", *(F.col("c_" + c).alias(c) for c in origin))
        used = uses(a)
        gives = sources.join(used.withColumnRenamed("call", "t_call"), (sources["file"] == used["file"]) & (sources["call"] == used["of"])).select(sources["file"], "func", *origin, *target[:-1], F.col("t_call").alias("call"))
        return into.select(*KEY).union(through(back, uses(b)).select(*KEY)).union(gives.select(*KEY))

    known = delta = checkpointed(base.distinct())
    first = True
    while True:
        # a row is new only if one of its premises is: each premise takes the new rows in turn, the others all rows
        found = derived(known, known) if first else derived(delta, known).union(derived(known, delta))
        first = False
        delta = checkpointed(found.distinct().join(known, KEY, "left_anti"))
        if delta.limit(1).count() == 0:
            return known
        known = checkpointed(known.union(delta))


def best_paths(reach: DataFrame) -> DataFrame:
    """One path for each sink, line and file: from a request if there is one, then from the earliest place."""
    order = [F.col("o_kind") == "param", "o_file", "o_line", "o_name"]
    rows = reach.filter("t_kind = 'sink' and o_kind <> 'result'").withColumn("_n", F.row_number().over(Window.partitionBy("t_file", "t_line", "t_name").orderBy(*order))).filter("_n = 1")
    kind = F.when(F.col("o_kind") == "param", "parameter").otherwise(F.col("o_kind"))
    confidence = F.when(kind == "request", "high").otherwise("medium")
    return rows.select(F.col("t_file").alias("file"), F.col("t_name").alias("sink_id"), F.col("t_cwe").alias("cwe"), levels.by_confidence(F.col("t_severity"), confidence).alias("severity"), F.col("t_line").alias("line"), F.col("o_name").alias("source"), F.col("o_line").alias("source_line"), F.col("o_file").alias("source_file"), kind.alias("kind"), confidence.alias("confidence"))


def project_paths(files: DataFrame) -> DataFrame:
    """files: file, text. Paths from request values and parameters to sinks, across functions and modules."""
    return best_paths(reaches(flow_facts(files), files))


def described(path: Column) -> Column:
    """Steps of a path in words: ``L12: source (kind) → L13: …``. path: array of struct<line, what, kind>."""
    return F.array_join(F.transform(path, lambda s: F.concat(F.lit("L"), s["line"].cast("string"), F.lit(": "), s["what"], F.when(s["kind"] != "", F.concat(F.lit(" ("), s["kind"], F.lit(")"))).otherwise(""))), " → ")


#: What the flow does not see, for every report that shows its paths.
LIMITATIONS = (
    "Values kept in attributes, containers' members and closures are followed by the name that holds them, not by the member.",
    "Calls through computed names, inheritance and run-time code are calls of unknown functions, which pass their arguments on.",
    "A test that leaves the function clears the names that it asks about, whatever it asks.",
    "A file that does not parse gives no facts.",
)
