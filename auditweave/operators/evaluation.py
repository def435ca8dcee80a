"""Evaluation corpora: fix commits as labels, labelled sinks, golden tables and markers, scorecards and report grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditweave.functions.text import in_sealed_fifth
from auditweave.operators.patterns import is_production
from auditweave.operators.scoring import TOLERANCE, label_hits

#: Limits of what a fix commit may be to serve as labels, and the weaknesses of the labelled classes of sinks.
LONGEST_BEFORE, MOST_DELETED = 400_000, 200
CLASS_CWES = {"code-injection": ("CWE-94", "CWE-95"), "command-injection": ("CWE-78",), "path-traversal": ("CWE-22",), "prototype-pollution": ("CWE-1321",), "redos": ("CWE-1333",)}


# --- fix commits


def fixed_files(changes: DataFrame, commits: DataFrame, fixes: DataFrame, languages: list[str], kinds: list[str]) -> DataFrame:
    """changes (hash, filename, old_path, code_before, deleted, language, change_type) of commits (hash, repo) that fix (hash, cve_id).

    Sort-merge joins on the commit; changes are cut to the wanted languages and kinds before they are joined."""
    wanted = changes.filter(F.col("language").isin(*languages) & F.col("change_type").isin(*kinds))
    return wanted.join(commits.select("hash", "repo"), "hash").join(fixes.select("hash", "cve_id").distinct(), "hash")


def weaknesses(classification: DataFrame) -> DataFrame:
    """(cve_id, cwes): the ids of each CVE that name a weakness, in order."""
    return classification.filter(F.col("cwe_id").startswith("CWE-")).groupBy("cve_id").agg(F.array_sort(F.collect_set("cwe_id")).alias("cwes"))


def with_skip_reason(rows: DataFrame, cwes: DataFrame, longest: int = LONGEST_BEFORE, most: int = MOST_DELETED) -> DataFrame:
    """Adds cwes and reason: the first rule that leaves a changed file out of the corpus (empty: it stays).

    rows: cve_id, filename, old_path, code_before, deleted (array of line numbers)."""
    path = F.regexp_replace(F.coalesce(F.nullif("old_path", F.lit("")), "filename", F.lit("")), r"\\", "/")
    deleted = F.coalesce(F.size("deleted"), F.lit(0))
    reason = (
        F.when((path == "") | ~is_production(path), "non_production").when(F.length("code_before") > longest, "too_large").when(deleted <= 0, "no_deleted_lines")
        .when(deleted > most, "too_many_deleted").when(F.col("cwes").isNull(), "no_cwe").otherwise("")
    )
    return rows.join(cwes, "cve_id", "left").withColumn("path", path).withColumn("reason", reason)


def skip_counts(rows: DataFrame) -> DataFrame:
    """(reason, n) of the rows left out."""
    return rows.filter("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))


def fix_labels(rows: DataFrame, gap: int = 3) -> DataFrame:
    """One label for each run of deleted lines (gaps up to ``gap``): id, cve_id, file, start_line, end_line, cwes, primary_cwe, language, sealed."""
    stem = F.substring(F.sha2(F.concat_ws("/", "cve_id", "hash", "path"), 256), 1, 12)
    lines = rows.filter("reason = ''").select("cve_id", "hash", "path", "cwes", "language", stem.alias("stem"), F.explode(F.array_sort("deleted")).alias("line")).distinct()
    w = Window.partitionBy("cve_id", "hash", "path").orderBy("line")
    lines = lines.withColumn("new", (F.col("line") - F.lag("line").over(w) > gap).cast("int")).withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(w))
    runs = lines.groupBy("cve_id", "hash", "path", "stem", "language", "cwes", "run").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"))
    file = F.concat_ws("/", "cve_id", "stem", F.regexp_extract("path", r"([^/]*)$", 1))
    return runs.select(F.concat_ws("-", "cve_id", "stem", "start_line").alias("id"), "cve_id", file.alias("file"), "start_line", "end_line", "cwes", F.col("cwes")[0].alias("primary_cwe"), "language", in_sealed_fifth(F.col("cve_id")).alias("sealed"))


# --- labelled sinks


def sink_entries(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of class, package, version, sink (``file:line:column``), as class, package, version, file, line."""
    rows = spark.read.schema("class string, package string, version string, sink string").json(path)
    return rows.select("class", "package", "version", F.regexp_extract("sink", r"^(.*?):(\d+)(?::\d+)?$", 1).alias("file"), F.regexp_extract("sink", r"^(.*?):(\d+)(?::\d+)?$", 2).try_cast("int").alias("line"))


def resolved_sinks(labels: DataFrame, files: DataFrame) -> DataFrame:
    """labels (id, package, file, line) against files (package, file, lines): adds resolved and status.

    exact: the file is there. Otherwise files count whose path ends with the label's path, or the other way round, on whole
    components, and that have the line: one is resolved, several are ambiguous, none of some too_short, none at all absent.
    The longer path is exploded to its endings on either side, so both directions are equality joins within a package."""
    want, have = F.split("file", "/"), F.split("path", "/")
    ends = lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    there = files.select("package", F.col("file").alias("path"), "lines")
    wanted = labels.select("id", "package", "file", "line")
    longer = wanted.join(there.withColumn("file", F.explode(ends(have))), ["package", "file"])
    shorter = wanted.withColumn("path", F.explode(ends(want))).join(there, ["package", "path"])
    named = longer.select("id", "file", "line", "path", "lines").union(shorter.select("id", "file", "line", "path", "lines")).distinct()
    found = named.groupBy("id").agg(
        F.max(F.when(F.col("path") == F.col("file"), F.col("path"))).alias("same"), F.count_if(F.col("lines") >= F.col("line")).alias("fit"), F.min(F.when(F.col("lines") >= F.col("line"), F.col("path"))).alias("one")
    )
    status = F.when(F.col("same").isNotNull(), "exact").when(F.col("fit") == 1, "resolved").when(F.col("fit") > 1, "ambiguous").when(F.col("fit").isNotNull(), "too_short").otherwise("absent")
    out = labels.join(found, "id", "left").withColumn("status", status)
    return out.withColumn("resolved", F.when(F.col("status") == "exact", F.col("same")).when(F.col("status") == "resolved", F.col("one"))).drop("same", "fit", "one")


def sink_hits(labels: DataFrame, findings: DataFrame) -> DataFrame:
    """labels (id, class, package, resolved, line) against findings (package, file, line, cwe): adds hit, within TOLERANCE lines and with a weakness of the class."""
    cwes = F.create_map(*(x for k, v in CLASS_CWES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    regions = labels.filter("resolved is not null").select("id", F.concat_ws("/", "package", "resolved").alias("file"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.coalesce(F.try_element_at(cwes, F.col("class")), F.array().cast("array<string>")).alias("cwes"))
    hits = label_hits(regions, findings.select(F.concat_ws("/", "package", "file").alias("file"), "line", "cwe"), TOLERANCE).filter("strict").select("id", F.lit(True).alias("hit"))
    return labels.join(hits, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def unmatched(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """Findings (file, line) in no labelled region (file, start_line, end_line)."""
    regions = labels.select("file", "start_line", "end_line")
    inside = (findings["file"] == regions["file"]) & findings["line"].between(regions["start_line"], regions["end_line"])
    return findings.join(regions, inside, "left_anti")


def samples_of_class(misses: DataFrame, of: str, order: list[str | Column], most: int = 5) -> DataFrame:
    """The first rows of each class, sealed ones left out: the report's list of samples."""
    return misses.filter("not sealed").withColumn("_n", F.row_number().over(Window.partitionBy(of).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


# --- golden tables, markers and report grading


def golden_rows(lines: DataFrame) -> DataFrame:
    """lines: value (of a Markdown file). Rows ``| V1 | class | A05 / CWE-502/94 | place |``: id, class, owasp, cwes, place."""
    row = r"^\|\s*(V\d+)\s*\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|"
    part = lambda k: F.regexp_extract("value", row, k)
    numbers = F.flatten(F.transform(F.regexp_extract_all(part(3), F.lit(r"CWE-([\d/]+)"), F.lit(1)), lambda x: F.split(x, "/")))
    cwes = F.array_distinct(F.transform(F.filter(numbers, lambda x: x != ""), lambda x: F.concat(F.lit("CWE-"), x)))
    rows = lines.filter(F.regexp_like("value", F.lit(row))).select(part(1).alias("id"), part(2).alias("class"), F.regexp_extract(part(3), r"\b(A\d{2}|LLM\d{2})\b", 1).alias("owasp"), cwes.alias("cwes"), part(4).alias("place"))
    return rows.withColumn("cwes", F.when(F.size("cwes") > 0, F.col("cwes")).otherwise(F.array(F.lit("CWE-Other"))))


def marker_regions(files: DataFrame) -> DataFrame:
    """files: file, text. Regions from a comment marker ``V12 —`` or ``S8 -`` to the line before the next one: file, id, start_line, end_line."""
    text = F.regexp_replace("text", r"\n\z", "")
    lines = files.select("file", F.size(F.split(text, "\n", -1)).alias("last"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    marked = lines.withColumn("id", F.regexp_extract("line", r"(?:^|\s)([VS]\d+)\s*[—–-]", 1)).filter("id <> ''").select("file", "id", "last", (F.col("at") + 1).alias("start_line"))
    following = F.lead("start_line").over(Window.partitionBy("file").orderBy("start_line"))
    return marked.select("file", "id", "start_line", F.coalesce(following - 1, F.col("last")).alias("end_line"))


def distinctive_tokens(golden: DataFrame, generic: list[str]) -> DataFrame:
    """(token): names in backticks that the place of one golden row only has, generic ones left out."""
    tokens = golden.select("id", F.explode(F.array_distinct(F.regexp_extract_all("place", F.lit("`([^`]+)`"), F.lit(1)))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n")).filter((F.col("n") == 1) & ~F.col("token").isin(*generic)).select("token")


def graded(golden: DataFrame, report: str, generic: list[str]) -> DataFrame:
    """(id, signal): what in a report's text gives credit for each golden row: its first weakness, else the first distinctive token; null: missed."""
    said = F.lit(report)
    tokens = golden.select("id", F.explode(F.array_distinct(F.regexp_extract_all("place", F.lit("`([^`]+)`"), F.lit(1)))).alias("token")).join(distinctive_tokens(golden, generic), "token")
    alone = F.concat(F.lit(r"(?<![\w.])"), F.regexp_replace("token", r"([\\^$.|?*+()\[\]{}])", r"\\$1"), F.lit(r"(?![\w])"))
    by_token = tokens.filter(F.regexp_like(said, alone)).groupBy("id").agg(F.min("token").alias("token"))
    first = F.col("cwes")[0]
    by_cwe = F.when((first != "CWE-Other") & F.regexp_like(said, F.concat(first, F.lit(r"(?!\d)"))), first)
    return golden.join(by_token, "id", "left").select("id", F.coalesce(by_cwe, F.concat(F.lit("token "), "token")).alias("signal"))


# --- scorecards


def newest_cards(cards: DataFrame, date: str) -> DataFrame:
    """One card for each repo: that of the date if there is one, else the newest. cards: repo, date, ..."""
    w = Window.partitionBy("repo").orderBy((F.col("date") == date).desc(), F.col("date").desc())
    return cards.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def family_totals(cards: DataFrame) -> DataFrame:
    """(family, tp, total) over cards with families: array of struct(family, tp, fn)."""
    rows = cards.select(F.explode("families").alias("f")).select("f.*")
    return rows.groupBy("family").agg(F.sum("tp").alias("tp"), F.sum(F.col("tp") + F.col("fn")).alias("total"))


def consistent(overall: DataFrame, parts: DataFrame, columns: list[str]) -> DataFrame:
    """One row: stated and summed values of each column, and whether they agree (no parts agree with anything)."""
    summed = parts.agg(F.count("*").alias("n_parts"), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"sum_{c}") for c in columns))
    row = overall.select(*(F.col(c).alias(f"stated_{c}") for c in columns)).join(F.broadcast(summed))  # one row each
    agree = F.lit(True)
    for c in columns:
        agree = agree & (F.col(f"stated_{c}") == F.col(f"sum_{c}"))
    return row.withColumn("consistent", (F.col("n_parts") == 0) | agree)


def one_engine(runs: DataFrame) -> DataFrame:
    """One row: the number of different engine digests among runs, and whether they may be scored together."""
    return runs.agg(F.count_distinct("engine_digest").alias("digests")).withColumn("comparable", F.col("digests") <= 1)


def engine_digest(files: DataFrame) -> DataFrame:
    """One row: a digest over the digests of all files (file, content) in order of their names; contents never meet in one task."""
    each = files.select("file", F.sha2("content", 256).alias("sha"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "sha"))), lambda x: F.concat_ws(" ", x["sha"], x["file"])), "\n"), 256).alias("engine_digest"))


def pending(work: DataFrame, done: DataFrame, digest: str) -> DataFrame:
    """Keys (corpus, entry) of work without a cached result of this engine: an incremental run."""
    return work.join(done.filter(F.col("engine_digest") == digest).select("corpus", "entry"), ["corpus", "entry"], "left_anti")


def worst_repos(cards: DataFrame, families: list[str], most: int = 12) -> DataFrame:
    """(repo, missed, share): the repos with the most missed labels of the families, and their running share of all misses: a sub-sample for an expensive tier."""
    missed = cards.select("repo", F.explode("families").alias("f")).filter(F.col("f.family").isin(*families)).groupBy("repo").agg(F.sum("f.fn").alias("missed"))
    top = missed.orderBy(F.desc("missed"), F.desc("repo")).limit(most)
    w = Window.orderBy(F.desc("missed"), F.desc("repo")).rowsBetween(Window.unboundedPreceding, 0)  # most rows only
    total = missed.agg(F.sum("missed").alias("all"))
    return top.withColumn("so_far", F.sum("missed").over(w)).join(F.broadcast(total)).select("repo", "missed", (F.col("so_far") / F.col("all")).alias("share"))


def clause_coverage(register: DataFrame, column: str, always: list[str]) -> DataFrame:
    """(clause): every clause that a compliance register reaches or that always holds."""
    spark = register.sparkSession
    named = register.select(F.explode(F.split(F.coalesce(column, F.lit("")), "; ")).alias("clause")).filter("clause <> ''")
    return named.union(spark.createDataFrame([(a,) for a in always], "clause string")).distinct()


def rules_by_group(ids: DataFrame) -> DataFrame:
    """(group, n) of rules (detector_id)."""
    from auditweave.functions.text import rule_group

    return ids.groupBy(rule_group(F.col("detector_id")).alias("group")).agg(F.count("*").alias("n"))
