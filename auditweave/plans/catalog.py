"""The registered queries over the driver's tables; their DuckDB equivalents are in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditweave.functions import levels, redos, text
from auditweave.operators import compliance, dependencies, diff, findings, imports, intervals, php, scoring
from auditweave.plans import built, corpus
from auditweave.plans.corpus import ORDER, SUPERSEDED, TIER_ORDER, table
from auditweave.plans.oracle import ORACLE_SQL as OWN_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SHOWN = ("detector_id", "severity", "cwe", "file", "line", "evidence", "source")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*SHOWN, *more).withColumn("line", F.col("line").cast("long"))


@query
def q01_scan_findings(spark, sf_dir):
    return shown(corpus.scan(spark, sf_dir), "confidence")


@query
def q02_severity_counts_zero_filled(spark, sf_dir):
    return findings.severity_counts(findings.first_wins(corpus.scan(spark, sf_dir), ORDER))


@query
def q03_once_per_file(spark, sf_dir):
    w = Window.partitionBy("file", "detector_id").orderBy("start")
    return shown(corpus.scan(spark, sf_dir).withColumn("_n", F.row_number().over(w)).filter("_n = 1"))


@query
def q04_first_wins_dedupe(spark, sf_dir):
    return shown(findings.first_wins(corpus.tiers(spark, sf_dir), TIER_ORDER))


@query
def q05_top_source_filter(spark, sf_dir):
    return shown(findings.top_source(corpus.tiers(spark, sf_dir)))


@query
def q06_superseded_anti_join(spark, sf_dir):
    return shown(findings.without_superseded(corpus.scan(spark, sf_dir), SUPERSEDED))


@query
def q07_dedupe_pipeline(spark, sf_dir):
    return shown(findings.deduplicated(corpus.tiers(spark, sf_dir), SUPERSEDED, TIER_ORDER))


@query
def q08_corroborate_nearest(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    tainted = F.col("l_partkey") % 2 == 0
    rows = lines.select(F.col("l_orderkey").cast("string").alias("file"), F.col("l_returnflag").alias("cwe"), F.col("l_linenumber").cast("long").alias("line"), F.when(tainted, "taint").otherwise("builtin").alias("source"), F.when(F.col("l_tax") > 0.04, "high").otherwise("medium").alias("confidence"),
                        F.when(tainted, F.col("l_suppkey").cast("string")).otherwise("").alias("taint_path"), F.col("l_partkey").alias("seq"))
    return findings.corroborated(rows, ["line", "seq"])


@query
def q09_ranked_top_k(spark, sf_dir):
    return shown(findings.by_severity(findings.deduplicated(corpus.tiers(spark, sf_dir), SUPERSEDED, TIER_ORDER), ("file", "line", "detector_id", "source")).limit(10))


def _advisories(spark, sf_dir):
    part, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    advisories = part.select(F.col("p_partkey").cast("string").alias("package"), (F.col("p_partkey") % 11 != 0).alias("indexable"), F.element_at(F.array(*map(F.lit, levels.SEVERITIES)), (F.col("p_size") % 5 + 1).cast("int")).alias("severity"))
    used = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    package = F.when(F.col("l_quantity") > 47, F.col("l_partkey").cast("string")).otherwise(F.concat(F.lit("own-"), F.col("l_suppkey").cast("string")))  # most imports are of packages without advisories
    index = dependencies.importers(used.select(package.alias("package"), F.col("o_orderstatus").alias("status")), F.col("status") != "F")
    declared = part.select(F.col("p_partkey").cast("string").alias("package"), (F.col("p_size") % 3 == 0).alias("in_dev"), (F.col("p_size") % 3 == 1).alias("in_runtime"))
    return dependencies.vex_verdicts(advisories, index, declared).withColumnRenamed("severity", "severity_after")


@query
def q10_vex_classify(spark, sf_dir):
    return _advisories(spark, sf_dir).groupBy("vex_status", "vex_justification", "indexable").agg(F.count("*").alias("n"))


@query
def q11_vex_severity_ladder(spark, sf_dir):
    return _advisories(spark, sf_dir).select("package", "vex_status", "severity_after", levels.by_confidence(F.col("severity_after"), F.when(F.col("indexable"), "high").otherwise("medium")).alias("severity_shown"))


def _exploitable(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cve = F.concat(F.lit("CVE-2024-"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))
    rows = part.select(cve.alias("cve"), F.col("p_brand").alias("package"), F.element_at(F.array(*map(F.lit, levels.SEVERITIES)), (F.col("p_size") % 5 + 1).cast("int")).alias("severity"), "p_partkey", "p_retailprice")
    kev, epss = rows.filter("p_partkey % 17 = 0").select("cve"), rows.filter("p_partkey % 3 <> 0").select("cve", (F.col("p_retailprice") % 100 / 400).alias("score"))
    return dependencies.exploitation(rows, kev, epss)


@query
def q12_exploitation_join(spark, sf_dir):
    return _exploitable(spark, sf_dir).select("cve", "package", "severity", "exploitation")


RANK_OF_EVENT = {"purchase": "exploited", "signup": "elevated", "click": "listed"}


def _events(spark, sf_dir):
    status = F.lit("unknown")
    for k, v in RANK_OF_EVENT.items():
        status = F.when(F.col("event_type") == k, v).otherwise(status)
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("cve"), F.col("event_type").alias("package"), F.lit("").alias("vex_status"), F.lit("High").alias("severity"), status.alias("exploitation"), "event_id", "ts")


def _watch(spark, sf_dir):
    events = _events(spark, sf_dir)
    state = dependencies.watch_start(events.filter("event_id % 2 = 0"), ["event_id"], "2024-01-01")
    rank = levels.ranked(F.col("exploitation"), levels.EXPLOITATION_RANK)
    current = events.filter("event_id % 2 = 1").groupBy("cve").agg(F.max_by("exploitation", rank).alias("exploitation"))
    return state, dependencies.watch_compare(state, current)


@query
def q13_watchlist_init(spark, sf_dir):
    return _watch(spark, sf_dir)[0]


@query
def q14_watch_compare(spark, sf_dir):
    return _watch(spark, sf_dir)[1]


@query
def q15_watch_advance(spark, sf_dir):
    state, compared = _watch(spark, sf_dir)
    return dependencies.watch_advance(state, compared, "2024-02-02")


def _diff(spark, sf_dir):
    """Two snapshots from one scan: the current one lacks files that the baseline has and the other way round, and some moved down."""
    rows = corpus.scan(spark, sf_dir).withColumn("line", F.col("line").cast("long")).withColumn("package", F.when(F.col("doc_id") % 13 == 0, "dep").otherwise(""))
    side = F.filter(F.array(F.when(F.col("doc_id") % 5 != 0, 0), F.when(F.col("doc_id") % 7 != 0, 1)), lambda x: x.isNotNull())
    rows = rows.withColumn("side", F.explode(side)).withColumn("line", F.col("line") + F.when((F.col("side") == 1) & (F.col("doc_id") % 3 == 0), 2).otherwise(0))
    return diff.tagged_diff(rows, ["line", *ORDER])


@query
def q16_diff_introduced(spark, sf_dir):
    return _diff(spark, sf_dir).filter("change = 'introduced'")


@query
def q17_diff_resolved(spark, sf_dir):
    return _diff(spark, sf_dir).filter("change = 'resolved'")


@query
def q18_diff_moved(spark, sf_dir):
    return _diff(spark, sf_dir).filter("change in ('moved', 'unchanged', 'not_compared')").groupBy("change", "detector_id").agg(F.count("*").alias("n"), F.sum("line").alias("lines"), F.sum("baseline_line").alias("baseline_lines"))


@query
def q19_gate(spark, sf_dir):
    return findings.passes_gate(_diff(spark, sf_dir).filter("change = 'introduced'"), "High")


@query
def q20_sarif_fingerprint(spark, sf_dir):
    return diff.sarif_fingerprint(corpus.scan(spark, sf_dir), ORDER).select("file", "detector_id", F.col("line").cast("long").alias("line"), "fingerprint")


def _labelled(spark, sf_dir):
    """Each labelled document is a region of lines; what its quality label rejects is to be found by a style or secret rule."""
    files = corpus.files(spark, sf_dir).select("doc_id", "file", "ext", "source")
    labels = table(spark, sf_dir, "labels").join(files, "doc_id").select(F.col("doc_id").cast("string").alias("id"), "file", F.lit(1).alias("start_line"), F.lit(3).alias("end_line"), F.array(F.lit("CWE-1078"), F.lit("CWE-798")).alias("cwes"), (F.col("quality") == 0).alias("is_vulnerable"), F.col("ext").alias("language"), F.col("source").alias("class"))
    return scoring.label_hits(labels, corpus.scan(spark, sf_dir))


@query
def q21_label_match(spark, sf_dir):
    return _labelled(spark, sf_dir).select("id", "file", "is_vulnerable", "loose", "strict")


@query
def q22_confusion_by_class(spark, sf_dir):
    return scoring.confusion(_labelled(spark, sf_dir), ["class", "language"], F.col("is_vulnerable"), F.col("strict"))


def _hunks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 997).alias("file"), (F.col("l_partkey") % 400).alias("line")).distinct()
    return intervals.islands(rows, ["file"], "line", 3)


@query
def q23_range_join_recall(spark, sf_dir):
    labels = _hunks(spark, sf_dir).select(F.concat_ws(":", "file", "start_line").alias("id"), F.col("file").cast("string").alias("file"), "start_line", "end_line", F.array(F.lit("CWE-R"), F.lit("CWE-N")).alias("cwes"))
    file = F.concat((F.col("l_orderkey") % 997).cast("string"), F.when(F.col("l_quantity") > 49, "").otherwise(".old"))  # most results are in files without labels
    results = table(spark, sf_dir, "lineitem").select(file.alias("file"), (F.col("l_suppkey") % 400).alias("line"), F.concat(F.lit("CWE-"), "l_returnflag").alias("cwe"))
    by_file = scoring.label_hits(labels, results, scoring.TOLERANCE).groupBy("file").agg(F.bool_or("loose").alias("loose"), F.bool_or("strict").alias("strict"), F.count("*").alias("n_hunks"))
    return by_file.agg(F.count("*").alias("n_files"), F.sum("n_hunks").alias("n_hunks"), F.count_if("loose").alias("loose_files"), F.count_if("strict").alias("strict_files")).withColumn("recall", scoring.ratio(F.col("loose_files"), F.col("n_files"))).withColumn("strict_recall", scoring.ratio(F.col("strict_files"), F.col("n_files")))


@query
def q24_hunks(spark, sf_dir):
    return _hunks(spark, sf_dir)


@query
def q25_excerpt_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 5000 + 1).alias("line"))
    return intervals.merged_windows(rows, ["user_id"], "line", 14)


@query
def q26_concentration(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "p_type", (F.col("l_suppkey") % 4).alias("supplier"))
    return scoring.concentration(rows, ["p_brand", "p_type"], "supplier", 40, 0.3)


@query
def q27_sealed_split(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.in_sealed_fifth(F.col("c_name")).alias("sealed"))


@query
def q28_noise_per_kloc(spark, sf_dir):
    lines = corpus.files(spark, sf_dir).groupBy("source").agg(F.sum(text.newlines(F.col("text")) + 1).alias("lines"))
    found = corpus.scan(spark, sf_dir).groupBy("origin").agg(F.count("*").alias("n"))
    return scoring.per_kloc(lines.join(found, F.col("source").eqNullSafe(F.col("origin")), "left").select("source", "lines", F.coalesce("n", F.lit(0)).alias("n")), ["source"], "n", "lines")


@query
def q29_loudest_top10(spark, sf_dir):
    return corpus.scan(spark, sf_dir).groupBy("detector_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "detector_id").limit(10)


@query
def q30_stream_high_water(spark, sf_dir):
    from auditweave.streaming.watch import high_water_of_table

    return high_water_of_table(spark, f"{sf_dir}/events.parquet")


@query
def q59_watch_alerts(spark, sf_dir):
    """Alerts of the watch over all events as a stream; its state and alerts stay in the shared folder, from which the result is read."""
    from auditweave.streaming import alerts, watch

    folder = watch.shared_folder(spark, "watch_alerts")
    alerts.watched(watch.status_stream(spark, f"{sf_dir}/events.parquet"), folder).awaitTermination()
    return alerts.told(spark, folder).select("cve", "was", "now", F.date_format("since", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("since"), "n")


@query
def q31_session_hunks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "n")


@query
def q32_compliance_register(spark, sf_dir):
    return compliance.register(shown(findings.deduplicated(corpus.tiers(spark, sf_dir), SUPERSEDED, TIER_ORDER)))


@query
def q33_budgeted_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("long").alias("n"))
    return intervals.within_budget(rows, ["source"], [F.desc("n"), "doc_id"], F.col("n"), 60_000).select("source", "doc_id", "n", "used")


@query
def q34_sbom_components(spark, sf_dir):
    locked = lambda c: F.max(F.when(F.col("l_quantity") > 45, F.col(c)))  # noqa: E731  the other lines have no version
    resolved = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(locked("l_linenumber").alias("major"), locked("l_suppkey").alias("minor"))
    rows = table(spark, sf_dir, "part").join(resolved, F.col("p_partkey") == F.col("l_partkey"), "left")
    name, version = F.concat(F.lit("@"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit("/part-"), F.col("p_partkey").cast("string")), F.coalesce(F.concat_ws(".", F.col("major").cast("string"), F.nullif(F.col("minor").cast("string"), F.lit(""))), F.lit(""))
    version = F.when(F.col("major").isNull(), "").otherwise(version)
    return rows.select(name.alias("name"), version.alias("version"), text.purl(name, version).alias("purl"), text.spdx_id(F.concat(F.lit("Package-"), name)).alias("spdx_id"), (version == "").alias("unresolved"))


@query
def q35_comment_views(spark, sf_dir):
    html = F.coalesce("html", F.lit(""))
    comments = F.regexp_extract_all(html, F.lit("(?s)<!--.*?-->"), F.lit(0))
    return table(spark, sf_dir, "pages").select("page_id", F.size(comments).cast("long").alias("n_comments"), F.aggregate(comments, F.lit(0), lambda a, c: a + F.length(c)).cast("long").alias("comment_chars"), F.length(F.regexp_replace(html, "(?s)<!--.*?-->", "")).cast("long").alias("left_chars"))


@query
def q38_module_fixpoint(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    edges = n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + F.col("n_regionkey")) % 25).alias("dst")).union(n.filter("n_regionkey = 1").select("n_nationkey", ((F.col("n_nationkey") + 1) % 25).alias("dst")))
    return imports.reachable(edges, n.select(F.col("n_nationkey").alias("node")))


@query
def q39_import_resolution(spark, sf_dir):
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    there = pages.filter("page_id % 3 <> 0").select(F.concat("host", "path").alias("file"))
    bare = F.regexp_replace("host", r"^(?:www|m)[.]", "")
    wanted = pages.select(F.col("page_id").alias("importer"), F.array(F.concat("host", "path"), F.concat(bare, "path"), F.concat(F.lit("www."), bare, "path"), F.concat(F.lit("m."), bare, "path")).alias("candidates"))
    return imports.resolved_imports(wanted, there)


@query
def q40_miss_causes(spark, sf_dir):
    rows = _labelled(spark, sf_dir).filter("is_vulnerable and not strict")
    cause = F.when(F.col("loose"), "other weakness").when(F.col("language") != "en", "language").when(text.in_sealed_fifth(F.col("id")), "sealed").otherwise("silent")
    return rows.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


SNIPPETS = ("(a+)+", r"((a)+)+", r"\S+@\S+$", r"\d*[.]?\d+x", r"\d+\.\d+", r"^\s+(.*)$", "(a|ab)*", "abc")


@query
def q36_redos_verdict(spark, sf_dir):
    """Fixture patterns, each also prefixed by the words of the parts' types, so that the judgement runs over a table."""
    patterns = spark.createDataFrame([(p,) for p in SNIPPETS], "snippet string")
    words = table(spark, sf_dir, "part").select(F.lower("p_type").alias("word")).distinct()
    rows = words.crossJoin(F.broadcast(patterns)).withColumn("pattern", F.concat("word", F.lit(" "), "snippet"))  # eight fixed snippets
    return rows.withColumn("v", redos.backtracking(F.col("pattern"))).select("pattern", F.col("v.degree").alias("degree"), F.col("v.why").alias("why"), redos.severity_of(F.col("v.degree")).alias("severity"))


@query
def q37_php_paths(spark, sf_dir):
    """One small PHP file for each nation: a request value, one hop, a sink that depends on the region, and a sanitised twin."""
    sinks = F.array(*map(F.lit, ('$db->q("SELECT a FROM b WHERE c=$x");', "include $x;", "system($x);", "unlink($x);", "echo $x;")))
    code = F.concat(F.lit('<?php\n$id = $_GET["id"];\n$x = "p" . $id;\n$y = intval($_POST["n"]);\n'), F.element_at(sinks, (F.col("n_regionkey") % 5 + 1).cast("int")), F.lit("\necho $y;\n"))
    files = table(spark, sf_dir, "nation").select(F.concat(F.lit("src/n"), F.col("n_nationkey").cast("string"), F.lit(".php")).alias("file"), code.alias("text"))
    return php.php_paths(files).withColumn("line", F.col("line").cast("long")).withColumn("source_line", F.col("source_line").cast("long"))


QUERIES |= built.QUERIES
ORACLE_SQL = {**OWN_SQL, **built.ORACLE_SQL}
