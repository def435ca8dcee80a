"""Dependency reachability (VEX), exploitation status, and the watch over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.functions.levels import EXPLOITATION_RANK, by_verdict, ranked

#: The score from which a listed advisory counts as elevated, and the import patterns of an indexable source.
EPSS_NOTABLE = 0.10
IMPORT = r"""(?:\brequire\s*\(\s*|\bfrom\s+|\bimport\s*\(?\s*)['"]([^'"]+)['"]"""
DEV_PATH = r"(?:^|/)(?:tests?|__tests__|spec|specs|e2e|examples?|scripts?|benchmarks?|docs?)/|\.(?:test|spec)\.[jt]sx?$|(?:^|/)test_[^/]+\.py$|(?:^|/)conftest\.py$"


def import_index(files: DataFrame, specifier_to_package) -> DataFrame:
    """(package, file) of every import in files (file, text)."""
    found = files.select("file", F.explode(F.regexp_extract_all("text", F.lit(IMPORT), F.lit(1))).alias("spec"))
    return found.select(specifier_to_package(F.col("spec")).alias("package"), "file").filter("package is not null").distinct()


def importers(index: DataFrame, is_dev: Column) -> DataFrame:
    """package, runtime_importers, dev_importers (counts); the counts are combined before the shuffle."""
    return index.groupBy("package").agg(F.count_if(~is_dev).alias("runtime_importers"), F.count_if(is_dev).alias("dev_importers"))


def vex_verdicts(advisories: DataFrame, index: DataFrame, declared: DataFrame) -> DataFrame:
    """advisories: package, indexable, severity; index: importers(); declared: package, in_runtime, in_dev.

    Adds vex_status, vex_justification, and severity two rungs down where not affected. First rule that holds wins."""
    rows = advisories.join(index, "package", "left").join(declared, "package", "left")
    run, dev = F.coalesce("runtime_importers", F.lit(0)) > 0, F.coalesce("dev_importers", F.lit(0)) > 0
    in_dev, in_run = F.coalesce("in_dev", F.lit(False)), F.coalesce("in_runtime", F.lit(False))
    is_ = lambda status, why="": F.struct(F.lit(status).alias("s"), F.lit(why).alias("j"))
    open_, absent = is_("under_investigation"), is_("not_affected", "component_not_present")
    verdict = F.when(~F.col("indexable"), open_).when(run, is_("affected")).when(dev & in_dev, absent).when(dev, open_).when(in_dev, absent).when(in_run, is_("not_affected", "vulnerable_code_not_present")).otherwise(open_)
    rows = rows.withColumn("_v", verdict).withColumn("vex_status", F.col("_v.s")).withColumn("vex_justification", F.col("_v.j"))
    return rows.withColumn("severity", by_verdict(F.col("severity"), F.col("vex_status"))).drop("_v", "runtime_importers", "dev_importers", "in_dev", "in_runtime")


def exploitation(findings: DataFrame, kev: DataFrame, epss: DataFrame, kev_empty: bool = False, epss_empty: bool = False) -> DataFrame:
    """findings: cve, severity; kev: cve; epss: cve, score. Adds exploitation; exploited rows become Critical, none is lowered."""
    rows = findings.join(kev.select("cve", F.lit(True).alias("_kev")).distinct(), "cve", "left").join(epss.groupBy("cve").agg(F.max("score").alias("_score")), "cve", "left")
    status = F.when(F.lit(kev_empty and epss_empty), "unknown").when(F.col("_kev"), "exploited").when(F.col("_score").isNull(), "unknown" if epss_empty else "listed").when(F.col("_score") >= EPSS_NOTABLE, "elevated").otherwise("listed")
    return rows.withColumn("exploitation", status).withColumn("severity", F.when(F.col("exploitation") == "exploited", "Critical").otherwise(F.col("severity"))).drop("_kev", "_score")


# --- watch


def watch_start(findings: DataFrame, order: list[str], today: str) -> DataFrame:
    """The first row of each cve: cve, package, vex_status, severity, exploitation, first_seen, exploited_since."""
    w = Window.partitionBy("cve").orderBy(*order)
    first = findings.filter("cve <> ''").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    since = F.when(F.col("exploitation") == "exploited", today).otherwise("")
    return first.select("cve", "package", "vex_status", "severity", "exploitation", F.lit(today).alias("first_seen"), since.alias("exploited_since"))


def watch_compare(state: DataFrame, current: DataFrame, blocked: bool = False) -> DataFrame:
    """state: cve, exploitation; current: cve, exploitation. outcome: triggered, escalated, still_exploited, unchanged. Blocked: no rows."""
    now = current.select("cve", F.col("exploitation").alias("current"))
    rows = state.select("cve", F.col("exploitation").alias("previous")).join(now, "cve", "left").withColumn("current", F.coalesce("current", F.lit("unknown")))
    risen = ranked(F.col("current"), EXPLOITATION_RANK) > ranked(F.col("previous"), EXPLOITATION_RANK)
    outcome = F.when(~risen, F.when(F.col("previous") == "exploited", "still_exploited").otherwise("unchanged")).when(F.col("current") == "exploited", "triggered").otherwise("escalated")
    rows = rows.withColumn("outcome", outcome).withColumn("is_trigger", F.col("outcome") == "triggered")
    return rows.limit(0) if blocked else rows


def watch_advance(state: DataFrame, compared: DataFrame, today: str) -> DataFrame:
    """High-water mark: only risen rows change; exploited_since is set by triggers alone."""
    moved = compared.filter("outcome in ('triggered', 'escalated')").select("cve", F.col("current").alias("_to"), F.col("is_trigger").alias("_t"))
    rows = state.join(moved, "cve", "left")
    since = F.when(F.coalesce("_t", F.lit(False)), today).otherwise(F.col("exploited_since"))
    return rows.withColumn("exploited_since", since).withColumn("exploitation", F.coalesce("_to", "exploitation")).drop("_to", "_t")
