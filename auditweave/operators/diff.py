"""Snapshot differences and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditweave.functions.levels import severity_rank
from auditweave.functions.text import squeezed


def fingerprinted(findings: DataFrame, order: list[str], within: list[str] | None = None) -> DataFrame:
    """Adds norm_evidence and ordinal: which of equal (detector_id, file, evidence) rows it is in scan order, from 0; within: columns that part the rows first."""
    rows = findings.withColumn("norm_evidence", squeezed(F.col("evidence")))
    w = Window.partitionBy("detector_id", "file", "norm_evidence", *(within or [])).orderBy(*order)
    return rows.withColumn("ordinal", (F.row_number().over(w) - 1).cast("long"))


def sarif_fingerprint(findings: DataFrame, order: list[str]) -> DataFrame:
    """Adds fingerprint: 32 hex digits over id, file, cwe, evidence and the ordinal by line."""
    rows = findings.withColumn("_e", squeezed(F.col("evidence")))
    w = Window.partitionBy("detector_id", "file", "cwe", "_e").orderBy("line", *order)
    text = F.concat_ws("\n", "detector_id", "file", "cwe", "_e", F.concat(F.lit("#"), (F.row_number().over(w) - 1).cast("string")))
    return rows.withColumn("fingerprint", F.substring(F.sha2(text, 256), 1, 32)).drop("_e")


KEY = ("detector_id", "file", "norm_evidence", "ordinal")


KEPT = ("detector_id", "file", "line", "severity", "evidence")


def snapshot_diff(baseline: DataFrame, current: DataFrame, order: list[str]) -> DataFrame:
    """change (introduced, resolved, unchanged, moved, not_compared), the finding, and baseline_line.

    A moved row is also unchanged. Findings of dependencies (package set) are carried as not_compared from the current side."""
    sides = [df.withColumn("package", F.col("package") if "package" in df.columns else F.lit("")).withColumn("side", F.lit(k)) for k, df in enumerate((baseline, current))]
    columns = list(dict.fromkeys([*KEPT, *order, "package", "side"]))
    return tagged_diff(sides[0].select(*columns).unionByName(sides[1].select(*columns)), order)


def tagged_diff(rows: DataFrame, order: list[str]) -> DataFrame:
    """snapshot_diff of rows with a column side (0 baseline, 1 current): one shuffle by the fingerprint's columns serves ordinals and comparison."""
    rows = fingerprinted(rows.withColumn("package", F.coalesce("package", F.lit(""))), order, ["side", "package"])
    of = lambda k: F.max(F.when(F.col("side") == k, F.struct(*KEPT)))
    both = rows.groupBy(*KEY, "package").agg(of(0).alias("old"), of(1).alias("new")).filter("package = '' or new is not null")
    named = lambda *x: F.array(*map(F.lit, x))
    change = F.when(F.col("package") != "", named("not_compared")).when(F.col("old").isNull(), named("introduced")).when(F.col("new").isNull(), named("resolved")).when(F.col("old.line") != F.col("new.line"), named("unchanged", "moved")).otherwise(named("unchanged"))
    out = both.select(F.explode(change).alias("change"), F.coalesce("new", "old").alias("row"), F.when(F.col("package") == "", F.col("old.line").cast("long")).alias("baseline_line"))
    return out.select("change", "row.*", "baseline_line")


def ranked_diff(diff: DataFrame) -> DataFrame:
    return diff.orderBy("change", severity_rank(F.col("severity")).desc(), "file", "line")
