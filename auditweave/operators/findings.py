"""Resolution of findings: union of tiers, corroboration, dedupe, order, counts."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.functions.levels import SEVERITIES, severity_rank, source_rank

#: Fixed value: lines between a pattern row and the taint row that corroborates it.
CORROBORATION = 3


def union_of_tiers(tiers: Sequence[DataFrame]) -> DataFrame:
    """Bag union in order; tier says which came first."""
    out = None
    for k, t in enumerate(tiers):
        t = t.withColumn("tier", F.lit(k))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def first_wins(findings: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The first row of each (detector_id, file, line)."""
    w = Window.partitionBy("detector_id", "file", "line").orderBy(*order)
    return findings.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_source(findings: DataFrame) -> DataFrame:
    """All rows of the most trusted source of each (file, line, cwe)."""
    w = Window.partitionBy("file", "line", "cwe")
    rank = source_rank(F.col("source"))
    return findings.withColumn("_top", F.max(rank).over(w)).filter(rank == F.col("_top")).drop("_top")


def without_superseded(findings: DataFrame, superseded_by: dict[str, Sequence[str]]) -> DataFrame:
    """Drops a coarse rule's row where a rule that replaces it has a row on the same line. Ids on a line are few: one set each."""
    w = Window.partitionBy("file", "line")
    coarse = F.lit(False)
    for rule, precise in superseded_by.items():
        coarse = coarse | ((F.col("detector_id") == rule) & F.arrays_overlap("_ids", F.array(*map(F.lit, precise))))
    return findings.withColumn("_ids", F.collect_set("detector_id").over(w)).filter(~coarse).drop("_ids")


def deduplicated(findings: DataFrame, superseded_by: dict[str, Sequence[str]], order: Sequence[str | Column]) -> DataFrame:
    return without_superseded(top_source(first_wins(findings, order)), superseded_by)


def corroborated(findings: DataFrame, order: Sequence[str], window: int = CORROBORATION) -> DataFrame:
    """Pairs each non-taint row with at most one taint row of the same file and cwe, nearest lines first, then by order.

    The pattern row takes the taint path, and high confidence if the path has it; absorbed taint rows go. Needs taint_path
    and confidence. Rows on one line come before all other pairs, so there the first pattern row takes the first taint row, the
    second the second, by one window for each line. What is left is cut into islands of lines, no nearer to each other than the
    window; only islands with both kinds of rows have pairs left, and only their rows are walked, pair by pair. So a file and
    cwe of any size is split by its lines; an island's rows left over are one list of a task. Many small islands share a slot,
    so Python is called once for a slot; slots follow spark.sql.shuffle.partitions."""
    key, columns = ["file", "cwe"], findings.columns
    taint = F.coalesce(F.col("source") == "taint", F.lit(False))
    rank = Window.partitionBy(*key, "line", "_taint").orderBy(*order)
    couple = Window.partitionBy(*key, "line", "_nth")
    rows = findings.withColumn("_taint", taint).withColumn("_nth", F.row_number().over(rank))
    rows = rows.withColumn("_both", (F.min("_taint").over(couple) != F.max("_taint").over(couple)) & F.col("line").isNotNull())
    taken = lambda c: F.max(F.when(F.col("_taint"), F.col(c))).over(couple)
    absorbed = F.col("_both") & ~F.col("_taint")
    path, sure = F.when(absorbed, taken("taint_path")).otherwise(F.col("taint_path")), F.when(absorbed & (taken("confidence") == "high"), "high").otherwise(F.col("confidence"))
    rows = rows.withColumns({"_path": path, "_sure": sure}).filter(~(F.col("_both") & F.col("_taint"))).withColumns({"taint_path": F.col("_path"), "confidence": F.col("_sure")})
    lines = rows.filter(~F.col("_both")).groupBy(*key, "line").agg(F.max("_taint").alias("_t"), F.max(~F.col("_taint")).alias("_p"))
    far = F.coalesce(F.col("line") - F.lag("line").over(Window.partitionBy(*key).orderBy("line")) > window, F.lit(True))
    lines = lines.withColumn("_far", far).withColumn("_island", F.sum(F.col("_far").cast("long")).over(Window.partitionBy(*key).orderBy("line")))
    whole = Window.partitionBy(*key, "_island")
    lines = lines.withColumn("_open", F.max("_t").over(whole) & F.max("_p").over(whole)).filter("_open").select(*(F.col(c).alias(f"_{c}") for c in (*key, "line")), "_island")
    same = F.col("file").eqNullSafe(F.col("_file")) & F.col("cwe").eqNullSafe(F.col("_cwe")) & (F.col("line") == F.col("_line")) & ~F.col("_both")
    rows = rows.join(lines, same, "left").select(*columns, "_island")
    left = rows.filter("_island is not null")
    return rows.filter("_island is null").select(*columns).unionByName(_walked(left, columns, order, window))


def _walked(findings: DataFrame, columns: Sequence[str], order: Sequence[str], window: int) -> DataFrame:
    """The pairs of islands, the nearest that is left taken each time."""
    findings = findings.select(*columns, "_island")
    names, schema = columns, findings.select(*columns).schema
    slots = 4 * int(findings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = {n: names.index(n) for n in (*order, "file", "cwe", "source", "line", "confidence", "taint_path")}

    def pair(rows: list[list]) -> list[list]:
        rows.sort(key=lambda r: tuple(r[at[o]] for o in order))
        taint = [r[at["source"]] == "taint" for r in rows]
        lines = sorted((q[at["line"]], j) for j, q in enumerate(rows) if taint[j])

        def within(line: int) -> list[tuple[int, int]]:
            """Taint rows no further away than the window: only these are ever candidates."""
            return [(abs(line - other), j) for other, j in lines[bisect_left(lines, (line - window, -1)) : bisect_left(lines, (line + window + 1, -1))]]

        near = sorted((d, i, j) for i, p in enumerate(rows) if not taint[i] for d, j in within(p[at["line"]]))
        used: set[int] = set()
        for _, i, j in near:
            if i not in used and j not in used:
                used |= {i, j}
                rows[i][at["taint_path"]] = rows[j][at["taint_path"]]
                if rows[j][at["confidence"]] == "high":
                    rows[i][at["confidence"]] = "high"
        return [r for i, r in enumerate(rows) if not (taint[i] and i in used)]

    def slot(table: pa.Table) -> pa.Table:
        groups: dict[tuple, list[list]] = defaultdict(list)
        for r in zip(*(table.column(n).to_pylist() for n in (*names, "_island")), strict=True):
            groups[r[at["file"]], r[at["cwe"]], r[-1]].append(list(r[:-1]))
        out = [r for g in groups.values() for r in (pair(g) if len(g) > 1 else g)]
        return pa.table([pa.array([r[k] for r in out], table.schema.field(n).type) for k, n in enumerate(names)], names)

    return findings.withColumn("_slot", F.pmod(F.xxhash64("file", "cwe", "_island"), F.lit(slots))).groupBy("_slot").applyInArrow(slot, schema)


def by_severity(findings: DataFrame, then: Sequence[str | Column] = ("file", "line")) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")).desc(), *then)


def severity_counts(findings: DataFrame) -> DataFrame:
    """severity, n for all five levels, 0 where none."""
    spark = findings.sparkSession
    levels = spark.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return levels.join(findings.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def passes_gate(findings: DataFrame, minimum: str) -> DataFrame:
    """One row: whether any finding has the minimum severity, and the worst rank (0 if none)."""
    worst = F.coalesce(F.max(severity_rank(F.col("severity"))), F.lit(0))
    return findings.agg(worst.cast("long").alias("worst_rank")).withColumn("gate", F.col("worst_rank") >= 5 - SEVERITIES.index(minimum))
