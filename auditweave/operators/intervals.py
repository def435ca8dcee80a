"""Gaps and islands, interval merging, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """Runs of positions no further than gap apart: keys, start_line, end_line, n."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    numbered = rows.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w))
    return numbered.groupBy(*keys, "_island").agg(F.min(at).cast("long").alias("start_line"), F.max(at).cast("long").alias("end_line"), F.count("*").alias("n")).drop("_island")


def merged_windows(rows: DataFrame, keys: list[str], at: str, around: int, least: int = 1) -> DataFrame:
    """Windows of around lines on both sides, merged where they touch: keys, start_line, end_line."""
    spans = rows.select(*keys, F.greatest(F.col(at) - around, F.lit(least)).cast("long").alias("s"), (F.col(at) + around).cast("long").alias("e"))
    w = Window.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("_new", F.coalesce((F.col("s") > before + 1).cast("int"), F.lit(0))).withColumn("_island", F.sum("_new").over(w))
    return numbered.groupBy(*keys, "_island").agg(F.min("s").alias("start_line"), F.max("e").alias("end_line")).drop("_island")


def within_budget(rows: DataFrame, keys: list[str], order: list[Column | str], length: Column, budget: int) -> DataFrame:
    """The rows of each key that fit the budget in order, each costing its length and one separator."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(length + 1).over(w).cast("long")).filter(F.col("used") <= budget)


def marker_regions(markers: DataFrame, line_counts: DataFrame) -> DataFrame:
    """markers: file, line, id; line_counts: file, n_lines. Each region runs to the line before the next marker, the last to the end."""
    w = Window.partitionBy("file").orderBy("line")
    return markers.join(line_counts, "file").select("file", "id", F.col("line").alias("start_line"), F.coalesce(F.lead("line").over(w) - 1, "n_lines").alias("end_line"))
