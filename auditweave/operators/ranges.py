"""Positions and running sums over an order, without one task for a group's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.operators.imports import checkpointed


def ordered(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """df in ranges of (by, order): ``_part`` and ``_at`` say where a row stands. Cut, since the ranges' borders are sampled."""
    keys = [*map(F.col, by), *(F.col(o) if isinstance(o, str) else o for o in order)]
    ranged = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    return checkpointed(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))


def running_sums(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows of ``ordered`` with the sum of a column over the rows of the group up to this one, for each name.

    A window inside each range gives the sums from its beginning; the ranges' totals (a row for each group and range) give what came before."""
    inside = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "_part").agg(*(F.sum(v).alias(f"_sum_{k}") for k, v in sums.items()))
    totals = totals.select(*by, "_part", *(F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in sums))
    local = rows.withColumns({f"_in_{k}": F.sum(v).over(inside) for k, v in sums.items()})
    same = F.col("x._part") == F.col("y._part")
    for b in by:
        same = same & F.col(f"x.{b}").eqNullSafe(F.col(f"y.{b}"))
    return local.alias("x").join(totals.alias("y"), same).select(*(f"x.{c}" for c in rows.columns), *((F.col(f"_in_{k}") + F.col(f"_before_{k}")).alias(k) for k in sums))
