"""Label matching and detection quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: lines that a result may be away from a labelled region.
TOLERANCE = 10


def suffixes(path: Column) -> Column:
    """All suffixes of whole path components, the path itself first."""
    parts = F.split(F.regexp_replace(path, r"^(?:\./)+", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


#: Lines of one bin of the range join.
BIN = 64


def label_hits(labels: DataFrame, results: DataFrame, tolerance: int = 0) -> DataFrame:
    """labels: id, file, start_line, end_line, cwes; results: file, line, cwe. id, loose, strict: any result of the file in the region, and one with an accepted weakness.

    A label's file may be a path suffix of the result's. Equality joins on file suffixes and bins of ``BIN`` lines, a region
    standing in every bin that it touches; equal results of a line are one."""
    bin_of = lambda line: F.floor(line / BIN).cast("long")
    there = results.select("file", F.col("line").cast("long").alias("_line"), F.col("cwe").alias("_cwe")).distinct().select(F.explode(suffixes(F.col("file"))).alias("file"), "_line", "_cwe", bin_of(F.col("_line")).alias("_bin"))
    low, high = F.col("start_line") - tolerance, F.col("end_line") + tolerance
    regions = labels.select("id", "file", low.alias("_low"), high.alias("_high"), "cwes", F.explode(F.when(low <= high, F.sequence(bin_of(low), bin_of(high)))).alias("_bin"))
    hit = regions.join(there, ["file", "_bin"]).filter(F.col("_line").between(F.col("_low"), F.col("_high"))).groupBy("id").agg(F.lit(True).alias("_l"), F.bool_or(F.array_contains("cwes", F.col("_cwe"))).alias("_s"))
    return labels.join(hit, "id", "left").withColumn("loose", F.coalesce("_l", F.lit(False))).withColumn("strict", F.coalesce("_s", F.lit(False))).drop("_l", "_s")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / F.nullif(whole, F.lit(0)))


def f_beta(p: Column, r: Column, beta: float) -> Column:
    b = beta * beta
    return F.when(b * p + r == 0, 0.0).otherwise((1 + b) * p * r / F.nullif(b * p + r, F.lit(0.0)))


def confusion(scored: DataFrame, dims: list[str], vulnerable: Column, hit: Column) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, f3, f2 overall and by each dimension in one pass (grouping sets). dimension, value."""
    rows = scored.withColumn("_v", vulnerable).withColumn("_h", hit)
    sets = [[], *[[d] for d in dims]]
    named = rows.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(
        F.count_if(F.col("_v") & F.col("_h")).alias("tp"), F.count_if(~F.col("_v") & F.col("_h")).alias("fp"), F.count_if(F.col("_v") & ~F.col("_h")).alias("fn"), *(F.grouping(d).alias(f"_g_{d}") for d in dims)
    )
    dimension, value = F.lit("all"), F.lit("")
    for d in dims:
        dimension = F.when(F.col(f"_g_{d}") == 0, d).otherwise(dimension)
        value = F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")).otherwise(value)
    out = named.select(dimension.alias("dimension"), value.alias("value"), "tp", "fp", "fn").withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    for beta in (1, 2, 3):
        out = out.withColumn(f"f{beta}", f_beta(F.col("precision"), F.col("recall"), beta))
    return out


def concentration(rows: DataFrame, group: list[str], member: str, least: int, share: float) -> DataFrame:
    """Groups of least rows or more in which one member has share of the rows or more: group, total, top, top_share."""
    by = rows.groupBy(*group, member).agg(F.count("*").alias("n"))
    top = by.groupBy(*group).agg(F.sum("n").alias("total"), F.max(F.struct(F.col("n"), (-F.col(member)).alias("m"))).alias("_t"))
    return top.filter((F.col("total") >= least) & (F.col("_t.n") >= share * F.col("total"))).select(*group, "total", (-F.col("_t.m")).alias("top"), (F.col("_t.n") / F.col("total")).alias("top_share"))


def per_kloc(counts: DataFrame, keys: list[str], n: str, lines: str) -> DataFrame:
    """Findings per 1000 lines by key and over all (rollup)."""
    return counts.rollup(*keys).agg(F.sum(n).alias("findings"), F.sum(lines).alias("lines")).withColumn("per_kloc", ratio(1000.0 * F.col("findings"), F.col("lines")))
