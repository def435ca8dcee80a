"""Brace depth of lines and spans of blocks in script files, over the code view (braces in strings and comments don't count).

Depths are running sums, block ends the next brace of the same level: windows over a file's lines or braces, which spill
where a file is long. A null text has no lines; a closing brace too many lowers the depth below zero and ends no block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.functions.text import matches


def _view(files: DataFrame) -> Column:
    return F.coalesce("code_view", "text") if "code_view" in files.columns else F.col("text")


def line_depths(files: DataFrame) -> DataFrame:
    """files: file, text, and optionally code_view. (file, line, depth): the depth behind each line."""
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    lines = files.select("file", F.posexplode(F.split(_view(files), "\n", -1)).alias("at", "text"))
    lines = lines.select("file", (F.col("at") + 1).alias("line"), (count(F.col("text"), "{") - count(F.col("text"), "}")).alias("net"))
    return lines.select("file", "line", F.sum("net").over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)).alias("depth"))


def block_spans(files: DataFrame) -> DataFrame:
    """(file, start, end, start_line, end_line, depth): every block from its opening brace to the brace that closes it, depth 1 outermost; a block that nothing closes has no end."""
    found = files.select("file", F.explode(matches(_view(files), r"[{}]")).alias("m"))
    step = F.when(F.col("opens"), 1).otherwise(-1)
    rows = found.select("file", "m.start", "m.line", (F.col("m.text") == "{").alias("opens"))
    rows = rows.withColumn("after", F.sum(step).over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("depth", F.col("after") + F.when(F.col("opens"), 0).otherwise(1))  # on one level of a file opening and closing braces alternate
    level = Window.partitionBy("file", "depth").orderBy("start")
    ends = lambda c: F.when(~F.lead("opens").over(level), F.lead(c).over(level))
    rows = rows.withColumns({"end": ends("start"), "end_line": ends("line")})
    return rows.filter("opens").select("file", "start", "end", F.col("line").alias("start_line"), "end_line", "depth")
