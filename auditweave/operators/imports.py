"""Module resolution and fixed points over import graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        conf = df.sparkSession.conf
        sc.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


def resolved_imports(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted: importer, candidates (array of paths in order of preference); files: file. The first candidate that exists."""
    tried = wanted.select("importer", F.posexplode("candidates").alias("ord", "file"))
    return tried.join(files.select("file").distinct(), "file").groupBy("importer").agg(F.min_by("file", "ord").alias("resolved"))


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """edges: src, dst; starts: node. (start, node) pairs by semi-naive rounds: only pairs that are new go on, so cycles end."""
    known = delta = checkpointed(starts.select(F.col("node").alias("start"), "node").distinct())
    step = edges.select(F.col("src").alias("node"), "dst").distinct()
    while True:
        delta = checkpointed(delta.join(step, "node").select("start", F.col("dst").alias("node")).distinct().join(known, ["start", "node"], "left_anti"))
        if delta.limit(1).count() == 0:
            return known
        known = checkpointed(known.union(delta))
