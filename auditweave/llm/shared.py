"""The shared folder for checkpoints, and names of working columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Spark takes spark.checkpoint.dir itself; only where it is unset (tests, one machine) a folder beside the warehouse is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut by a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of frames made by ``cut`` that nothing will read again (what needed them has been cut itself)."""
    for df in frames:
        rdd = getattr(df._jdf.queryExecution().logical(), "rdd", None)
        kept = rdd().getCheckpointFile() if rdd else None
        if kept and kept.isDefined():
            delete(df.sparkSession, kept.get())


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out
