"""The high-water mark of advisory status as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.functions.levels import EXPLOITATION_RANK

STATUS_OF_EVENT = {"purchase": "exploited", "signup": "elevated", "click": "listed"}


def high_water(status_events: DataFrame, key: str = "cve", status: str = "exploitation") -> DataFrame:
    """Keyed maximum of the status rank: late or lower statuses never lower it. Works on streams (update or complete mode) and tables alike."""
    rank = F.lit(0)
    for name, r in EXPLOITATION_RANK.items():
        rank = F.when(F.col(status) == name, r).otherwise(rank)
    return status_events.groupBy(key).agg(F.max(rank).alias("rank"), F.count("*").alias("n"))


def shared_folder(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def status_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table of events as a stream of advisory, status and time. Read as a pattern, so that a table of one file can be streamed too."""
    status = F.lit("unknown")
    for k, v in STATUS_OF_EVENT.items():
        status = F.when(F.col("event_type") == k, v).otherwise(status)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    return stream.select(F.col("user_id").cast("string").alias("cve"), status.alias("exploitation"), F.col("ts").alias("at"))


def high_water_of_table(spark: SparkSession, path: str) -> DataFrame:
    """Reads a table as a stream until its end (availableNow) and returns the final state, from a Parquet table in the shared folder."""
    run = shared_folder(spark, "high_water")
    marks = high_water(status_stream(spark, path))

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/state")

    writer = marks.writeStream.outputMode("complete").option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    writer.awaitTermination()
    return spark.read.parquet(f"{run}/state").select("cve", F.col("rank").cast("long").alias("rank"), "n")
