"""State of the exploitation watch on shared storage, and the alert that a run gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the schema of a stored state.
SCHEMA = 1
WATCHED = "cve string, package string, vex_status string, severity string, exploitation string, first_seen string, exploited_since string"
DOCUMENT = f"schema int, target string, recorded string, watched array<struct<{', '.join(x.replace(' ', ':', 1) for x in WATCHED.split(', ')).replace(', ', ',')}>>"


#: The file that names the folder of the state that holds.
POINTER = "CURRENT"


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _point(spark: SparkSession, path: str, name: str) -> None:
    """Lets the pointer name a folder: written beside it, then renamed over it in one step."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs, fresh = _files(spark, f"{path}/{POINTER}.{name}")
    out = fs.create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(fresh), fs.makeQualified(hadoop.Path(f"{path}/{POINTER}")), over)


def _current(spark: SparkSession, path: str) -> str | None:
    fs, pointer = _files(spark, f"{path}/{POINTER}")
    if not fs.exists(pointer):
        return None
    name = spark.read.text(f"{path}/{POINTER}", wholetext=True).first()
    if name is None or not name.value.strip():
        raise ValueError(f"{path}: no readable state")
    return name.value.strip()


def write_state(watched: DataFrame, path: str, target: str, recorded: str) -> None:
    """One JSON document in a folder of its own; then the pointer is set to it. A write that is lost before that leaves the state before as it was.

    The folder before the last stays, for those who read it just now; older ones go."""
    spark, name = watched.sparkSession, f"state-{uuid.uuid4().hex}"
    before = _current(spark, path)
    rows = watched.select(*(c.split()[0] for c in WATCHED.split(", ")))
    document = rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("watched"))
    document.select(F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), F.lit(target).alias("target"), F.lit(recorded).alias("recorded"), "watched")).alias("value")).coalesce(1).write.text(f"{path}/{name}")
    _point(spark, path, name)
    fs, root = _files(spark, path)
    for found in fs.listStatus(root):
        if found.getPath().getName().startswith(("state-", f"{POINTER}.")) and found.getPath().getName() not in (name, before):
            fs.delete(found.getPath(), True)


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored rows; None where there is no state yet. A state that cannot be read, or of another schema, is an error: an empty one would forget what was alerted."""
    fs, root = _files(spark, path)
    if not fs.exists(root):
        return None
    name = _current(spark, path)
    if name is None:
        if all(x.isDirectory() for x in fs.listStatus(root)):  # the first write was lost
            return None
        raise ValueError(f"{path}: no readable state")
    text = spark.read.text(f"{path}/{name}", wholetext=True)
    row = text.select(F.from_json(F.trim("value"), DOCUMENT, {"mode": "PERMISSIVE"}).alias("d")).first()
    if row is None or row.d is None or row.d.schema is None:
        raise ValueError(f"{path}: no readable state")
    if row.d.schema != SCHEMA:
        raise ValueError(f"{path} has schema {row.d.schema}, this version reads {SCHEMA}")
    return text.select(F.explode(F.from_json(F.trim("value"), DOCUMENT)["watched"]).alias("w")).select("w.*")


def alerting(compared: DataFrame, blocked: bool = False) -> bool:
    """Whether a run has to wake somebody: it was blocked, or something was triggered."""
    return blocked or bool(compared.filter("outcome = 'triggered'").limit(1).count())
