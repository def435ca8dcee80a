"""Bounded samples of labelled rows, with statistics or words of their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.llm.arrowio import id_text

#: Labelled rows that a classifier is fitted on at most; the smallest hashes of doc_id are taken, whatever the order of rows.
MAX_ROWS = 8000


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal doc_id, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int | None, held: int | None, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, text, label of a bounded sample of labelled rows outside the held-out fold. The broadcast side has max_rows rows at most."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    if folds:
        rows = rows.filter(remainder(F.col("doc_id"), folds) != held)
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return id_text(docs).join(F.broadcast(rows), "doc_id")
