"""Shared plumbing of the Arrow-backed operators.

All of them read ``(id, text)`` projections, so extra columns of the input, whatever their names, never reach Python
and cannot clash with output columns. A null text is the empty text; a null id is carried through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows and bytes of one Arrow batch: bounds a Python worker's memory whatever the length of the texts.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], list]], schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    """One output row for each input row. ``make()`` runs once a task and returns a function from texts to output columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                columns = work(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *names])

    return bounded_batches(docs).mapInArrow(run, f"doc_id long, {schema}")
