"""Alerts of the exploitation watch as keyed state: one for every batch in which an advisory's status rises above all it has had.

The state of an advisory is its high-water rank and the number of its events; a batch folds its events into it chunk by
chunk, so an advisory with very many events needs no more memory than one with few, and only keys of the batch are touched
(update mode). Every batch writes its alerts to a folder of its own number: a batch that is run again after a lost driver
starts from the state before it and replaces the folder, so no alert is lost or told twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditweave.functions.levels import EXPLOITATION_RANK, ranked

ALERT = "cve string, was long, now long, since timestamp, n long"
STATE = "rank long, n long"


def _rise(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    was, n = state.get if state.exists else (0, 0)
    now, since = was, None
    for chunk in chunks:
        n += len(chunk)
        top = int(chunk["rank"].max())
        if top >= now and top > was:
            first = chunk.loc[chunk["rank"] == top, "at"].min()
            since = first if top > now or since is None or (not pd.isna(first) and first < since) else since
            now = top
    state.update((now, n))
    if now > was:
        yield pd.DataFrame({"cve": [key[0]], "was": [was], "now": [now], "since": [since], "n": [n]})


def alerts(status_events: DataFrame, key: str = "cve", status: str = "exploitation", at: str = "at") -> DataFrame:
    """status_events: a stream of advisory, status and time. A row for each advisory whose status rises: from which rank, to which, since when, and its events so far.

    Unknown and null statuses have rank 0 and never alert; a null advisory is a key of its own; late events count as any others."""
    rows = status_events.select(F.col(key).cast("string").alias("cve"), ranked(F.col(status), EXPLOITATION_RANK).cast("long").alias("rank"), F.col(at).alias("at"))
    return rows.groupBy("cve").applyInPandasWithState(_rise, ALERT, STATE, "update", GroupStateTimeout.NoTimeout)


def watched(status_events: DataFrame, folder: str, **names: str) -> StreamingQuery:
    """Runs the watch over all that the stream has now; state and alerts stay under folder, for the next run and for ``told``."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/alerts/batch={number}")

    return alerts(status_events, **names).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()


def told(spark, folder: str) -> DataFrame:
    """All alerts so far."""
    return spark.read.schema(f"{ALERT}, batch long").option("recursiveFileLookup", "false").parquet(f"{folder}/alerts")
