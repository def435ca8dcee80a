"""Alerts over restarts, and a state that survives a lost write."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from auditweave.functions.levels import EXPLOITATION_RANK
from auditweave.sources import state
from auditweave.streaming import alerts

SCHEMA = "cve string, exploitation string, at timestamp"


def test_a_restart_loses_and_repeats_no_alert(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    source, folder = str(tmp_path / "in"), str(tmp_path / "watch")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    high, want = {}, []
    real = alerts.alerts
    for k in range(4):
        rows = [(rng.choice(["a", "b", "c", None, f"d{k}"]), rng.choice([*EXPLOITATION_RANK, None, "odd"]), dt.datetime(2024, 1, 1 + k, rng.randrange(24))) for _ in range(12)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        for cve in {r[0] for r in rows}:
            ranks = [(EXPLOITATION_RANK.get(s or "", 0), at) for c, s, at in rows if c == cve]
            top = max(r for r, _ in ranks)
            if top > high.get(cve, 0):
                want.append((cve, high.get(cve, 0), top, min(at for r, at in ranks if r == top)))
                high[cve] = top
        if k in (1, 2):  # the batch is lost: once before its alerts are written, once after

            def lost(events, after=k == 2, **names):
                class Lost:
                    def __init__(self, df):
                        self.writeStream = self
                        self.df = df

                    def __getattr__(self, name):
                        def call(*args, **kw):
                            return self

                        return call

                    def foreachBatch(self, keep):
                        def broken(batch, number):
                            if after:
                                keep(batch, number)
                            raise RuntimeError("lost")

                        self.keep = broken
                        return self

                    def start(self):
                        return self.df.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(self.keep).start()

                return Lost(real(events, **names))

            monkeypatch.setattr(alerts, "alerts", lost)
            with pytest.raises(Exception, match="lost"):
                alerts.watched(stream(), folder).awaitTermination()
            monkeypatch.setattr(alerts, "alerts", real)
        alerts.watched(stream(), folder).awaitTermination()
    got = [(r.cve, r.was, r.now, r.since) for r in alerts.told(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and want


def test_a_lost_write_keeps_the_state_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    first = spark.createDataFrame([("CVE-1", "p", "affected", "High", "listed", "2024-01-01", "")], state.WATCHED)
    state.write_state(first, path, "tree", "2024-01-02")

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(state, "_point", lost)
        with pytest.raises(RuntimeError):
            state.write_state(first.withColumn("cve", F.lit("CVE-2")), path, "tree", "2024-01-03")
    with pytest.raises(Exception, match="(?i)divide"):
        state.write_state(first.withColumn("cve", F.expr("cast(1 / (length(cve) - 5) as string)")), path, "tree", "2024-01-03")
    assert [r.cve for r in state.read_state(spark, path).collect()] == ["CVE-1"]
    state.write_state(state.read_state(spark, path).withColumn("cve", F.lit("CVE-3")), path, "tree", "2024-01-04")
    assert [r.cve for r in state.read_state(spark, path).collect()] == ["CVE-3"]
