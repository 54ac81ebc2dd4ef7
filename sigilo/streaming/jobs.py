"""Jobs as a stream with state: what is new of each job, heartbeats while it is silent, its end, and when it is forgotten; an audit stream into two tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TOLD = "job_id long, evento string, seq long, etapa string, porcentagem double"
#: The state store that timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class JobEvents(StatefulProcessor):
    """The state of a job is its update of the largest seq, so late and repeated updates change nothing. A timer runs from the last thing
    told: when it goes off, a job that still works gets a heartbeat, and one that has ended for so long is forgotten."""

    def __init__(self, silence_ms: int, keep_ms: int):
        self.silence_ms, self.keep_ms = silence_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "seq long, etapa string, porcentagem double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).dropna(subset=["seq"]).sort_values("seq", kind="stable").drop_duplicates("seq")
        seq, _, before = self.state.get() if self.state.exists() else (None, None, 0.0)
        new = given[given["seq"] > seq] if seq is not None else given
        out, ended = [], before >= 100
        for r in new.itertuples():
            if ended:
                break  # what comes after the end is not told
            ended = r.porcentagem >= 100
            out.append((key[0], "fim" if ended else "atualizado", int(r.seq), r.etapa, r.porcentagem))  # a null beside it makes the column one of fractions
        if out:
            self.state.update(tuple(out[-1][2:]))
            self._again(timerValues, self.keep_ms if ended else self.silence_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TOLD.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            seq, etapa, done = self.state.get()
            out.append((key[0], "esquecido" if done >= 100 else "sinal", seq, etapa, done))
            if done >= 100:
                self.state.clear()
            else:
                self._again(timerValues, self.silence_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TOLD.split(", ")])

    def _again(self, timerValues, wait_ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + wait_ms)


def events(updates: DataFrame, silence_ms: int = 30_000, keep_ms: int = 3_600_000) -> DataFrame:
    """(job_id, evento, seq, etapa, porcentagem) of a stream of updates (job_id, seq, etapa, porcentagem): each new one, the end, heartbeats, and
    the job's being forgotten. State is a row for each job that is not forgotten yet. Null jobs and numbers are not told."""
    rows = updates.where("job_id is not null").select("job_id", "seq", "etapa", "porcentagem")
    return rows.groupBy("job_id").transformWithStateInPandas(JobEvents(silence_ms, keep_ms), TOLD, "Append", "ProcessingTime")


def follow(updates: DataFrame, target: str, checkpoint: str, silence_ms: int = 30_000, keep_ms: int = 3_600_000, **trigger) -> StreamingQuery:
    """Writes the events of jobs to a table as they come; goes on from the checkpoint after a restart. A timer makes a batch of its own, so a query that is to end
    when its files are read needs spark.sql.streaming.noDataMicroBatches.enabled off: its timers go off in the next batch that has rows."""
    updates.sparkSession.conf.set(*STORE)
    out = events(updates, silence_ms, keep_ms).writeStream.outputMode("append").format("parquet").option("path", target)
    return out.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_calls(calls: DataFrame, most: int = 10, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(ip, inicio, n) of the windows with more calls (ip, ts) than allowed, each told once, when the watermark has passed it; later calls are dropped."""
    n = calls.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "ip").agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") > most).select("ip", F.col("w.start").alias("inicio"), "n")


def audit_tables(entries: DataFrame, log: str, index: str, checkpoint: str, late: str = "1 hour", **trigger) -> StreamingQuery:
    """A stream of audit entries (job_id, ts, ...) into a log of all of them, repeats within `late` told once, and an index of each job's last one.

    Each batch has a folder of its number in both tables and replaces what is in it: a batch that is run again after a failure between the
    two leaves both as if it had run once. `last_writes` reads the index over all batches.
    """

    def both(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/lote={number}")
        last = F.max_by(F.struct(*batch.columns), F.struct("ts", F.xxhash64(*batch.columns))).alias("e")
        batch.groupBy("job_id").agg(last).select("e.*").write.mode("overwrite").parquet(f"{index}/lote={number}")

    once = entries.withWatermark("ts", late).dropDuplicatesWithinWatermark(entries.columns)
    return once.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def last_writes(spark: SparkSession, index: str) -> DataFrame:
    """Each job's last entry over all batches."""
    rows = spark.read.parquet(index)
    own = [c for c in rows.columns if c != "lote"]
    last = F.max_by(F.struct(*own), F.struct("ts", "lote", F.xxhash64(*own))).alias("e")
    return rows.groupBy("job_id").agg(last).select("e.*")
