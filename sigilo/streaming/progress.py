"""Job progress as a stream: latest state of a job, percentages, rate limits."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# The stages of a job and their weights in per cent.
STAGES = {"upload": 5, "extraction": 40, "detection": 40, "redaction": 10, "finalization": 5}


def percent(stage: Column, page: Column, pages: Column) -> Column:
    """Weights of the stages before, and the page's part of this one's; no page counts as the whole stage, 100 is the most."""
    before = dict(zip(STAGES, [0, *accumulate(STAGES.values())]))
    weight, ahead = F.lit(0.0), F.lit(0.0)
    for name, w in STAGES.items():
        weight, ahead = F.when(stage == name, float(w)).otherwise(weight), F.when(stage == name, float(before[name])).otherwise(ahead)
    part = F.when((pages > 0) & (page > 0), page / pages * weight).otherwise(weight)
    return F.least(ahead + part, F.lit(100.0))


def latest(updates: DataFrame) -> DataFrame:
    """The state of each job with the largest seq. Works on batches and streams alike."""
    state = F.max_by(F.struct("etapa", "porcentagem", "seq"), "seq").alias("s")
    return updates.groupBy("job_id").agg(state).select("job_id", "s.*")


def status(jobs: DataFrame, states: DataFrame) -> DataFrame:
    """The polled state of each asked job, not_found without one."""
    return jobs.join(states, "job_id", "left").select("job_id", F.coalesce("etapa", F.lit("not_found")).alias("etapa"), F.coalesce("porcentagem", F.lit(0.0)).alias("porcentagem"), (F.coalesce("porcentagem", F.lit(0.0)) >= 100).alias("done"))


def listened(updates: DataFrame, listeners: DataFrame, most: int = 100) -> DataFrame:
    """(job_id, listener, seq, ...): what each listener of a job has waiting: the updates since it came (`since`, a seq), the
    first `most` of them; what comes when the queue is full is dropped."""
    waiting = updates.join(listeners, "job_id").where(F.col("seq") > F.col("since"))
    w = Window.partitionBy("job_id", "listener").orderBy("seq")
    return waiting.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k", "since")


def event_lines(updates: DataFrame, wait: int = 30) -> DataFrame:
    """(job_id, seq, k, linha): the lines of each job's event stream. updates: job_id, seq, ts, etapa, porcentagem.

    A heartbeat for every `wait` seconds without an update, the update, and after the first one of 100 per cent a last line
    that says so; what comes later is not told.
    """
    w = Window.partitionBy("job_id").orderBy("seq")
    ended = F.max((F.col("porcentagem") >= 100).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = updates.withColumn("_ended", ended).where("coalesce(_ended, 0) = 0")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    beats = F.array_repeat(F.lit(": heartbeat"), F.coalesce(F.floor(gap / wait), F.lit(0)).cast("int"))
    said = F.concat(F.lit("data: "), F.to_json(F.struct("job_id", "etapa", "porcentagem")))
    last = F.when(F.col("porcentagem") >= 100, F.array(F.lit('data: {"done": true}'))).otherwise(F.array().cast("array<string>"))
    lines = rows.withColumn("_l", F.concat(beats, F.array(said), last))
    return lines.select("job_id", "seq", F.posexplode("_l").alias("k", "linha"))


def unfinished(states: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    """States that are kept: jobs that haven't ended, and ended ones for so long after their last update."""
    return states.where((F.col("porcentagem") < 100) | (F.unix_timestamp("ts") >= F.unix_timestamp(now) - seconds))


def watched(updates: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Latest states of a stream of updates (job_id, seq, ts, etapa, porcentagem) by hours; the state of an hour is dropped
    when the watermark has passed it."""
    state = F.max_by(F.struct("etapa", "porcentagem", "seq"), "seq").alias("s")
    return updates.withWatermark("ts", delay).groupBy("job_id", F.window("ts", "1 hour").alias("w")).agg(state).select("job_id", F.col("w.start").alias("hora"), "s.*")


def over_limit(calls: DataFrame, most: int = 10, window: str = "1 minute") -> DataFrame:
    """Addresses with more calls than allowed in a tumbling window."""
    n = calls.groupBy(F.window("ts", window).alias("w"), "ip").agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") > most).select("ip", F.col("w.start").alias("inicio"), "n")


def expired(files: DataFrame, now: Column, seconds: int = 86_400) -> DataFrame:
    """Files (path, modified) that are older than their time to live."""
    return files.where(F.unix_timestamp("modified") < F.unix_timestamp(now) - seconds)


def watch(spark: SparkSession, path: str, schema: str, name: str, checkpoint: str) -> StreamingQuery:
    """Latest states of the update files in a folder, kept in a table of the name; files that come later update it."""
    updates = spark.readStream.schema(schema).parquet(path)
    return latest(updates).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """JSON lines of audit entries as they arrive, appended exactly once; unreadable lines fall away."""
    rows = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(source)
    return rows.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
