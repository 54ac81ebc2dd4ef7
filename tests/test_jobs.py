"""Streams with state: late rows, restarts, silence, what is forgotten; windows that close; a replayed batch."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sigilo.streaming import jobs

UPDATES = "job_id long, seq long, etapa string, porcentagem double"


def put(spark, folder, rows, schema=UPDATES):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture
def rows_only(spark):
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def test_events_over_batches_and_a_restart(spark, tmp_path, rows_only):
    source, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        q = jobs.follow(spark.readStream.schema(UPDATES).parquet(str(source)), out, ck, silence_ms=500, keep_ms=500)
        q.awaitTermination(120)
        return [(r.job_id, r.evento, r.seq) for r in spark.read.parquet(out).collect()]

    put(spark, source, [(1, 1, "upload", 5.0), (1, 3, "detection", 60.0), (2, 1, "upload", 5.0), (None, 1, "x", 1.0), (2, None, "x", 1.0)])
    assert {x for x in run() if x[1] == "atualizado"} == {(1, "atualizado", 1), (1, "atualizado", 3), (2, "atualizado", 1)}
    # A restart: the state is there. A late update of job 1 isn't told, its end is, what follows isn't; job 2 has been silent.
    time.sleep(1)
    put(spark, source, [(1, 2, "extraction", 30.0), (1, 4, "finalization", 100.0), (1, 5, "finalization", 100.0)])
    told = run()
    assert told.count((1, "fim", 4)) == 1 and not {(1, "atualizado", 2), (1, "fim", 5), (1, "atualizado", 5)} & set(told)
    assert (2, "sinal", 1) in told
    time.sleep(1)
    put(spark, source, [(3, 1, "upload", 5.0)])
    told = run()
    assert told.count((1, "esquecido", 4)) == 1 and (3, "atualizado", 1) in told


def test_windows_close_by_the_watermark(spark, tmp_path):
    t = datetime(2024, 1, 1)
    source, schema = tmp_path / "in", "ip string, ts timestamp"
    rows = [("a", t + timedelta(seconds=k)) for k in range(12)] + [("b", t)] + [("c", t + timedelta(hours=1))]
    put(spark, source, rows, schema)
    calls = lambda: jobs.windowed_calls(spark.readStream.schema(schema).parquet(str(source)))
    run = lambda: calls().writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    run()
    put(spark, source, [("a", t + timedelta(seconds=30))] * 20 + [("d", t + timedelta(hours=2))], schema)  # late: the window is closed
    run()
    assert [(r.ip, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 12)]


def test_a_replayed_batch_leaves_both_tables_alike(spark, tmp_path):
    t = datetime(2024, 1, 1)
    source, schema = tmp_path / "in", "job_id string, ts timestamp, total int"
    log, index, ck = (str(tmp_path / n) for n in ("log", "index", "ck"))
    put(spark, source, [("1", t, 2), ("1", t, 2), ("1", t + timedelta(minutes=1), 5), ("2", t, 7)], schema)
    entries = lambda: spark.readStream.schema(schema).parquet(str(source))
    jobs.audit_tables(entries(), log, index, ck).awaitTermination(120)
    put(spark, source, [("1", t, 2), ("2", t + timedelta(minutes=3), 9)], schema)
    jobs.audit_tables(entries(), log, index, ck).awaitTermination(120)

    def state():
        rows = sorted((r.job_id, r.total) for r in spark.read.parquet(log).collect())
        return rows, sorted((r.job_id, r.total) for r in jobs.last_writes(spark, index).collect())

    assert state() == ([("1", 2), ("1", 5), ("2", 7), ("2", 9)], [("1", 5), ("2", 9)])
    # The second batch's commit is lost, as if the driver had died behind its writes: it runs again.
    commits = sorted((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last = commits[-1].name
    for name in (last, f".{last}.crc"):
        (tmp_path / "ck" / "commits" / name).rename(tmp_path / name.strip("."))
    jobs.audit_tables(entries(), log, index, ck).awaitTermination(120)
    assert state() == ([("1", 2), ("1", 5), ("2", 7), ("2", 9)], [("1", 5), ("2", 9)])
    assert spark.read.parquet(log).select(F.count(F.lit(1))).first()[0] == 4
