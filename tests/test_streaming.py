"""Streams end in the same state as batches."""

from pyspark.sql import functions as F

from sigilo.sources import files
from sigilo.streaming import progress

SF = "/root/testdata/sf0.001"


def test_latest_state(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("etapa"), F.lit(1.0).alias("porcentagem"))
    e.repartition(5).write.parquet(str(tmp_path / "in"))
    q = progress.watch(spark, str(tmp_path / "in"), e._jdf.schema().toDDL(), "states", str(tmp_path / "ck"))
    q.awaitTermination()
    key = lambda df: sorted((r.job_id, r.etapa, r.seq) for r in df.collect())
    assert key(spark.table("states")) == key(progress.latest(e))


def test_percent(spark):
    rows = [("upload", 0, 4), ("extraction", 2, 4), ("finalization", 0, 0), ("que", 0, 4)]
    df = spark.createDataFrame(rows, "e string, p int, n int").select(progress.percent(F.col("e"), F.col("p"), F.col("n")).alias("x"))
    assert [r.x for r in df.collect()] == [5.0, 25.0, 100.0, 0.0]


def test_audit_log_and_stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"job_id": "1", "total_redacoes": 2}\n\nnot json\n{"job_id": "1", "total_redacoes": 5}\n')
    log = files.audit_log(spark, str(tmp_path / "log"))
    assert [r.total_redacoes for r in log.orderBy("line_no").collect()] == [2, 5]
    q = progress.audit_stream(spark, str(tmp_path / "log"), files.AUDIT, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("job_id = '1'").count() == 2


def test_allowlists_annotations_and_uploads(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"nome": "Ana Lima", "tipo": "juiz"}, {"nome": "B C", "tipo": "juiz", "ativo": false}]')
    assert sorted((r.nome, r.ativo) for r in files.allowlist_json(spark, [str(tmp_path / "l.json")]).collect()) == [("Ana Lima", True), ("B C", False)]
    (tmp_path / "l.csv").write_text(" Ana , 1\n,\nBia,2\n")
    assert sorted(r.nome for r in files.allowlist_csv(spark, str(tmp_path / "l.csv"), "juiz").collect()) == ["Ana", "Bia"]
    (tmp_path / "ann").mkdir()
    (tmp_path / "ann" / "d1.json").write_text('{"text": "Ana foi", "entities": [{"start": 0, "end": 3, "label": "PESSOA"}], "metadata": {"reviewed": true}}')
    (tmp_path / "ann" / "d2.json").write_text('{"text": "x"}')
    assert [r.doc_id for r in files.annotations(spark, str(tmp_path / "ann"), only_reviewed=True).collect()] == ["d1"]
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "up" / "b.pdf").write_bytes(b"PK\x03\x04")
    assert sorted((r.nome, r.aceito) for r in files.uploads(spark, str(tmp_path / "up")).collect()) == [("a.pdf", True), ("b.pdf", False)]
