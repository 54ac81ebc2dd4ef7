"""Paged documents, plug-ins, files and edits: flows that the named queries don't reach."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigilo.operators import allowlist, api, audit, dataset, detect, evaluate, geometry, review, transform
from sigilo.sources import files
from sigilo.streaming import progress


def words(spark, *pages):
    """Word boxes of one document, a line of words for each string, 12 points apart."""
    rows, seq = [], 0
    for p, lines in enumerate(pages):
        for y, line in enumerate(lines):
            for x, w in enumerate(line.split()):
                seq += 1
                rows.append((1, p + 1, seq, w, 50.0 * x, 12.0 * y, 50.0 * x + 40, 12.0 * y + 10))
    return spark.createDataFrame(rows, "doc_id long, pagina int, seq long, texto string, x0 double, y0 double, x1 double, y1 double")


def test_all_words_of_a_name_are_covered(spark):
    w = words(spark, ["depois de tudo", "Ana Lima e Rua"], ["ana lima outra"])
    ask = lambda *v: spark.createDataFrame([(1, k, x) for k, x in enumerate(v)], "doc_id long, ent long, valor string")
    got = {(r.ent, r.tier, r.pagina, r.seq) for r in geometry.locate(w, ask("Ana Lima", "de Castro", "epoi", "LIMA", "nada", "")).collect()}
    assert got == {(0, 3, 1, 4), (0, 3, 1, 5), (1, 4, 1, 2), (2, 2, 1, 1), (3, 1, 1, 5)}
    every = {(r.pagina, r.seq) for r in geometry.locate(w, ask("Ana Lima"), "all").collect()}
    assert every == {(1, 4), (1, 5), (2, 8), (2, 9)}
    assert {(r.run, r.seq) for r in geometry.multiword(w, ask("ana  lima")).collect()} == {(4, 4), (4, 5), (8, 8), (8, 9)}


def test_lines_start_anew_from_their_first_box(spark):
    rows = [(1, 1, k, f"w{k}", x, y) for k, (x, y) in enumerate([(0, 0), (5, 9), (9, 14), (0, 21), (3, 36), (0, 37)])]
    got = geometry.lines(spark.createDataFrame(rows, "doc_id long, pagina int, seq long, texto string, x int, y int"))
    assert [(r.linha, r.texto) for r in got.orderBy("linha").collect()] == [(0, "w0 w1 w2"), (1, "w3"), (2, "w5 w4")]


def test_pages_are_analysed_in_order_with_boxes(spark):
    w = words(spark, ["Autor: Maria Souza, brasileira", "e-mail ana@x.com e Maria Souza", "Processo 0000123-45.2024.8.13.0024"])
    visual = spark.createDataFrame([(1, 1, "ROSTO", "[ROSTO DETECTADO]", 1.0, 2.0, 3.0, 4.0, 0.9, "face")] * 2, "doc_id long, pagina int, tipo string, valor string, x0 double, y0 double, x1 double, y1 double, confianca double, fonte string")

    def recognise(frames):
        for f in frames:
            rows = [(d, "PESSOA", "brasileira", t.find("brasileira"), t.find("brasileira") + 10, 0.9) for d, t in zip(f["doc_id"], f["text"])]
            yield pd.DataFrame(rows, columns=["doc_id", "tipo", "valor", "ini", "fim", "score"])

    api.register("test_engine", recognise, lambda: True)
    api.register("absent", recognise, lambda: False)
    assert api.engine("absent") is None and api.engine("test_engine") is recognise
    got = api.analyse_pages(w, ner="test_engine", visual=visual)
    rows = got.collect()
    by = {}
    for r in rows:
        by.setdefault((r.tipo, r.valor), []).append(r)
    assert len(by["PESSOA", "Maria Souza"]) == 2 and {r.fonte for r in by["PESSOA", "Maria Souza"]} == {"header_analysis"}
    assert by["EMAIL", "ana@x.com"][0].x0 == 50.0 and by["PROC_CNJ", "0000123-45.2024.8.13.0024"][0].y1 == 34.0
    assert len(by["ROSTO", "[ROSTO DETECTADO]"]) == 2
    allow = spark.createDataFrame([("maria souza", "juiz", True, 1)], "nome string, tipo string, ativo boolean, seq long")
    routed = api.analyse_pages(w, allow=allow).where("tipo = 'PESSOA' and valor = 'Maria Souza'").select("status").distinct().collect()
    assert [r.status for r in routed] == ["ignorado"]


def test_documents_are_redacted_or_named_anew(spark):
    docs = spark.createDataFrame([(1, "Autor: Maria Souza, fone (31) 99999-1234, CPF 529.982.247-25"), (2, None), (3, "nada")], "doc_id long, text string")
    out = {r.doc_id: r.texto for r in api.anonymise(docs).collect()}
    assert "Maria" not in out[1] and "99999" not in out[1] and "529" not in out[1] and out[1].count("[ANONIMIZADO]") == 3 and out[3] == "nada" and out[2] is None
    named = {r.doc_id: r.texto for r in api.anonymise(docs, "pseudonym").collect()}
    assert "Maria" not in named[1] and "529.982" not in named[1] and named[1].startswith("Autor: ") and named == {r.doc_id: r.texto for r in api.anonymise(docs, "pseudonym").collect()}
    with pytest.raises(ValueError):
        api.anonymise(docs, "other").collect()


def test_files_are_read_by_a_plug_in(spark, tmp_path):
    def toy_pages(frames):
        """Pages of a toy format: JSON lists of pages, each a list of lines."""
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                for p, lines in enumerate(json.loads(bytes(content))):
                    ws = [{"texto": w, "x0": 10.0 * x, "y0": 12.0 * y, "x1": 10.0 * x + 9, "y1": 12.0 * y + 9, "bloco": y // 2, "linha": y} for y, line in enumerate(lines) for x, w in enumerate(line.split(" "))]
                    rows.append((path, p + 1, 595.0, 842.0, ws))
            yield pd.DataFrame(rows, columns=["path", "pagina", "largura", "altura", "palavras"])

    (tmp_path / "a.pdf").write_text(json.dumps([["um dois", "tres", "quatro"], []]))
    (tmp_path / "b.pdf").write_text(json.dumps([["x" * 300]]))
    pages = files.pdf_pages(spark, str(tmp_path), toy_pages)
    w = files.page_words(pages)
    assert [(r.pagina, r.seq, r.texto) for r in w.where("path like '%a.pdf'").orderBy("seq").collect()] == [(1, 1, "um"), (1, 2, "dois"), (1, 3, "tres"), (1, 4, "quatro")]
    blocks = [(r.bloco, r.texto, r.x1) for r in files.page_blocks(w).where("path like '%a.pdf'").orderBy("bloco").collect()]
    assert blocks == [(0, "um dois\ntres", 19.0), (1, "quatro", 9.0)]
    info = {r.path[-5:]: (r.total_paginas, r.tipo) for r in files.pdf_info(pages).collect()}
    assert info == {"a.pdf": (2, "imagem"), "b.pdf": (1, "nativo")} and files.page_dims(pages).count() == 3
    assert [r.path[-5:] for r in files.document_paths(spark, str(tmp_path), "*.pdf", 1).collect()] == ["a.pdf"]


def test_the_last_line_over_files_wins(spark, tmp_path):
    line = lambda job, name: json.dumps({"job_id": job, "arquivo_original": name})
    (tmp_path / "1.jsonl").write_text("\n".join([line("j", "first " * 2000), "", "{broken", line("k", "k1")]))
    (tmp_path / "2.jsonl").write_text("\n".join([line("j", "second"), line("j", "third")]))
    log = files.audit_log(spark, str(tmp_path))
    assert {r.job_id: r.arquivo_original for r in audit.last_write(log).collect()} == {"j": "third", "k": "k1"}
    assert audit.lookup(log, "j").first().arquivo_original == "third" and audit.lookup(log, "x").count() == 0


def test_allowlist_edits(spark):
    rows = [("Ana Lima", "juiz", True, 1), (" ANA LIMA ", "advogado", True, 2), ("Beto", "juiz", False, 3)]
    lst = spark.createDataFrame(rows, "nome string, tipo string, ativo boolean, seq long")
    assert {r.seq for r in allowlist.delete(lst, "ana lima").collect()} == {1, 3} and allowlist.delete(lst, "x").count() == 3
    assert {r.tipo: r.ativos for r in allowlist.stats(lst).collect()} == {"juiz": 1, "advogado": 1, "promotor": 0, "servidor": 0}
    names = spark.createDataFrame([("Dra. Ana Lima Sá",), ("ana",), ("beto",), ("",)], "nome string")
    assert {(r.nome, r.entry) for r in allowlist.match_first(names, lst).collect()} == {("Dra. Ana Lima Sá", " ANA LIMA "), ("ana", " ANA LIMA ")}


def test_detectors_fail_alone(spark):
    images = spark.createDataFrame([(1, 1, b"x")], "doc_id long, pagina int, imagem binary")

    def faces(frames):
        for f in frames:
            yield pd.DataFrame([(1, 1, None, 1.0, 2.0, 3.0, 4.0, 0.9)], columns=["doc_id", "pagina", "tipo", "x", "y", "largura", "altura", "confianca"])

    def broken(frames):
        raise RuntimeError("no model")
        yield

    got = geometry.detected(images, {"face": faces, "signature": broken}).collect()
    assert [(r.fonte, r.x) for r in got] == [("face", 1.0)]
    files.OCR_ENGINES.update(paddle=(faces, lambda: False), tesseract=faces)
    assert files.ocr_engine("surya") is faces and files.ocr_engine("unknown") is None


def test_splits_and_configuration(spark, tmp_path):
    with pytest.raises(ValueError):
        dataset.checked_split(spark.createDataFrame([], "doc_id long"))
    docs = dataset.checked_split(spark.range(200).withColumnRenamed("id", "doc_id"))
    assert {r.split for r in docs.select("split").distinct().collect()} == {"train", "dev", "test"}
    files.save_splits(docs, str(tmp_path / "s"))
    assert files.split_of(spark, str(tmp_path / "s"), "dev").count() > 0
    with pytest.raises(ValueError):
        files.split_of(spark, str(tmp_path / "s"), "validation")
    from pathlib import Path

    config = {"output_dir": Path("out"), "epochs": 3}
    assert review.config_of(review.config_json(config, dataset.LABELS)) == config


def test_prediction_is_scored_where_labels_are(spark):
    rows = spark.createDataFrame([(1, 0, [1, 2], [1, 1], [1, -100, 2]), (1, 1, [1], [1], [])], "doc_id long, janela int, input_ids array<int>, attention_mask array<int>, labels array<int>")

    def predict(frames):
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "janela": f["janela"], "labels": f["labels"], "preds": [[x if x > 0 else 0 for x in v] for v in f["labels"]]})

    got = {r.janela: (r.verdade, r.previsto) for r in evaluate.predicted(rows, predict, dataset.LABELS).collect()}
    assert got == {0: (["B-PESSOA", "I-PESSOA"], ["B-PESSOA", "I-PESSOA"]), 1: ([], [])}


def test_many_terms_take_several_passes(spark, monkeypatch):
    monkeypatch.setattr(transform, "TERMS", 3)
    docs = spark.createDataFrame([(1, "aaa t1 t2 t3 t4 t5"), (2, None), (3, "")], "doc_id long, text string")
    terms = spark.createDataFrame([(f"t{k}", "X") for k in range(1, 6)] + [("aa", None), ("aa", "Y"), (" ", "Z")], "termo string, tipo string")
    got = sorted((r.termo, r.tipo, r.ini) for r in transform.custom_terms(docs, terms).collect())
    assert got == [("aa", "OUTRO", 0), ("aa", "OUTRO", 1), ("aa", "Y", 0), ("aa", "Y", 1)] + [(f"t{k}", "X", 1 + 3 * k) for k in range(1, 6)]
    assert detect.name_hints(docs).count() == 0


def test_states_of_a_stream_expire_by_watermark(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "2024-01-01 00:10:00", "upload", 5.0), ("a", 2, "2024-01-01 00:20:00", "detection", 45.0), ("b", 1, "2024-01-01 05:00:00", "upload", 5.0)], "job_id string, seq long, ts string, etapa string, porcentagem double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    updates = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = progress.watched(updates).writeStream.outputMode("append").format("memory").queryName("watched_states").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.job_id, r.etapa) for r in spark.table("watched_states").collect()} <= {("a", "detection")}
