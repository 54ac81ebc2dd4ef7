"""Readers and writers of the file formats: word boxes, allowlists, audit logs, annotations, uploads, metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigilo.functions import text as T
from sigilo.operators import geometry

AUDIT = (
    "job_id string, timestamp string, arquivo_original string, hash_original string, arquivo_anonimizado string, hash_anonimizado string, total_redacoes int, "
    "regras_aplicadas array<string>, dados_anonimizados array<struct<tipo:string,hash:string>>, tempo_processamento_ms int, usuario string, ip_origem string"
)
ANNOTATION = "doc_id string, text string, entities array<struct<start:int,end:int,label:string,text:string,confidence:double,source:string>>, metadata struct<source:string,annotator:string,reviewed:boolean>"
ALLOWLIST = "nome string, tipo string, registro string, ativo boolean"


def uploads(spark: SparkSession, path: str, pattern: str = "*", most: int = 200 * 1024 * 1024) -> DataFrame:
    """(path, nome, tamanho, hash, aceito) of uploaded files: extension, first bytes and size are checked, and enforced by `aceito`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ok = T.extension_allowed(name) & T.magic_ok(F.col("content"), name) & (F.col("length") <= most)
    return files.select("path", name.alias("nome"), F.col("length").alias("tamanho"), F.sha2("content", 256).alias("hash"), ok.alias("aceito"), F.col("modificationTime").alias("modificado"))


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON lines; blank and unreadable ones fall away. line_no orders lines within a file, files by name: a place
    (file, block, line), whatever way files and blocks are dealt to tasks."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), _place())
    return rows.select(F.from_json("value", AUDIT).alias("e"), "file", "line_no").where("e.job_id is not null").select("e.*", "file", "line_no")


def _place(name: str = "line_no") -> Column:
    """The file, the block and the line within it. A block is read by one task from its start, so ids rise along it."""
    return F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias(name)


def append_audit(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def allowlist_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Entries of JSON lists; ativo defaults to true, unreadable files have none. seq is the place in the list."""
    rows = spark.read.schema(ALLOWLIST + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(paths)
    return rows.where("nome is not null").select("nome", "tipo", "registro", F.coalesce("ativo", F.lit(True)).alias("ativo"), _place("seq"))


def allowlist_csv(spark: SparkSession, path: str, tipo: str) -> DataFrame:
    rows = spark.read.schema("nome string, registro string").csv(path)
    return rows.select(F.trim("nome").alias("nome"), F.lit(tipo).alias("tipo"), F.trim("registro").alias("registro"), F.lit(True).alias("ativo")).where("nome <> ''")


# The types whose entries are kept in files.
SAVED = ["juiz", "promotor", "advogado", "servidor"]


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def allowlist_versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a saved list, in order."""
    at, fs = _folder(spark, path)
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def saved_allowlist(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a saved list, the last one if none is told; no entries where there is none. seq is the place at which entries came in."""
    known = allowlist_versions(spark, path)
    if not known:
        return spark.createDataFrame([], ALLOWLIST + ", seq long")
    return spark.read.schema(ALLOWLIST + ", seq long").json(f"{path}/v={version or known[-1]:06d}")


def save_allowlist(allowlist: DataFrame, path: str) -> int:
    """Saves the entries of the known types as the next version, which is returned. All is written to a folder aside, which then gets the version's name
    in one step: the list that is read may be the last version, a write that fails leaves it as it is, and of two that save at once one fails."""
    spark = allowlist.sparkSession
    version = max([0, *allowlist_versions(spark, path)]) + 1
    staged, fs = _folder(spark, f"{path}/_staged-{uuid.uuid4().hex}")
    rows = allowlist if "seq" in allowlist.columns else allowlist.withColumn("seq", F.monotonically_increasing_id())
    try:
        rows.where(F.lower("tipo").isin(SAVED)).select("nome", "tipo", "registro", "ativo", "seq").write.json(staged.toString())
        target, _ = _folder(spark, f"{path}/v={version:06d}")
        if fs.exists(target) or not fs.rename(staged, target):
            raise FileExistsError(f"{path}: version {version} has been saved by another")
    finally:
        fs.delete(staged, True)
    return version


def upsert_allowlist(spark: SparkSession, new: DataFrame, path: str) -> int:
    """The next version: the last one, and the entries of `new` that aren't in it."""
    from sigilo.operators import allowlist

    there = saved_allowlist(spark, path)
    after = there.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
    given = [c for c in ("nome", "tipo", "registro", "ativo") if c in new.columns]
    return save_allowlist(allowlist.insert(there, new.select(*given, (F.monotonically_increasing_id() + after).alias("seq"))), path)


def annotations(spark: SparkSession, path: str, only_reviewed: bool = False) -> DataFrame:
    """Annotated documents of JSON files; doc_id defaults to the file's name, files without text or entities fall away."""
    rows = spark.read.schema(ANNOTATION).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = rows.select(F.coalesce("doc_id", F.regexp_replace("_metadata.file_name", r"\.json$", "")).alias("doc_id"), "text", "entities", "metadata")
    rows = rows.where("text is not null and entities is not null")
    return rows.where(F.coalesce("metadata.reviewed", F.lit(False))) if only_reviewed else rows


def document_paths(spark: SparkSession, path: str, pattern: str = "*", most: int | None = None) -> DataFrame:
    """The files of a folder by path, the first `most` of them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path").orderBy("path")
    return files if most is None else files.limit(most)


def split_of(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a saved data set; an unknown one is an error."""
    rows = spark.read.parquet(path).where(F.col("split") == split)
    if rows.isEmpty():
        raise ValueError(f"no split {split}")
    return rows


def export_annotations(docs: DataFrame, entities: DataFrame, path: str) -> None:
    """One JSON object for each document with text, its entities sorted by start."""
    listed = entities.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label", "text"))).alias("entities"))
    docs.where("trim(text) <> ''").join(listed, "doc_id", "left").select("doc_id", "text", F.coalesce("entities", F.array().cast("array<struct<start:int,end:int,label:string,text:string>>")).alias("entities")).write.mode("overwrite").json(path)


def save_splits(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def save_split_metadata(metadata: DataFrame, path: str) -> None:
    """A JSON object for each split: its name, counts and documents."""
    metadata.write.mode("overwrite").json(path)


def metrics_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def pages_text(words: DataFrame) -> DataFrame:
    """(doc_id, pagina, texto) of word boxes, words in reading order."""
    page = geometry.whole_pages(words, ["seq", "texto"])
    said = F.transform(F.array_sort(F.arrays_zip("seq", "texto")), lambda s: s["texto"])
    return page.select("doc_id", "pagina", F.array_join(said, " ").alias("texto"))


def full_text(pages: DataFrame) -> DataFrame:
    """(doc_id, texto, total_paginas, tipo) of pages in order; native from a mean of 100 characters on."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pagina", "texto"))), lambda s: s["texto"]), "\n")
    return pages.groupBy("doc_id").agg(text.alias("texto"), F.count(F.lit(1)).alias("total_paginas"), kind(F.avg(F.length("texto"))).alias("tipo"))


def kind(mean: Column) -> Column:
    return F.when(F.coalesce(mean, F.lit(0.0)) >= 100, "nativo").otherwise("imagem")


def page_map(pages: DataFrame) -> DataFrame:
    """(doc_id, texto_por_pagina map) for a viewer; a missing text is empty."""
    return pages.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("pagina", F.coalesce("texto", F.lit("")))))).alias("texto_por_pagina"))


def pdf_words(spark: SparkSession, path: str, extract, schema: str = "path string, pagina int, seq long, texto string, x0 double, y0 double, x1 double, y1 double") -> DataFrame:
    """Word boxes of binary files by a plug-in: extract(iterator of pandas frames with path and content)."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(extract, schema)


#: What a PDF plug-in tells of each page: its size in points and its words with boxes, in the order of the file.
PAGE = "path string, pagina int, largura double, altura double, palavras array<struct<texto:string,x0:double,y0:double,x1:double,y1:double,bloco:int,linha:int>>"


def mupdf_pages(frames):
    """The plug-in over PyMuPDF, where that package is there."""
    import fitz
    import pandas as pd

    for frame in frames:
        rows = []
        for path, content in zip(frame["path"], frame["content"]):
            for k, page in enumerate(fitz.open(stream=content, filetype="pdf")):
                words = [dict(zip(("x0", "y0", "x1", "y1", "texto", "bloco", "linha"), w[:7])) for w in page.get_text("words")]
                rows.append((path, k + 1, page.rect.width, page.rect.height, words))
        yield pd.DataFrame(rows, columns=["path", "pagina", "largura", "altura", "palavras"])


def pdf_pages(spark: SparkSession, path: str, extract=mupdf_pages) -> DataFrame:
    """Pages of binary files by a plug-in: extract(iterator of pandas frames with path and content) tells PAGE. Files are read where they are dealt."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(extract, PAGE)


def page_words(pages: DataFrame) -> DataFrame:
    """(path, pagina, seq, texto, x0, y0, x1, y1, bloco, linha): word boxes, numbered through the file from 1; blank ones fall away."""
    rows = pages.select("path", "pagina", F.posexplode("palavras").alias("k", "w")).select("path", "pagina", "k", "w.*").where("trim(texto) <> ''")
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("path").orderBy("pagina", "k")).cast("long")).drop("k")


def page_blocks(words: DataFrame) -> DataFrame:
    """(path, pagina, bloco, texto, x0, y0, x1, y1): blocks of words, a blank between words and a line end between lines."""
    line = words.groupBy("path", "pagina", "bloco", "linha").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "texto"))), lambda s: s["texto"]), " ").alias("dito"),
        *[f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))],
    )
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("linha", "dito"))), lambda s: s["dito"]), "\n").alias("texto")
    return line.groupBy("path", "pagina", "bloco").agg(said, *[f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))])


def page_dims(pages: DataFrame) -> DataFrame:
    return pages.select("path", "pagina", "largura", "altura")


def pdf_info(pages: DataFrame) -> DataFrame:
    """(path, total_paginas, tipo) of each file; native from a mean of 100 characters a page on."""
    said = F.length(F.array_join(F.transform("palavras", lambda w: w["texto"]), " "))
    return pages.groupBy("path").agg(F.count(F.lit(1)).alias("total_paginas"), kind(F.avg(said)).alias("tipo"))


#: Engines that read page images, the better ones first, and what is registered for them.
OCR_ORDER = ("surya", "paddle", "tesseract")
OCR_ENGINES: dict = {}


def ocr_engine(wanted: str = "surya"):
    """The engine wanted, or the next one that is registered and says that it is there; None without any. An engine is a
    mapInPandas function, or a pair of one and a test whether it is there."""
    for name in OCR_ORDER[OCR_ORDER.index(wanted):] if wanted in OCR_ORDER else (wanted,):
        engine = OCR_ENGINES.get(name)
        recognise, there = engine if isinstance(engine, tuple) else (engine, lambda: True)
        if recognise is not None and there():
            return recognise
    return None


def box_text(boxes: DataFrame) -> DataFrame:
    """(doc_id, texto) of engines that box whole lines: a line a box, by page, top and left."""
    rows = F.array_sort(F.collect_list(F.struct("pagina", "y", "x", "seq", "texto")))
    return boxes.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda b: b["texto"]), "\n").alias("texto"))


def ocr_boxes(images: DataFrame, recognise, least: float = 0.60, schema: str = "doc_id long, pagina int, seq long, texto string, x int, y int, largura int, altura int, confianca double") -> DataFrame:
    """Boxes of page images by a plug-in; the confidence filter stays in the plan."""
    return images.mapInPandas(recognise, schema).where((F.col("confianca") >= least) & (F.trim("texto") != ""))
