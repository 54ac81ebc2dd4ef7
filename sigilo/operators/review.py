"""Projections and edits of the review screen and of the service's answers."""

from __future__ import annotations

import json
from pathlib import Path, PurePath

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigilo.functions import rules as R
from sigilo.functions import text as T

from . import grams

BUCKETS = {"PROC_CNJ": "Processo CNJ", "PESSOA": "Pessoas"} | dict.fromkeys(("CPF", "CNPJ", "RG", "OAB"), "Documentos") | dict.fromkeys(("EMAIL", "TELEFONE", "ENDERECO", "CEP"), "Contato")


def plain_type(tipo: Column) -> Column:
    return F.when(tipo == "PESSOA_CONTEXTO", "PESSOA").otherwise(tipo)


def answer(findings: DataFrame, compat: bool = False) -> DataFrame:
    """Findings as the service tells them: a known type (else OUTRO, or PESSOA with compat), masked value, box by width and height."""
    tipo = plain_type(F.col("tipo"))
    box = F.struct(F.coalesce("x0", F.lit(0.0)).alias("x"), F.coalesce("y0", F.lit(0.0)).alias("y"), F.coalesce(F.col("x1") - F.col("x0"), F.lit(0.0)).alias("width"), F.coalesce(F.col("y1") - F.col("y0"), F.lit(0.0)).alias("height"))
    known = F.when(tipo.isin(R.ENTITY_TYPES), tipo).otherwise("PESSOA" if compat else "OUTRO")
    return findings.select("job_id", "seq", known.alias("tipo"), T.mask3(F.col("valor")).alias("valor"), box.alias("posicao"))


def areas(confirmed: DataFrame) -> DataFrame:
    """Areas of confirmed entities; a missing corner is 0."""
    return confirmed.select("job_id", "pagina", "tipo", "valor", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def reviewer_type(tipo: Column) -> Column:
    return F.coalesce(F.nullif(T.strip(tipo), F.lit("")), F.lit("OUTRO"))


def output_name(name: Column, mode: Column) -> Column:
    """The file's stem with the mode's ending."""
    ending = F.when(mode == "pseudonym", "_pseudonimizado.pdf").otherwise("_anonimizado.pdf")
    return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), ending)


def config_json(config: dict, labels: list[str]) -> str:
    """A training configuration as JSON, paths as text, with the labels."""
    return json.dumps({k: str(v) if isinstance(v, PurePath) else v for k, v in config.items()} | {"labels": labels}, ensure_ascii=False, indent=2)


def config_of(text: str, paths: tuple[str, ...] = ("output_dir", "dataset_dir", "annotations_dir")) -> dict:
    """The configuration of the JSON, without its labels, with its paths."""
    return {k: Path(v) if k in paths else v for k, v in json.loads(text).items() if k != "labels"}


def deep_labels(standard: Column, extra: Column) -> Column:
    """The standard labels and then the extra ones that aren't among them."""
    return F.array_union(standard, extra)


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two timestamps."""
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000)


def bucket(tipo: Column) -> Column:
    pairs = [c for k, v in BUCKETS.items() for c in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[tipo], F.lit("Outros"))


def grouped(findings: DataFrame) -> DataFrame:
    """(grupo, n): the five groups of the screen, empty ones left out."""
    return findings.groupBy(bucket(F.col("tipo")).alias("grupo")).agg(F.count(F.lit(1)).alias("n"))


def by_type(entities: DataFrame, sure: float = 0.8) -> DataFrame:
    """tipo -> its entities in order, how many, and how many of them the engine was sure of."""
    listed = F.array_sort(F.collect_list(F.struct("ini", "fim", "valor")))
    return entities.groupBy("doc_id", "tipo").agg(listed.alias("entidades"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > sure).alias("seguras"))


def applied_rules(findings: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Distinct types of each job, with OUTRO for jobs that had custom terms."""
    out = findings.select("job_id", "tipo")
    if terms is not None:
        out = out.union(terms.select("job_id", F.lit("OUTRO")))
    return out.groupBy("job_id").agg(F.array_sort(F.collect_set("tipo")).alias("regras"))


def summary(findings: DataFrame, review: DataFrame, terms: DataFrame) -> DataFrame:
    """(job_id, identificados, aprovados): entities and terms, selected entities and terms."""
    n = findings.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    s = review.groupBy("job_id").agg(F.count_if("selected").alias("s"))
    t = terms.groupBy("job_id").agg(F.count(F.lit(1)).alias("t"))
    out = n.join(s, "job_id", "left").join(t, "job_id", "left").na.fill(0, ["s", "t"])
    return out.select("job_id", (F.col("n") + F.col("t")).alias("identificados"), (F.col("s") + F.col("t")).alias("aprovados"))


def add_terms(terms: DataFrame, new: DataFrame) -> DataFrame:
    """Adds terms that the job doesn't have in any case."""
    there = terms.select(F.col("job_id").alias("_j"), T.normal(F.col("termo")).alias("_t"))
    fresh = new.where(T.strip(F.col("termo")) != "").join(there, (F.col("job_id") == F.col("_j")) & (T.normal(F.col("termo")) == F.col("_t")), "left_anti")
    return terms.unionByName(fresh)


def toggle(review: DataFrame, chosen: DataFrame) -> DataFrame:
    """review with the selection of the chosen rows turned over."""
    mark = chosen.select("job_id", "seq", F.lit(True).alias("_hit"))
    return review.join(mark, ["job_id", "seq"], "left").select("job_id", "seq", F.when(F.col("_hit"), ~F.col("selected")).otherwise(F.col("selected")).alias("selected"))


def select_all(review: DataFrame, value: bool = True) -> DataFrame:
    return review.withColumn("selected", F.lit(value))


def word_entities(words: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, seq, ent): the first entity that a word lies in or holds, punctuation aside; a word within must be longer than two letters."""
    bare = F.regexp_replace(F.lower("texto"), r"(?U)^[^\w]+|[^\w]+$", "")
    w = words.select("doc_id", "seq", bare.alias("w")).where("w <> ''")
    e = entities.select("doc_id", "ent", T.normal(F.col("valor")).alias("v"))
    word, value = w.select("doc_id", F.col("w").alias("part")), e.select("doc_id", F.col("v").alias("part"))
    holds = grams.contained(value, word.withColumnRenamed("part", "whole"), ["doc_id"]).toDF("doc_id", "v", "w")
    lies = grams.contained(word.where(F.length("part") > 2), value.withColumnRenamed("part", "whole"), ["doc_id"]).toDF("doc_id", "w", "v")
    met = w.join(holds.unionByName(lies).distinct(), ["doc_id", "w"]).join(e, ["doc_id", "v"])
    return met.groupBy("doc_id", "seq").agg(F.min("ent").alias("ent"))


def find_output(jobs: DataFrame, files_: DataFrame, log: DataFrame) -> DataFrame:
    """(job_id, caminho): the file that the log names, else the first of the job's two usual names that is there."""
    logged = log.select("job_id", F.col("arquivo_anonimizado").alias("caminho")).join(files_.select(F.col("path").alias("caminho")), "caminho", "left_semi")
    usual = F.array(*[F.concat("job_id", F.lit(e)) for e in ("_anonimizado.pdf", "_pseudonimizado.pdf")])
    named = jobs.select("job_id", F.posexplode(usual).alias("k", "path")).join(files_.select("path"), "path", "left_semi")
    guessed = named.groupBy("job_id").agg(F.min_by("path", "k").alias("achado"))
    return jobs.select("job_id").join(logged, "job_id", "left").join(guessed, "job_id", "left").select("job_id", F.coalesce("caminho", "achado").alias("caminho"))
