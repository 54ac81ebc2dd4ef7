"""Detection: the rule catalogue, header parties, topics and name hints, as projections of the text table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigilo.functions import rules as R
from sigilo.functions import scan
from sigilo.functions import text as T

from . import spans

CONFIDENCE = {"header": 0.95, "regex": 1.0, "ner": 0.85, "llm": 0.80, "hint": 0.70}


def group_of(rule: R.Rule) -> int:
    """The group that holds a rule's value: the first, or 0, the whole match, for a rule without one."""
    return min(1, re.compile(rule.pattern).groups)


def _pattern(rule: R.Rule) -> scan.Pattern:
    pivot, before, reach = R.LINEAR.get(rule.tipo, (None, None, None))
    return scan.Pattern(rule.pattern, rule.ignore_case, group_of(rule), pivot, before, reach)


def find_all(docs: DataFrame, compat: bool = False, tipos: list[str] | None = None) -> DataFrame:
    """(doc_id, rule_order, tipo, valor, ini, fim, v_ini, v_fim, confianca, fonte): every match of every rule, in one scan.

    CPF and CNPJ need right check digits. Every text is read once, for all rules. Order of a document's findings: ini,
    rule_order. Null texts have none.
    """
    chosen = [(k, r) for k, r in enumerate(R.rules(compat)) if tipos is None or r.tipo in tipos]
    out = scan.patterns(docs, [(k, _pattern(r)) for k, r in chosen])
    tipo = F.element_at(F.array(*[F.lit(r.tipo) for r in R.rules(compat)]), F.col("k") + 1)
    out = out.select("doc_id", F.col("k").alias("rule_order"), tipo.alias("tipo"), "valor", "ini", "fim", "v_ini", "v_fim")
    valid = F.when(F.col("tipo") == "CPF", T.valid_cpf(F.col("valor"))).when(F.col("tipo") == "CNPJ", T.valid_cnpj(F.col("valor"))).otherwise(True)
    return out.where(valid).withColumn("confianca", F.lit(CONFIDENCE["regex"])).withColumn("fonte", F.lit("regex"))


def find_by_type(docs: DataFrame, tipo: str, compat: bool = False) -> DataFrame:
    """Matches of one rule without the test of check digits; an unknown type is an error."""
    found = scan.patterns(docs, [(0, _pattern(R.rule(tipo, compat)))])
    return found.select("doc_id", F.lit(tipo).alias("tipo"), "ini", "fim", "valor", "v_ini", "v_fim")


def header_parties(docs: DataFrame, compat: bool = False) -> DataFrame:
    """Names that the first 3000 characters list as parties: cut at a comma, a semicolon, 'e' or 'qualificad', longer than three letters."""
    head = F.substring("text", 1, 3000)
    lists = [F.transform(F.regexp_extract_all(head, F.lit(p), F.lit(1)), lambda x: T.strip(F.split(x, r"(?U)[,;]|\be\b|\bqualificad", 2)[0])) for p in (R.HEADER_COMPAT if compat else R.HEADER)]
    rows = docs.select("doc_id", F.posexplode(F.concat(*lists)).alias("seq", "valor"))
    kept = (F.length("valor") > 3) & ~F.upper("valor").isin("A", "O", "OS", "AS")
    return rows.where(kept).select("doc_id", "seq", F.lit("PESSOA").alias("tipo"), "valor", F.lit(CONFIDENCE["header"]).alias("confianca"), F.lit("header_analysis").alias("fonte"))


def topic_keywords(docs: DataFrame, words: list[str] | None = None, around: int = 50) -> DataFrame:
    """(doc_id, palavra, ini, contexto) of every occurrence of a sensitive topic's word, in any case."""
    rows = scan.literals(docs.withColumn("inteiro", F.col("text")), list(words or R.TOPICS), lower=True, keep=["doc_id", "inteiro"])
    start = F.greatest(F.col("ini") - around, F.lit(0))
    context = F.substr(F.col("inteiro"), start + 1, F.col("ini") + F.length("valor") + around - start)
    return rows.select("doc_id", F.col("valor").alias("palavra"), "ini", context.alias("contexto"))


def name_hints(docs: DataFrame) -> DataFrame:
    """Capitalised names after a role and a colon, with the offsets of the name."""
    found = scan.patterns(docs, [(k, scan.Pattern(p, group=1)) for k, p in enumerate(R.HINTS)])
    return found.select("doc_id", F.lit("PESSOA").alias("tipo"), "valor", F.col("v_ini").alias("ini"), F.col("v_fim").alias("fim"), F.lit(CONFIDENCE["hint"]).alias("confianca"), F.lit("regex_hint").alias("fonte"))


def entities_from(docs: DataFrame, extract, schema: str = "doc_id long, tipo string, valor string, ini int, fim int, score double") -> DataFrame:
    """A recogniser as a plug-in: extract(iterator of pandas frames) runs once in each worker, so a model loads once."""
    return docs.select("doc_id", "text").mapInPandas(extract, schema)


def of_type(entities: DataFrame, *tipos: str) -> DataFrame:
    """The entities of these types: persons, places, organisations, or any other."""
    return entities.where(F.col("tipo").isin(*tipos))


def persons(entities: DataFrame) -> DataFrame:
    return of_type(entities, "PESSOA")


def locations(entities: DataFrame) -> DataFrame:
    return of_type(entities, "LOCAL", "ENDERECO")


def organizations(entities: DataFrame) -> DataFrame:
    return of_type(entities, "ORGANIZACAO")


def scored(entities: DataFrame, least: float) -> DataFrame:
    """Detections of the least score or more; those without a score fall away."""
    return entities.where(F.col("score") >= least)


def mapped_labels(entities: DataFrame, label_map: DataFrame) -> DataFrame:
    """tipo from (engine, label) by a small map, unknown labels OUTRO. The map is a dimension table: the optimizer broadcasts it by its size."""
    label = F.replace(F.lower("label"), F.lit(" "), F.lit("_"))
    return entities.withColumn("label", label).join(label_map, ["engine", "label"], "left").withColumn("tipo", F.coalesce("tipo", F.lit("OUTRO")))


# The types that a model's answer may name.
ANSWERED = ["PESSOA", "CPF", "CNPJ", "RG", "EMAIL", "TELEFONE", "ENDERECO", "OAB", "DATA_NASCIMENTO", "CEP", "CONTA_BANCARIA", "AGENCIA", "CNH", "TITULO_ELEITOR", "PIS_PASEP", "CTPS", "ORGANIZACAO", "OUTRO"]


def salvaged_json(answer: Column) -> Column:
    """Entities (texto, tipo) of a model's answer: a list, the first list among an object's values in their order, or, only if the answer
    can't be parsed, the longest bracketed list in it. What is no object with a text falls away; a missing or unknown type is OUTRO."""
    is_list = lambda v: F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))
    parsed = F.try_parse_json(answer)
    values = F.map_values(F.from_json(answer, "map<string,variant>"))
    prose = F.try_parse_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1))
    told = F.when(parsed.isNull(), prose).when(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.get(F.filter(values, is_list), F.lit(0))).otherwise(parsed)
    items = F.coalesce(F.when(is_list(told), told.try_cast("array<variant>")), F.array().cast("array<variant>"))
    objects = F.filter(items, lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)))
    field = lambda v, name: T.strip(F.try_variant_get(v, f"$.{name}", "string"))
    tipo = lambda v: F.when(F.upper(field(v, "tipo")).isin(ANSWERED), F.upper(field(v, "tipo"))).otherwise("OUTRO")
    return F.filter(F.transform(objects, lambda v: F.struct(field(v, "texto").alias("texto"), tipo(v).alias("tipo"))), lambda e: e["texto"] != "")


def located(entities: DataFrame) -> DataFrame:
    """First place of an entity's text in the document: as written, else in any case; entities that aren't there fall away."""
    at = F.coalesce(F.nullif(F.expr("locate(valor, text)"), F.lit(0)), F.nullif(F.expr("locate(lower(valor), lower(text))"), F.lit(0)))
    return entities.withColumn("ini", at - 1).where("ini is not null").withColumn("fim", F.col("ini") + F.length("valor"))


def everywhere(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """entities (doc_id, valor, ...) at every place where their text stands as whole words, in any case: a row for each place, with
    ini and fim. The distinct values of a document, few as they are of its head, meet its text once."""
    values = entities.groupBy("doc_id").agg(F.collect_set("valor").alias("valores"))
    at = scan.own_words(docs.select("doc_id", "text").join(values, "doc_id"), "valores").select("doc_id", "k", "ini", "fim")
    listed = values.select("doc_id", F.posexplode(F.array_sort("valores")).alias("k", "valor"))
    return entities.join(listed, ["doc_id", "valor"]).join(at, ["doc_id", "k"]).drop("k")


def recognised(docs: DataFrame, extract, size: int = 3500, overlap: int = 200, deal: int | None = None) -> DataFrame:
    """A recogniser's entities of texts of any length: texts are cut into pieces that overlap, pieces are read each by itself, offsets move
    back, and an entity is kept from the one piece in which its middle lies furthest from an edge.

    Every place of a text so belongs to one piece, which needs no comparison of entities: those of up to `overlap` characters, which the recogniser finds with that
    much around them, come out as from the whole text, and none twice. deal: tasks that the pieces are dealt to, where one text is to be read by many.
    """
    pieces = spans.chunks(docs.select("doc_id", "text", F.length("text").alias("_n")), size, overlap, ["_n"])
    half, step = overlap // 2, size - overlap
    low = F.when(F.col("ini") == 0, F.lit(0)).otherwise(F.col("ini") + half)
    high = F.when(F.col("ini") + step >= F.col("_n"), F.lit((1 << 31) - 1)).otherwise(F.col("ini") + step + half)
    pieces = pieces.select("doc_id", "ini", low.alias("low"), high.alias("high"), "texto")
    pieces = pieces.repartition(deal) if deal else pieces

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, starts = [], [0]  # of each frame that was read: its documents and numbers, and where its ids start

        def fed() -> Iterator[pd.DataFrame]:
            for f in frames:
                first = starts[-1]
                places.append((f["doc_id"].to_numpy(copy=True), f[["ini", "low", "high"]].to_numpy("int32", copy=True)))
                starts.append(first + len(f))
                yield pd.DataFrame({"doc_id": range(first, starts[-1]), "text": f["texto"].to_numpy()})

        for out in extract(fed()):
            ids = out["doc_id"].to_numpy("int64")
            frame = np.searchsorted(starts, ids, side="right") - 1
            told = [(places[j][0][k], *places[j][1][k]) for j, k in zip(frame.tolist(), (ids - np.array(starts)[frame]).tolist())]
            at = pd.DataFrame(told, columns=["doc_id", "_ini", "low", "high"], index=out.index)
            moved = out.assign(doc_id=at["doc_id"], ini=out["ini"] + at["_ini"], fim=out["fim"] + at["_ini"])
            middle = (moved["ini"] + moved["fim"]) // 2
            yield moved[(middle >= at["low"]) & (middle < at["high"])]

    return pieces.mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, tipo string, valor string, ini int, fim int, score double")
