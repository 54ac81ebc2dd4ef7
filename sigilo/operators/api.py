"""What a service offers, as functions of DataFrames: analyse, anonymise, anonymise a reviewed selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigilo.functions import rules as R
from sigilo.sources import files

from . import allowlist as A
from . import context, detect, geometry, review, spans, transform

#: Types that a recogniser keeps: rules own the rest.
RECOGNISED = ("PESSOA", "ENDERECO", "ORGANIZACAO")
ENGINES: dict[str, Callable] = {}
AVAILABLE: dict[str, Callable[[], bool]] = {}
ALIASES = {"standard": "transformer", "deep": "gliner_deep", "legacy": "spacy", "llm": "llm"}
FALLBACK = {"gliner_deep": "gliner", "gliner": "transformer", "llm": "transformer", "transformer": "spacy"}


def register(name: str, extract: Callable, available: Callable[[], bool] | None = None) -> None:
    """A recogniser under a name: a mapInPandas function from (doc_id, text) to detect.entities_from's schema, which loads its
    model once in a worker. available: tells, when a plan is built, whether what it needs is there."""
    ENGINES[name] = extract
    AVAILABLE[name] = available or (lambda: True)


def engine(name: str) -> Callable | None:
    """The recogniser of a name or alias, or the next that is registered and available; none means rules only."""
    name = ALIASES.get(name, name)
    while name and not (name in ENGINES and AVAILABLE[name]()):
        name = FALLBACK.get(name, "")
    return ENGINES.get(name)


def analyse(docs: DataFrame, ner: str = "standard", allow: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Findings of each text: the header's parties wherever their names stand, rules, then recognised entities that the context
    doesn't clear. What rules and recogniser both find is told twice, so that what one of them sees further stays hidden. With a list, `status` tells which persons stay visible. Order: stage, ini, rule_order;
    repeats of a place go."""
    text = docs.select("doc_id", "text")
    parties = detect.everywhere(detect.header_parties(text, compat).drop("seq").distinct(), text)
    parties = parties.select("doc_id", F.lit(-1).alias("rule_order"), "tipo", "valor", "ini", "fim", "confianca", "fonte")
    found = detect.find_all(text, compat).withColumn("tipo", F.when(F.col("tipo") == "PESSOA_CONTEXTO", "PESSOA").otherwise(F.col("tipo")))
    parts = [found.select("doc_id", "rule_order", "tipo", "valor", F.col("v_ini").alias("ini"), F.col("v_fim").alias("fim"), "confianca", "fonte")]
    extract = engine(ner)
    if extract is not None:
        named = detect.recognised(text, extract).where(F.col("tipo").isin(*RECOGNISED))
        hidden = context.decide(named.join(text, "doc_id")).where("decisao.anonimizar")
        parts.append(hidden.select("doc_id", F.lit(99).alias("rule_order"), "tipo", "valor", "ini", "fim", F.lit(detect.CONFIDENCE["ner"]).alias("confianca"), F.lit("ner").alias("fonte")))
    rows = spans.dedupe_spans(spans.ordered_union(parties, *parts), ["stage", "ini", "rule_order"])
    return A.route(rows, allow) if allow is not None else rows.withColumn("status", F.lit("anonimizado"))


def analyse_pages(words: DataFrame, ner: str = "standard", supplement: str | None = None, allow: DataFrame | None = None, visual: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Findings of paged documents with their boxes. words: doc_id, pagina, seq, texto, x0, y0, x1, y1.

    The parties of the header, the rules, the recogniser (what the context clears goes) and a supplementary one (what an entity of
    the first overlaps goes too) are united in this order. Each finding is placed among the words, one row a word that
    it covers, and repeats of a value at a place go. Visual findings come after that and aren't compared. With a list,
    `status` tells which persons stay visible. Findings that stand nowhere have no box and fall away.
    """
    pages = files.pages_text(words)
    text = files.full_text(pages).select("doc_id", F.col("texto").alias("text"))
    parties = detect.header_parties(text, compat).select("doc_id", F.lit(-1).alias("rule_order"), "tipo", "valor", F.col("seq").alias("ini"), "confianca", "fonte")
    rules = detect.find_all(text, compat).withColumn("tipo", review.plain_type(F.col("tipo")))
    rules = rules.select("doc_id", "rule_order", "tipo", "valor", F.col("v_ini").alias("ini"), F.col("v_fim").alias("fim"), "confianca", "fonte")
    parts, taken = [parties, rules.drop("fim")], None
    for k, (name, source) in enumerate(((ner, "ner"), (supplement, "ner_suplementar"))):
        extract = engine(name) if name else None
        if extract is None:
            continue
        named = detect.recognised(text, extract).where(F.col("tipo").isin(*RECOGNISED))
        named = named if taken is None else spans.overlap_anti(named, taken)
        hidden = context.decide(named.join(text, "doc_id")).where("decisao.anonimizar")
        hidden = hidden.select("doc_id", F.lit(99 + k).alias("rule_order"), "tipo", "valor", "ini", "fim", F.lit(detect.CONFIDENCE["ner"]).alias("confianca"), F.lit(source).alias("fonte"))
        parts.append(hidden.drop("fim"))
        taken = named.select("doc_id", "ini", "fim") if taken is None else taken
    found = spans.ordered_union(*parts)
    order = F.struct("stage", "ini", "rule_order")
    asked = found.groupBy("doc_id", "valor").agg(F.min(order).alias("o"))
    asked = asked.withColumn("ent", F.row_number().over(Window.partitionBy("doc_id").orderBy("o", "valor")).cast("long"))
    at = geometry.locate(words.select("doc_id", "pagina", "seq", "texto", "x0", "y0"), asked.select("doc_id", "ent", "valor"))
    box = words.select("doc_id", "seq", "x0", "y0", "x1", "y1")
    placed = at.join(asked.select("doc_id", "ent", "valor"), ["doc_id", "ent"]).join(box, ["doc_id", "seq"]).drop("ent", "tier")
    rows = found.join(placed, ["doc_id", "valor"]).withColumn("job_id", F.col("doc_id"))
    rows = spans.dedupe_findings(rows, ["stage", "ini", "rule_order", "tipo"]).select("doc_id", "pagina", "seq", "tipo", "valor", "x0", "y0", "x1", "y1", "confianca", "fonte")
    if visual is not None:
        rows = geometry.with_visual(rows, visual).drop("stage")
    return A.route(rows, allow) if allow is not None else rows.withColumn("status", F.lit("anonimizado"))


def anonymise(docs: DataFrame, mode: str = "redact", **options) -> DataFrame:
    """(doc_id, texto) with the findings redacted, or replaced by stand-ins drawn from the document's id."""
    found = analyse(docs, **options).where("status = 'anonimizado'").drop("status", "stage")
    return _apply(docs, found, mode)


def anonymise_selected(docs: DataFrame, findings: DataFrame, review: DataFrame, terms: DataFrame, mode: str = "redact") -> DataFrame:
    """(doc_id, texto) with reviewed findings (job_id is the document) and all places of custom terms hidden; the list isn't asked again."""
    kept = transform.selected(findings, review).select(F.col("job_id").alias("doc_id"), "tipo", "valor", "ini", "fim")
    hits = transform.custom_terms(docs, terms).select("doc_id", "tipo", F.col("termo").alias("valor"), "ini", "fim")
    return _apply(docs, kept.unionByName(hits), mode)


def _apply(docs: DataFrame, found: DataFrame, mode: str) -> DataFrame:
    if mode == "redact":
        return transform.redact(docs, found, R.REDACTED)
    if mode != "pseudonym":
        raise ValueError(f"unknown mode {mode}")
    apart = spans.merge(found).select("doc_id", F.col("ini").alias("m_ini"), F.col("fim").alias("m_fim"))
    named = found.join(apart, "doc_id").where("ini >= m_ini and fim <= m_fim")
    first = spans.first_wins(named, [F.col("doc_id"), F.col("m_ini")], ["ini", "fim", "tipo"])
    return transform.pseudonymize(docs, first.select("doc_id", "tipo", "valor", F.col("m_ini").alias("ini"), F.col("m_fim").alias("fim")), F.col("doc_id").cast("string"))
