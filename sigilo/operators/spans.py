"""Span algebra: union with order, dedupe, overlap, merge, chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals


def ordered_union(*parts: DataFrame) -> DataFrame:
    """Bag union that remembers which part a row came from, in `stage`."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("stage", F.lit(k)) for k, p in enumerate(parts)])


def first_wins(rows: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key by the order; repeats go. Stable where dropDuplicates is not."""
    named = [f"_k{i}" for i in range(len(key))]
    keyed = rows.withColumns(dict(zip(named, key)))
    w = Window.partitionBy(*named).orderBy(*order)
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", *named)


def dedupe_findings(findings: DataFrame, order: list[str]) -> DataFrame:
    """One finding for each value in any case, page and half-even rounded corner."""
    return first_wins(findings, [F.col("job_id"), F.lower("valor"), F.col("pagina"), F.bround("x0"), F.bround("y0")], order)


def dedupe_spans(spans: DataFrame, order: list[str]) -> DataFrame:
    return first_wins(spans, [F.col("doc_id"), F.lower("valor"), F.col("tipo"), F.col("ini")], order)


def overlap_anti(spans: DataFrame, others: DataFrame) -> DataFrame:
    """Spans that no other span of the document overlaps, by one sweep over the starts and ends: no pairs are made."""
    return intervals.overlapped(spans, others).where("not _over").drop("_over")


def merge(spans: DataFrame) -> DataFrame:
    """(doc_id, ini, fim, n): overlapping or touching spans as one. A running maximum of the ends tells where a new one begins."""
    w = Window.partitionBy("doc_id").orderBy("ini", "fim")
    ahead = F.max("fim").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select("doc_id", "ini", "fim", F.when(ahead >= F.col("ini"), 0).otherwise(1).alias("_new"))
    marked = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "_g").agg(F.min("ini").alias("ini"), F.max("fim").alias("fim"), F.count(F.lit(1)).alias("n")).drop("_g")


def chunks(docs: DataFrame, size: int, overlap: int = 0, keep: list[str] = ()) -> DataFrame:
    """(doc_id, keep, chunk, ini, texto): overlapping pieces of the text, none for an empty one."""
    starts = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.length("text") - 1, F.lit(size - overlap)))
    return docs.select("doc_id", *keep, "text", F.posexplode(starts).alias("chunk", "ini")).select("doc_id", *keep, "chunk", "ini", F.substr(F.col("text"), F.col("ini") + 1, F.lit(size)).alias("texto"))
