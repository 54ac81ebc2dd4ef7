"""Joins of spans (doc_id, ini, fim) by where they lie: bins for pairs, sweeps for what overlaps anything, runs for what hangs together."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a bin: spans meet where they share one. Places of a block: a sweep goes on from block to block.
BIN, BLOCK = 256, 1 << 16


def _bins(ini: Column, fim: Column, width: int) -> Column:
    first = F.floor(ini / width)
    return F.sequence(first, F.greatest(F.floor((fim - 1) / width), first))


def _in_groups(a: DataFrame, b: DataFrame, cut: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by (doc_id, _bin) and (_doc, _obin) with the groups _ga and _gb that their rows meet in: of a bin with over `cut` rows of a side, that side
    is dealt to groups by its rows' hashes, and each row of the other goes to all of them. Fewer bins than a row in `cut` are cut, so they are broadcast."""
    every = a.select(F.col("doc_id").alias("_kd"), F.col("_bin").alias("_kb"), F.lit(1).alias("_x"), F.lit(0).alias("_y"))
    every = every.union(b.select("_doc", "_obin", F.lit(0), F.lit(1)))
    dense = every.groupBy("_kd", "_kb").agg(F.ceil(F.sum("_x") / cut).alias("_as"), F.ceil(F.sum("_y") / cut).alias("_bs")).where("_as * _bs > 1")

    def dealt(rows: DataFrame, doc: str, at: str, own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
        by = F.xxhash64(*rows.columns)
        met = rows.join(F.broadcast(dense), (F.col(doc) == F.col("_kd")) & (F.col(at) == F.col("_kb")), "left")
        met = met.withColumn(own[1], F.coalesce(F.pmod(by, own[0]), F.lit(0)))
        return met.withColumn(other[1], F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other[0], F.lit(1)) - 1))).drop("_kd", "_kb", "_as", "_bs")

    return dealt(a, "doc_id", "_bin", ("_as", "_ga"), ("_bs", "_gb")), dealt(b, "_doc", "_obin", ("_bs", "_ogb"), ("_as", "_oga"))


def overlaps(spans: DataFrame, others: DataFrame, more: list[str] = (), width: int = BIN, tasks: int | None = None, cut: int | None = None) -> DataFrame:
    """spans with the columns `more` and the places o_ini, o_fim of each other span of the document that overlaps them: a row for each pair.

    Both sides are dealt to the bins that they touch, so one long document is as many join keys as it has bins. A pair that shares several
    bins is told at that of its later start. Work grows with the spans, the bins that they touch, and the pairs. Null places overlap nothing.
    tasks: what both sides are dealt to, where their rows were counted; the session's number otherwise. cut: rows of a side of a bin beyond which it
    falls into groups, each a join key; then neither side is broadcast, and what a task holds for a key is bounded however many spans share a place.
    """
    o = others.select(F.col("doc_id").alias("_doc"), F.col("ini").alias("o_ini"), F.col("fim").alias("o_fim"), *more)
    a = spans.withColumn("_bin", F.explode(_bins(F.col("ini"), F.col("fim"), width)))
    b = o.withColumn("_obin", F.explode(_bins(F.col("o_ini"), F.col("o_fim"), width)))
    keys, others_keys = ["doc_id", "_bin"], ["_doc", "_obin"]
    if cut:
        (a, b), keys, others_keys = _in_groups(a, b, cut), [*keys, "_ga", "_gb"], [*others_keys, "_oga", "_ogb"]
    if tasks:
        a, b = a.repartition(tasks, *keys), b.repartition(tasks, *others_keys)
    if cut:
        b = b.hint("merge")
    met = (F.col("ini") < F.col("o_fim")) & (F.col("fim") > F.col("o_ini"))
    later = F.floor(F.greatest("ini", "o_ini") / width)
    same = reduce(and_, [F.col(k) == F.col(o) for k, o in zip(keys, others_keys)])
    return a.join(b, same & (F.col("_bin") == later) & met).drop(*keys[1:], *others_keys)


def overlapped(spans: DataFrame, others: DataFrame, block: int = BLOCK) -> DataFrame:
    """spans with `_over`: whether another span of the document overlaps them. Rows are kept as they are, repeats too.

    A span is overlapped if, of the others that start ahead of its end, the last end lies behind its start. So it takes no pairs: starts and ends are
    sorted and a running maximum goes by. Documents are cut into blocks, which get the maximum of all blocks ahead, so none is a task of its own.
    """
    rows = spans.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.col("fim").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_end"))
    marks = others.where("ini is not null and fim is not null").select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col("doc_id").alias("_doc"), F.col("ini").alias("_at"), F.lit(1).alias("_side"), F.col("fim").cast("long").alias("_end"))
    every = rows.unionByName(marks).withColumn("_block", F.floor(F.col("_at") / block))
    per = every.where("_side = 1").groupBy("_doc", "_block").agg(F.max("_end").alias("_end"))
    blocks = every.select("_doc", "_block").distinct().join(per, ["_doc", "_block"], "left")  # a row for each block
    ahead = Window.partitionBy("_doc").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("_doc").alias("_d"), F.col("_block").alias("_b"), F.max("_end").over(ahead).alias("_ahead")).where("_ahead is not null")
    here = Window.partitionBy("_doc", "_block").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, -1)
    told = every.withColumn("_here", F.max("_end").over(here)).where("_side = 0")
    told = told.join(blocks, (F.col("_doc") == F.col("_d")) & (F.col("_block") == F.col("_b")), "left")
    over = F.coalesce(F.greatest("_here", "_ahead") > F.col("_row.ini"), F.lit(False))
    return told.withColumn("_over", over).select("_row.*", "_over")


def runs(spans: DataFrame, keys: list[str]) -> DataFrame:
    """spans with `_run`, the start of the run that they are in: spans of the same keys that overlap, or are linked by ones that do."""
    w = Window.partitionBy(*keys).orderBy("ini", "fim")
    ahead = F.max("fim").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = spans.withColumn("_new", F.when(ahead.isNull() | (ahead <= F.col("ini")), F.col("ini")))
    return begins.withColumn("_run", F.last("_new", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
