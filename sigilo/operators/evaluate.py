"""Detection against ground truth: matching, precision and recall, leaks, sequences of labels."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigilo.llm.common import settle, spread

from . import intervals

LEAST = 0.5
#: Rows of truth and detections that a task sorts, joins or goes through: tasks grow with the rows, so a task's memory doesn't.
TASK_ROWS = 400_000
# Types and label suffixes that count as one, and what a token that isn't scored is labelled.
SAME_TIPO = {"ENDERECO": "LOCAL", "LOCAL": "LOCAL", "ORG": "ORGANIZACAO", "PER": "PESSOA"}
SUFFIXES = {"PER": "PESSOA", "PESSOA": "PESSOA", "LOC": "LOCAL", "LOCAL": "LOCAL", "ORG": "ORGANIZACAO", "ORGANIZACAO": "ORGANIZACAO"}
IGNORED = -100


def comparable(tipo: Column) -> Column:
    """The type by which truth and detections are compared."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SAME_TIPO.items() for x in kv])[tipo], tipo)


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two spans share, as a part of the length from the first start to the last end."""
    shared = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, shared / hull).otherwise(F.lit(0.0))


def _settled(spans: DataFrame) -> DataFrame:
    """What is compared of spans, written once: it is read several times, and its rows are counted."""
    return spans if hasattr(spans, "_settled_at") else settle(spans.select("doc_id", "seq", "tipo", "ini", "fim"))


def tasks_for(*tables: DataFrame) -> int:
    """Tasks that the rows of tables, which are files, are dealt to: the session's number, or more where a task would have over TASK_ROWS."""
    return max(spread(tables[0].sparkSession), -(-sum(t.count() for t in tables) // TASK_ROWS))


def match(truth: DataFrame, found: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, gt, det): greedy one-to-one matches of spans (doc_id, seq, tipo, ini, fim).

    In order of the truth, each takes the first free detection of its type (ENDERECO and LOCAL are one) that overlaps enough. The order
    decides, but only among spans that hang together: a document falls into runs of overlapping spans, and each run is gone through by itself.
    Truths and detections of one place are alike, so only distinct places meet, in bins. Each place has its detections in order, and a truth looks at the
    first free one of each place near it: no pair of a truth and a detection is made, however many share a place. Spans without a seq match nothing.
    Both sides are written once and counted; every step is dealt to as many tasks as they need.
    """
    truth, found = _settled(truth), _settled(found)
    tasks = tasks_for(truth, found)
    g = truth.select("doc_id", F.col("seq").cast("long").alias("n"), comparable(F.col("tipo")).alias("tipo"), "ini", "fim", F.lit(2).alias("side"))
    d = found.select("doc_id", F.col("seq").cast("long").alias("n"), comparable(F.col("tipo")).alias("tipo"), "ini", "fim", F.lit(1).alias("side"))
    every = intervals.runs(g.unionByName(d).repartition(tasks, "doc_id", "tipo"), ["doc_id", "tipo"]).where("n is not null and ini is not null and fim is not null and tipo is not null")
    run = ["doc_id", "tipo", "_run"]
    places = every.select("side", *run, "ini", "fim").distinct()
    near = intervals.overlaps(places.where("side = 2").drop("side"), places.where("side = 1").withColumnsRenamed({"tipo": "o_tipo", "_run": "o_run"}), ["o_tipo", "o_run"], tasks=tasks)
    near = near.where("tipo = o_tipo and _run = o_run").where(overlap_ratio(F.col("ini"), F.col("fim"), F.col("o_ini"), F.col("o_fim")) >= least)
    rows = every.select(*run, "side", "n", "ini", "fim", F.lit(None).cast("long").alias("o_ini"), F.lit(None).cast("long").alias("o_fim"))
    rows = rows.unionByName(near.select(*run, F.lit(0).alias("side"), F.lit(None).cast("long").alias("n"), "ini", "fim", F.col("o_ini").cast("long").alias("o_ini"), F.col("o_fim").cast("long").alias("o_fim")))
    dealt = rows.repartition(tasks, *run).sortWithinPartitions(*run, "side", "n")
    return dealt.mapInArrow(_greedy, f"doc_id {dict(truth.dtypes)['doc_id']}, gt long, det long")


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, gt, det) of sorted runs: which places are near (side 0), their detections (1), and the truths (2), each of which takes the first free one."""
    run, near, free, taken, last = None, {}, {}, set(), None
    for b in batches:
        docs, gts, dets = [], [], []
        for k, (doc, tipo, at, side, n, ini, fim, o_ini, o_fim) in enumerate(zip(*(c.to_pylist() for c in b.columns))):
            if (doc, tipo, at) != run:
                run, near, free, taken, last = (doc, tipo, at), {}, {}, set(), None
            if side == 0:
                near.setdefault((ini, fim), []).append(free.setdefault((o_ini, o_fim), deque()))
            elif side == 1:
                if (ini, fim) in free:
                    free[ini, fim].append(n)
            elif n != last:
                best = None
                for queue in near.get((ini, fim), ()):
                    while queue and queue[0] in taken:
                        queue.popleft()
                    if queue and (best is None or queue[0] < best[0]):
                        best = queue
                if best:
                    last = n
                    taken.add(best[0])
                    docs.append(k)
                    gts.append(n)
                    dets.append(best.popleft())
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(docs, pa.int64())), pa.array(gts, pa.int64()), pa.array(dets, pa.int64())], names=["doc_id", "gt", "det"])


def outcomes(truth: DataFrame, found: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, tipo, outcome): TP for each match, FN for truth without one, FP for detections without one."""
    truth, found = _settled(truth), _settled(found)
    tasks, m = tasks_for(truth, found), settle(match(truth, found, least))
    dealt = lambda df: df.repartition(tasks, "doc_id", "seq")
    hit = dealt(truth).join(dealt(m.select("doc_id", F.col("gt").alias("seq"), F.lit("TP").alias("outcome"))), ["doc_id", "seq"], "left")
    lost = dealt(found).join(dealt(m.select("doc_id", F.col("det").alias("seq"))), ["doc_id", "seq"], "left_anti")
    return hit.select("doc_id", "tipo", F.coalesce("outcome", F.lit("FN")).alias("outcome")).unionByName(lost.select("doc_id", "tipo", F.lit("FP").alias("outcome")))


def prf(rows: DataFrame, *keys: str) -> DataFrame:
    """tp, fn, fp, precision, recall and F1 by the keys. Nothing to find or nothing found counts as 1; F1 of 0 and 0 is 0."""
    out = rows.groupBy(*keys).agg(*[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("TP", "FN", "FP")])
    p = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    out = out.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return out.withColumn("f1", f1).withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1")})


def zero_leak(rows: DataFrame) -> DataFrame:
    """Documents, those without a missed entity, and their share."""
    rows = settle(rows.select("doc_id", (F.col("outcome") == "FN").cast("int").alias("fn")))
    per = rows.repartition(tasks_for(rows), "doc_id").groupBy("doc_id").agg(F.sum("fn").alias("fn"))
    return per.agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("fn") == 0).alias("limpos"), F.round(F.avg(F.when(F.col("fn") == 0, 1.0).otherwise(0.0)), 4).alias("taxa"))


def by_source(hits: DataFrame) -> DataFrame:
    """True positives of each detector and their share."""
    n = hits.groupBy("fonte").agg(F.count(F.lit(1)).alias("tp"))
    return n.withColumn("pct", F.round(100 * F.col("tp") / F.sum("tp").over(Window.partitionBy()), 4)).orderBy(F.desc("tp"), "fonte")


def with_truth(docs: DataFrame, truth: DataFrame) -> DataFrame:
    """The documents that have a truth; others are not scored."""
    return docs.join(truth.select("doc_id").distinct(), "doc_id", "left_semi")


def benchmark(docs: DataFrame, truth: DataFrame, found: DataFrame, times: DataFrame | None = None, least: float = LEAST) -> dict[str, DataFrame]:
    """A run over documents (doc_id, text) with a truth: outcomes, measures in all and by type, the sources of the hits, and the summary.

    found: (doc_id, seq, tipo, valor, fonte, ini, fim); a detection of the rules (fonte 'regex') counts at the first place
    of its value in the text, others at their own. times: (doc_id, ms) of each document.
    """
    scored = with_truth(docs, truth)
    text = scored.select("doc_id", "text")
    at = F.expr("locate(valor, text)") - 1
    placed = found.join(text, "doc_id").withColumn("ini", F.when(F.col("fonte") == "regex", at).otherwise(F.col("ini"))).where("ini >= 0")
    placed = placed.withColumn("fim", F.when(F.col("fonte") == "regex", F.col("ini") + F.length("valor")).otherwise(F.col("fim"))).drop("text")
    truth = truth.join(scored.select("doc_id"), "doc_id", "left_semi")
    rows = outcomes(truth, placed, least)
    hits = placed.join(match(truth, placed, least).select("doc_id", F.col("det").alias("seq")), ["doc_id", "seq"], "left_semi")
    return {"outcomes": rows, "total": prf(rows), "by_type": prf(rows, "tipo").orderBy("tipo"), "by_source": by_source(hits), "summary": summary(scored, rows, times)}


def summary(docs: DataFrame, rows: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Documents scored, those without a missed entity, their share, and the mean milliseconds (null without times)."""
    lost = rows.where("outcome = 'FN'").select("doc_id").distinct().withColumn("_lost", F.lit(1))
    per = docs.select("doc_id").distinct().join(lost, "doc_id", "left")
    if times is not None:
        per = per.join(times.groupBy("doc_id").agg(F.avg("ms").alias("ms")), "doc_id", "left")
    ms = F.round(F.avg("ms"), 2) if times is not None else F.lit(None).cast("double")
    clean = F.col("_lost").isNull()
    return per.agg(F.count(F.lit(1)).alias("docs"), F.count_if(clean).alias("limpos"), F.round(F.avg(F.when(clean, 1.0).otherwise(0.0)), 4).alias("taxa"), ms.alias("media_ms"))


def remapped(label: Column, target: list[str]) -> Column:
    """Another model's label in the target scheme: itself if it is one, else prefix and mapped suffix, else O."""
    suffix = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[F.substring(label, 3, 1000)]
    moved = F.concat(F.substring(label, 1, 2), suffix)
    return F.when(label.isin(target), label).when(moved.isin(target), moved).otherwise("O")


def kept_labels(ids: Column, other: Column, names: list[str]) -> Column:
    """Names of the label ids in `other` at the places where `ids` isn't IGNORED. With ids for both, the true labels."""
    at = F.filter(F.arrays_zip(ids.alias("i"), other.alias("o")), lambda x: x["i"] != IGNORED)
    return F.transform(at, lambda x: F.element_at(F.array(*[F.lit(n) for n in names]), x["o"] + 1))


def predicted(rows: DataFrame, predict, names: list[str], schema: str = "doc_id long, janela int, labels array<int>, preds array<int>") -> DataFrame:
    """(doc_id, janela, verdade, previsto): label sequences of batch prediction. predict: a mapInPandas function from rows (doc_id,
    janela, input_ids, attention_mask, labels) to the schema, so that a model loads once in a worker; what is scored stays in the plan."""
    out = rows.mapInPandas(predict, schema)
    return out.select("doc_id", "janela", kept_labels(F.col("labels"), F.col("labels"), names).alias("verdade"), kept_labels(F.col("labels"), F.col("preds"), names).alias("previsto"))


def decode_iob2(tokens: DataFrame, label: str) -> DataFrame:
    """(doc_id, tipo, ini, fim) of the entities of IOB2 labels at (doc_id, i): B opens, I of its type goes on, all else closes; a lone I is none."""
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.sum(F.when(F.startswith(label, F.lit("B-")), 1).otherwise(0)).over(w)
    rows = tokens.select("doc_id", "i", F.col(label).alias("l"), opened.alias("g"))
    inside = Window.partitionBy("doc_id", "g").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    tipo = F.substring(F.first("l").over(inside), 3, 1000)
    rows = rows.where("g > 0").withColumn("tipo", tipo)
    broken = F.max(F.when(F.startswith("l", F.lit("B-")) | (F.col("l") == F.concat(F.lit("I-"), F.col("tipo"))), 0).otherwise(1)).over(inside)
    kept = rows.withColumn("broken", broken).where("broken = 0")
    return kept.groupBy("doc_id", "g", "tipo").agg(F.min("i").alias("ini"), (F.max("i") + 1).alias("fim")).drop("g")


def strict(true: DataFrame, pred: DataFrame) -> DataFrame:
    """Exact span and type: TP, FN and FP rows of decoded entities."""
    key = ["doc_id", "tipo", "ini", "fim"]
    t, p = true.select(*key).distinct(), pred.select(*key).distinct()
    mark = lambda df, o: df.select("doc_id", "tipo", "ini", "fim", F.lit(o).alias("outcome"))
    return mark(t.join(p, key, "left_semi"), "TP").union(mark(missed(t, p), "FN")).union(mark(missed(p, t), "FP"))


def missed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct entities of a that b doesn't have."""
    key = ["doc_id", "tipo", "ini", "fim"]
    return a.select(*key).distinct().join(b.select(*key), key, "left_anti")


def confusion(tokens: DataFrame, labels: list[str]) -> DataFrame:
    """Token counts, a row for each true label and a column for each predicted one, zeros kept."""
    grid = tokens.sparkSession.createDataFrame([(x,) for x in labels], "true string")
    counted = tokens.groupBy("true").pivot("pred", labels).count()
    return grid.join(counted, "true", "left").na.fill(0)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Candidate metrics less baseline's, joined on the metric."""
    return a.withColumnRenamed("valor", "base").join(b.withColumnRenamed("valor", "novo"), "metrica").withColumn("delta", F.round(F.col("novo") - F.col("base"), 4))


def leaking(rows: DataFrame, n: int = 10) -> DataFrame:
    """The first n documents with a missed entity, in their order."""
    return rows.where("outcome = 'FN'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("fn")).orderBy("doc_id").limit(n)
