"""Training data of taggers: words, IOB2 labels, windows, splits, weights."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigilo.functions import text as T

from . import intervals, spans

LABELS = ["O", "B-PESSOA", "I-PESSOA", "B-ORGANIZACAO", "I-ORGANIZACAO", "B-LOCAL", "I-LOCAL"]
KEPT = ("PESSOA", "ORGANIZACAO", "LOCAL")
IGNORED = -100


def words(docs: DataFrame) -> DataFrame:
    """(doc_id, i, palavra, ini, fim) of the words between white space, with offsets; i counts a text's words from 0."""

    def cut(batches):
        for b in batches:
            rows, at, said, start = [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                for i, m in enumerate(WORD(text or "")):
                    rows.append(k)
                    at.append(i)
                    said.append(m[0])
                    start.append(m.start())
                if len(rows) > 100_000:
                    yield _words(b, rows, at, said, start)
                    rows, at, said, start = [], [], [], []
            yield _words(b, rows, at, said, start)

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, i int, palavra string, ini int, fim int")


WORD = re.compile(r"\S+").finditer


def _words(b: pa.RecordBatch, rows: list[int], at: list[int], said: list[str], start: list[int]) -> pa.RecordBatch:
    ini, said = pa.array(start, pa.int32()), pa.array(said, pa.string())
    columns = [b.column(0).take(pa.array(rows, pa.int32())), pa.array(at, pa.int32()), said, ini, pc.add(ini, pc.utf8_length(said))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "i", "palavra", "ini", "fim"])


def iob2(words_: DataFrame, entities: DataFrame, kept: tuple[str, ...] = KEPT) -> DataFrame:
    """Adds label: words that an entity (doc_id, ent, label, ini, fim) covers by more than half are B (the first) or I; a later entity wins.
    Words and entities meet in bins of places, so a long document takes no more than its words and what covers them."""
    e = entities.where(F.col("label").isin(*kept)).select("doc_id", "ent", F.col("label").alias("tipo"), "ini", "fim")
    shared = F.least("fim", "o_fim") - F.greatest("ini", "o_ini")
    hits = intervals.overlaps(words_.select("doc_id", "i", "ini", "fim"), e, ["ent", "tipo"]).where(shared > 0.5 * (F.col("fim") - F.col("ini")))
    first = hits.groupBy("doc_id", "ent").agg(F.min("i").alias("_first"))
    tagged = hits.join(first, ["doc_id", "ent"]).withColumn("l", F.concat(F.when(F.col("i") == F.col("_first"), "B-").otherwise("I-"), "tipo"))
    won = tagged.groupBy("doc_id", "i").agg(F.max_by("l", "ent").alias("label"))
    return words_.join(won, ["doc_id", "i"], "left").withColumn("label", F.coalesce("label", F.lit("O")))


def windows(tokens: DataFrame, size: int = 510, step: int = 382) -> DataFrame:
    """(doc_id, janela, ini, ids): pieces of the array `ids`; the last is the first that reaches its end."""
    n = F.size("ids")
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: k * step)).otherwise(F.array().cast("array<int>"))
    return tokens.select("doc_id", "ids", F.posexplode(starts).alias("janela", "ini")).select("doc_id", "janela", "ini", F.slice("ids", F.col("ini") + 1, F.lit(size)).alias("ids"))


def padded(ids: Column, width: int, fill: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(F.lit(width) - F.size(ids), F.lit(0))))


def piece_labels(word_ids: Column, labels: Column) -> Column:
    """Labels of sub-words: the first piece of a word keeps its label, others and specials (null word) get IGNORED."""
    return F.transform(word_ids, lambda w, i: F.when(w.isNull() | ((i > 0) & (F.get(word_ids, i - 1) == w)), F.lit(IGNORED)).otherwise(F.get(labels, w)))


def split(docs: DataFrame, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Adds split by the hash of the id, so that a document never moves."""
    h = T.unit_hash(F.col("doc_id").cast("string"))
    return docs.withColumn("split", F.when(h < train, "train").when(h < train + val, "dev").otherwise("test"))


def checked_split(docs: DataFrame, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """split, refused if no document is in train."""
    out = split(docs, train, val)
    if out.where("split = 'train'").isEmpty():
        raise ValueError("no document in train")
    return out


def split_metadata(rows: DataFrame) -> DataFrame:
    """(split, n, docs): how many rows and which documents each split has; the documents go to a file, not to the driver."""
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("doc_id")).alias("docs"))


def preannotated(found: DataFrame, order: list[str | Column] = ("seq",)) -> DataFrame:
    """One entity (doc_id, ini, fim, ...) for each place, the first in the order, by start and end. Where seq repeats, the order must go on."""
    w = Window.partitionBy("doc_id", "ini", "fim").orderBy(*order)
    return found.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k").orderBy("doc_id", "ini", "fim")


def hints_beside(hints: DataFrame, entities: DataFrame) -> DataFrame:
    """Hinted names that no entity of the document overlaps, with the entities. Hints among themselves aren't compared."""
    return spans.ordered_union(entities, spans.overlap_anti(hints, entities))


def label_counts(tokens: DataFrame) -> DataFrame:
    """Counts of each label, zeros kept."""
    grid = tokens.sparkSession.createDataFrame([(k, x) for k, x in enumerate(LABELS)], "id int, label string")
    return grid.join(tokens.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", "left").select("id", "label", F.coalesce("n", F.lit(0)).alias("n"))


def class_weights(counts: DataFrame, boost: float = 3.0) -> DataFrame:
    """Inverse frequency, entities boosted, mean one."""
    c = F.greatest("n", F.lit(1))
    everything = Window.partitionBy()
    raw = counts.withColumn("w", F.sum(c).over(everything) / (F.count(F.lit(1)).over(everything) * c) * F.when(F.col("label") == "O", 1.0).otherwise(boost))
    return raw.select("id", "label", F.round(F.col("w") / F.avg("w").over(everything), 6).alias("peso"))


def argmax(logits: Column) -> Column:
    return F.array_position(logits, F.array_max(logits)) - 1


def valid_annotations(rows: DataFrame) -> DataFrame:
    """Annotated documents (doc_id, text, entities) with the kept labels, their texts taken from the offsets."""
    kept = F.filter("entities", lambda e: e["label"].isin(*KEPT))
    fixed = F.transform(kept, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label"), F.substr(F.col("text"), e["start"] + 1, e["end"] - e["start"]).alias("text")))
    return rows.where("text is not null and entities is not null").withColumn("entities", fixed)
