"""A recogniser of our own: a linear-chain tagger. Spark fits it over shards of labelled lines; Viterbi reads texts in Arrow batches."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import intervals

#: Cells that features are hashed to: what a model weighs, whatever it was fitted on.
CELLS = 1 << 16
#: Cells of lines and words that are read at a time.
AT_ONCE = 1 << 18
WORD = re.compile(r"\S+").finditer
RUNS = re.compile(r"(.)\1+")


class Tagger(NamedTuple):
    """labels: O first, then B-X, I-X. weights: (CELLS, labels). moves: (labels + 1, labels), from a label to the next, the last row to the first word's."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray


def label_set(tipos: list[str]) -> list[str]:
    return ["O", *[f"{p}-{t}" for t in tipos for p in "BI"]]


def allowed(labels: list[str]) -> np.ndarray:
    """0 for moves of IOB2, minus infinity for an I that doesn't go on."""
    before = [*labels, "O"]
    return np.array([[0.0 if b[0] != "I" or a[1:] == b[1:] and a != "O" else -np.inf for b in labels] for a in before])


# Features


def _cell(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}\0{value}".encode("utf-8", "surrogatepass")) % CELLS


@lru_cache(maxsize=200_000)
def _of(word: str) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]:
    """The cells of a word, of it as the word before, and as the word behind."""
    low = word.lower()
    shape = RUNS.sub(r"\1", "".join("0" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word[:40]))
    own = (_cell("word", low), _cell("begin", low[:3]), _cell("end", low[-3:]), _cell("shape", shape), _cell("bias", ""))
    return own, (_cell("before", low), _cell("shape before", shape)), (_cell("behind", low), _cell("shape behind", shape))


def features(words: list[str]) -> np.ndarray:
    """(words, 9) cells."""
    told = [_of(""), *map(_of, words), _of("")]
    return np.array([b[0] + a[1] + c[2] for a, b, c in zip(told, told[1:], told[2:])], dtype=np.int64).reshape(-1, 9)


# Reading


def viterbi(scores: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """The best labels of each line (words, labels), the lower one on ties. Lines go in step, the longest first, as many as fit at a time."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
    order = sorted((k for k in range(len(scores)) if len(scores[k])), key=lambda k: -len(scores[k]))
    n, at = moves.shape[1], 0
    while at < len(order):
        longest = len(scores[order[at]])
        here = order[at : at + max(1, AT_ONCE // longest)]
        at += len(here)
        sizes = np.array([len(scores[k]) for k in here])
        each = np.zeros((longest, len(here), n))
        for j, k in enumerate(here):
            each[: sizes[j], j] = scores[k]
        back = np.zeros((longest, len(here), n), np.int16)
        best = each[0] + moves[-1]
        for t in range(1, longest):
            live = int((sizes > t).sum())
            ways = best[:live, :, None] + moves[None, :-1]
            back[t, :live] = ways.argmax(axis=1)
            best[:live] = ways.max(axis=1) + each[t, :live]
        ends = best.argmax(axis=1)
        for j, k in enumerate(here):
            path = np.empty(sizes[j], np.int64)
            label = ends[j]
            for t in range(sizes[j] - 1, -1, -1):
                path[t] = label
                label = back[t, j, label]
            out[k] = path
    return out


def entities(words: list[re.Match], path: np.ndarray, score: np.ndarray, labels: list[str], ini: int, line: str) -> Iterator[tuple[str, str, int, int, float]]:
    """(tipo, valor, ini, fim, score) of a line's labelled words; punctuation at the ends of a run isn't part of it."""
    k = 0
    while k < len(path):
        if labels[path[k]][0] != "B":
            k += 1
            continue
        end = k + 1
        while end < len(path) and labels[path[end]] == "I" + labels[path[k]][1:]:
            end += 1
        said = line[words[k].start() : words[end - 1].end()]
        start = words[k].start() + len(said) - len(said.lstrip(EDGES))
        said = said.strip(EDGES)
        if said:
            sure = float(np.mean(score[np.arange(k, end), path[k:end]] - score[k:end, 0]))
            yield labels[path[k]][2:], said, ini + start, ini + start + len(said), 1 / (1 + np.exp(-np.clip(sure, -30, 30)))
        k = end


EDGES = ".,;:!?()[]{}<>\"'“”‘’«»"


def recogniser(model: Tagger) -> Callable:
    """The model as a plug-in of `detect.entities_from`: reads each line of a text by itself."""
    moves = model.moves + allowed(model.labels)

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lines, out = [], []

            def read(lines=lines, out=out) -> None:
                words = [list(WORD(line)) for _, _, line in lines]
                scores = [model.weights[features([m[0] for m in w])].sum(axis=1) for w in words]
                for (doc, ini, line), w, s, path in zip(lines, words, scores, viterbi(scores, moves)):
                    out.extend((doc, *e) for e in entities(w, path, s, model.labels, ini, line))
                lines.clear()

            held = 0
            for doc, text in zip(frame["doc_id"], frame["text"]):
                ini = 0
                for line in (text or "").split("\n"):
                    if line.strip():
                        lines.append((doc, ini, line))
                        held += len(line)
                    ini += len(line) + 1
                    if held > AT_ONCE:
                        read()
                        held = 0
            read()
            yield pd.DataFrame(out, columns=["doc_id", "tipo", "valor", "ini", "fim", "score"])

    return extract


# Fitting


def lines(words: DataFrame, text: DataFrame) -> DataFrame:
    """(doc_id, linha, palavras, labels) of labelled words (doc_id, palavra, ini, label) by the lines of their texts (doc_id, text)."""
    cut = text.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("linha", "_said")).select("doc_id", "linha", F.length("_said").alias("_n"))
    ahead = Window.partitionBy("doc_id").orderBy("linha").rowsBetween(Window.unboundedPreceding, -1)
    begun = cut.select("doc_id", "linha", F.coalesce(F.sum(F.col("_n") + 1).over(ahead), F.lit(0)).cast("int").alias("ini"), "_n")
    placed = intervals.overlaps(words.withColumn("fim", F.col("ini") + 1), begun.select("doc_id", "linha", "ini", (F.col("ini") + F.col("_n")).alias("fim")), ["linha"])
    told = F.sort_array(F.collect_list(F.struct("ini", "palavra", "label")))
    return placed.groupBy("doc_id", "linha").agg(told.alias("w")).select("doc_id", "linha", F.col("w.palavra").alias("palavras"), F.col("w.label").alias("labels"))


def _pass(model: Tagger) -> Callable:
    """A pass of the structured perceptron over each shard (shard, palavras, labels), from the model's weights on: what it adds to each cell."""
    legal, number = allowed(model.labels), {x: k for k, x in enumerate(model.labels)}
    n = len(model.labels)

    def told(shard: int, added: np.ndarray, moved: np.ndarray) -> pa.RecordBatch:
        flat = np.concatenate([added.ravel(), moved.ravel()])
        cells = np.flatnonzero(flat)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), shard), pa.int32()), pa.array(cells), pa.array(flat[cells])], names=["shard", "cell", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = added = moved = None
        for b in batches:
            for here, words, labels in zip(*(b.column(i).to_pylist() for i in range(3))):
                if here != shard:
                    if shard is not None:
                        yield told(shard, added, moved)
                    shard, added, moved = here, np.zeros((CELLS, n), np.int64), np.zeros((n + 1, n), np.int64)
                cells, gold = features(words), np.array([number.get(x, 0) for x in labels])
                score = model.weights[cells].sum(axis=1) + added[cells].sum(axis=1)
                path = viterbi([score], model.moves + moved + legal)[0]
                if (path == gold).all():
                    continue
                for labels_, by in ((gold, 1), (path, -1)):
                    np.add.at(added, (cells, labels_[:, None]), by)
                    np.add.at(moved, (np.concatenate([[n], labels_[:-1]]), labels_), by)
        if shard is not None:
            yield told(shard, added, moved)

    return run


def fit(rows: DataFrame, tipos: list[str], shards: int = 8, epochs: int = 6) -> Tagger:
    """A tagger of labelled lines (doc_id, linha, palavras, labels) by the averaged structured perceptron with mixed parameters.

    In each epoch every shard goes once over its lines from the common weights on; what the shards added, whole numbers, is
    summed by Spark, and its mean is added. The model is the mean of the epochs' weights. Shards are hashes of line and document, read in
    order, so the same rows give the same weights, however they are dealt. At most CELLS x labels sums reach the driver, and the weights the workers:
    the bound doesn't grow with the rows. Unknown labels count as O.
    """
    labels = label_set(tipos)
    n = len(labels)
    model = Tagger(labels, np.zeros((CELLS, n)), np.zeros((n + 1, n)))
    shard = F.pmod(F.xxhash64("doc_id", "linha"), F.lit(shards)).cast("int")
    dealt = rows.select(shard.alias("shard"), "palavras", "labels", "doc_id", "linha").repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "linha").persist()
    total = [np.zeros_like(model.weights), np.zeros_like(model.moves)]
    try:
        for _ in range(epochs):
            added = dealt.select("shard", "palavras", "labels").mapInArrow(_pass(model), "shard int, cell long, n long")
            sums = added.groupBy("cell").agg(F.sum("n").alias("n")).where("n <> 0").toArrow()
            flat = np.zeros(model.weights.size + model.moves.size)
            flat[sums.column("cell").to_numpy()] = sums.column("n").to_numpy() / shards
            weights, moves = flat[: model.weights.size].reshape(-1, n), flat[model.weights.size :].reshape(-1, n)
            model = Tagger(labels, model.weights + weights, model.moves + moves)
            total = [total[0] + model.weights, total[1] + model.moves]
    finally:
        dealt.unpersist()
    return Tagger(labels, total[0] / epochs, total[1] / epochs)


def to_table(spark: SparkSession, model: Tagger) -> DataFrame:
    """(linha, label, peso): the weights that aren't 0; lines from CELLS on are the moves."""
    every = np.concatenate([model.weights, model.moves])
    at, label = np.nonzero(every)
    rows = pd.DataFrame({"linha": at, "label": [model.labels[k] for k in label], "peso": every[at, label]})
    return spark.createDataFrame(rows, "linha long, label string, peso double")


def from_table(rows: DataFrame, tipos: list[str]) -> Tagger:
    labels = label_set(tipos)
    every = np.zeros((CELLS + len(labels) + 1, len(labels)))
    for r in rows.toLocalIterator():
        every[r.linha, labels.index(r.label)] = r.peso
    return Tagger(labels, every[:CELLS], every[CELLS:])
