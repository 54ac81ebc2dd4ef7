"""Benchmark decontamination: a BM25 index of test items, searched by every passage with block-max WAND, then verified."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, settle

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that a passage must reach to be retrieved.
RETRIEVE = 0.6
#: Least shares of the question's words that the passage has in their order, and of the answer's words (rounded down to whole
#: words, one at least), that make a leak, where the passage shares a shingle of so many words with the item. A changed word
#: so costs itself and not the five shingles that it is in.
QUESTION, ANSWER, SHINGLE = 0.8, 0.8, 5
#: Items and text bytes of one index, and indexes that are broadcast together. A larger benchmark takes several rounds over
#: the texts, so what is broadcast and collected at a time stays bounded.
INDEX_ITEMS, INDEX_BYTES, TOGETHER = 512, 1 << 20, 32
#: Items of a block of the index; words whose block sums are held at a time.
BLOCK, CHUNK = 8, 1 << 15
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def parts(text: str) -> tuple[list[str], list[str]]:
    """Question and answer of an item: the last sentence answers if there is one before it, else the last quarter of the words."""
    sentences = [w for w in (words_of(s) for s in re.split(r"(?<=[.!?])\s+|\n+", text)) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - max(1, len(words) // 4) if words else 0
    return words[:cut], words[cut:]


def inverse_frequency(n: int, items: int) -> float:
    return math.log(1 + (items - n + 0.5) / (n + 0.5))


class Index:
    """Inverted index with impacts: a term's BM25 weight in an item as a share of the item's own score.

    Items go by length, in blocks of BLOCK; a block has the largest impact of each term in it.
    """

    def __init__(self, items: list[tuple[int, str]], idf: dict[str, float] | None = None, mean: float | None = None):
        """idf, mean: of the whole benchmark, if the items are a part of it."""
        held = [(i, words_of(t), parts(t)) for i, t in items if t and words_of(t)]
        self.items = sorted(held, key=lambda x: len(x[1]))
        counts = [Counter(w) for _, w, _ in self.items]
        seen = Counter(t for c in counts for t in c)
        if idf is None:
            mean = sum(len(w) for _, w, _ in self.items) / max(len(self.items), 1)
            idf = {t: inverse_frequency(n, len(counts)) for t, n in seen.items()}
        self.terms = {t: k for k, t in enumerate(seen)}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        blocks = -(-len(self.items) // BLOCK)
        self.block_most = np.zeros((len(self.terms) + 1, blocks))  # the last row: words that no item has
        for k, c in enumerate(counts):
            norm = K1 * (1 - B + B * len(self.items[k][1]) / mean)
            weight = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in c.items()}
            own = sum(weight.values())
            for t, w in weight.items():
                at = self.terms[t]
                postings[at].append((k, w / own))
                self.block_most[at, k // BLOCK] = max(self.block_most[at, k // BLOCK], w / own)
        self.docs = [[k for k, _ in p] for p in postings]
        self.impacts = [[w for _, w in p] for p in postings]
        self.longest = [len(self.items[min((b + 1) * BLOCK, len(self.items)) - 1][1]) for b in range(blocks)]

    def search(self, terms: list[int], block: int, least: float) -> list[tuple[int, float]]:
        """All items of the block whose score for these distinct terms is `least` or more, by WAND with the block's bounds."""
        begin, end = block * BLOCK, (block + 1) * BLOCK
        most, out, lists = self.block_most, [], []
        for t in terms:
            if most[t, block] > 0:
                lists.append([bisect_left(self.docs[t], begin), t])
        while True:
            lists = [x for x in lists if x[0] < len(self.docs[x[1]]) and self.docs[x[1]][x[0]] < end]
            lists.sort(key=lambda x: self.docs[x[1]][x[0]])
            bound, pivot = 0.0, -1
            for k, (_, t) in enumerate(lists):
                bound += most[t, block]
                if bound >= least - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = self.docs[lists[pivot][1]][lists[pivot][0]]
            if self.docs[lists[0][1]][lists[0][0]] < item:  # what lies ahead of the pivot can't reach the threshold
                for x in lists[:pivot]:
                    x[0] = bisect_left(self.docs[x[1]], item, x[0])
                continue
            score = 0.0
            for x in lists:
                if self.docs[x[1]][x[0]] == item:
                    score += self.impacts[x[1]][x[0]]
                    x[0] += 1
            if score >= least - 1e-9:
                out.append((item, score))

    def leaks(self, words: list[str], edges: np.ndarray) -> list[dict[int, tuple[float, float, float]]]:
        """For each text {item: (score, question share, answer share)} of the items that it holds, by the best passage.

        words: of all texts, one after the other; edges: where each text ends. For a block of items, a passage begins at every
        quarter of its longest item, counted from the text's first word, and is half as long again, so an item with some words
        put in lies within one. The sums of the words' block maxima, for all passages at once, show which (passage, block) can
        reach the threshold; those are searched.
        """
        found: list[dict[int, tuple[float, float, float]]] = [{} for _ in edges]
        if not self.items or not words:
            return found
        get, none = self.terms.get, len(self.terms)
        ids = np.array([get(w, none) for w in words], dtype=np.int64)
        begins = np.concatenate([[0], edges[:-1]])
        reach = max(self.longest) * 2
        for at in range(0, len(ids), CHUNK):
            chunk = min(CHUNK, len(ids) - at)
            sums = np.zeros((min(chunk + reach, len(ids) - at) + 1, len(self.longest)))
            np.cumsum(self.block_most[ids[at : at + chunk + reach]], axis=0, out=sums[1:])
            first, last = np.searchsorted(edges, at, side="right"), np.searchsorted(begins, at + chunk, side="left")
            begin, end = begins[first:last], edges[first:last]
            for block, longest in enumerate(self.longest):
                step = max(1, longest // 4)
                width = longest + 2 * step
                low = np.maximum(0, -(-(at - begin) // step))  # the numbers of the passages that begin in this chunk, by text
                n = np.maximum(0, -(-(np.minimum(end, at + chunk) - begin) // step) - low)
                text = np.repeat(np.arange(len(n)), n)
                starts = begin[text] + (low[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * step
                stops = np.minimum(starts + width, end[text])
                hit = sums[stops - at, block] - sums[starts - at, block] >= RETRIEVE - 1e-6
                for a, b, t in zip(starts[hit].tolist(), stops[hit].tolist(), (text[hit] + first).tolist()):
                    self._passage(block, ids[a:b], words[a:b], found[t])
        return found

    def _passage(self, block: int, ids: np.ndarray, words: list[str], found: dict) -> None:
        terms = [t for t in set(ids.tolist()) if t < len(self.terms)]
        if self.block_most[terms, block].sum() >= RETRIEVE - 1e-9:
            for item, score in self.search(terms, block, RETRIEVE):
                question, answer = self.verify(item, words)
                if question >= QUESTION and answer >= self.needed(item):
                    found[item] = max(found.get(item, (0.0,)), (score, question, answer))

    def needed(self, item: int) -> float:
        """The least share of an item's answer: ANSWER of its words, rounded down to a whole word, one at least."""
        n = len(self.items[item][2][1])
        return max(1, int(ANSWER * n + 1e-9)) / n if n else 0.0

    def verify(self, item: int, passage: list[str]) -> tuple[float, float]:
        """The shares of the question's words that the passage has in their order, and of the answer's words that are in it;
        none of the question where the passage has no shingle of the item."""
        question, answer = self.items[item][2]
        width, whole = min(SHINGLE, len(question) + len(answer)), question + answer
        had = {tuple(passage[i : i + width]) for i in range(len(passage) - width + 1)}
        anchored = any(tuple(whole[i : i + width]) in had for i in range(len(whole) - width + 1))
        need, there = Counter(answer), Counter(passage)
        asked = common_in_order(question, passage) / len(question) if question else 1.0
        return (asked if anchored else 0.0, sum(min(n, there[w]) for w, n in need.items()) / max(len(answer), 1))


def common_in_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit for each word of a (Hyyro, 2004)."""
    places: dict[str, int] = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    every = (1 << len(a)) - 1
    row = every
    for w in b:
        met = row & places.get(w, 0)
        row = (row + met | row - met) & every
    return len(a) - row.bit_count()


def search(indexes: list[Index], texts: list[str]) -> list[list[tuple[int, float, float, float]]]:
    """For each text, (item_id, score, question share, answer share) of the items of all indexes that it holds. Texts are cut into words once."""
    words: list[str] = []
    ends = []
    for t in texts:
        words += words_of(t)
        ends.append(len(words))
    out: list[list] = [[] for _ in texts]
    for index in indexes:
        for held, found in zip(out, index.leaks(words, np.array(ends, dtype=np.int64))):
            held += [(index.items[k][0], *v) for k, v in sorted(found.items())]
    return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, term) of the distinct terms of each item, and (piece, null) once an item with its number of words."""
    for b in batches:
        rows = []
        for piece, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = words_of(text)
            rows += [(piece, t, 1) for t in set(words)] + ([(piece, None, len(words))] if words else [])
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["piece", "term", "n"])


def indexes(spark: SparkSession, benchmark: DataFrame) -> Iterator:
    """Broadcast lists of indexes over the benchmark, of INDEX_ITEMS items each, TOGETHER of them at most in a list.

    Counts, inverse frequencies and the mean length are taken over all items, so scores don't depend on the pieces.
    Items without a word are in none.
    """
    items = benchmark.select("item_id", "text").where("text is not null").dropDuplicates(["item_id", "text"])
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    pieces = max(1, -(-n // INDEX_ITEMS), -(-size // INDEX_BYTES))
    items = settle(items.withColumn("piece", F.pmod(F.xxhash64("item_id", "text"), F.lit(pieces))))
    terms = settle(items.select("piece", "text").mapInArrow(_terms, "piece long, term string, n long"))
    n, length = terms.where("term is null").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = settle(terms.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")))
    for at in range(0, pieces, TOGETHER):
        mine = F.col("piece").between(at, at + TOGETHER - 1)
        own = terms.where(mine & F.col("term").isNotNull()).select("term").distinct().join(counts, "term").toArrow()
        idf = {t: inverse_frequency(k, n) for t, k in zip(own.column("term").to_pylist(), own.column("n").to_pylist())}
        rows = items.where(mine).collect()
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        held = [Index([(r["item_id"], r["text"]) for r in rows if r["piece"] == k], idf, length / max(n, 1)) for k in range(at, min(at + TOGETHER, pieces))]
        yield spark.sparkContext.broadcast([index for index in held if index.items])


HIT = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())])


def _annotator(index, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            found = [[dict(zip(("item_id", "score", "question", "answer"), h)) for h in x] for x in search(index.value, texts)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(HIT))], names=[*b.schema.names[:-1], name])

    return run


def annotate(docs: DataFrame, benchmark: DataFrame, name: str = "leaks") -> DataFrame:
    """docs with an array column of the benchmark items that each text holds: item_id, score, question, answer.

    Every document is searched by all its passages, where it lies, without a shuffle. Null and empty texts hold
    none; an empty benchmark is held by none. Ties and repeated rows return each. An existing column `name` is replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = [c for c in docs.columns if c != name]
    out = docs.select(*kept, F.expr("cast(null as array<struct<item_id: bigint, score: double, question: double, answer: double>>)").alias(name))
    hits, text = fresh("_hits", out), fresh("_text", out)
    for turn, index in enumerate(indexes(spark, benchmark)):
        if turn:
            out = settle(out)  # one list of indexes is searched at a time
        fields = ", ".join(f"`{n}` {t}" for n, t in out.dtypes) + f", `{hits}` array<struct<item_id: bigint, score: double, question: double, answer: double>>"
        found = out.select("*", F.col("text").alias(text)).mapInArrow(_annotator(index, hits), fields)
        out = found.withColumn(name, F.concat(name, hits) if turn else F.col(hits)).drop(hits)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question, answer): a row for each item that a document holds."""
    found = annotate(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("leaks").alias("hit")).select("doc_id", "hit.item_id", "hit.score", "hit.question", "hit.answer")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, in the columns given."""
    name = fresh("_leaks", docs)
    return annotate(docs, benchmark, name).where(F.size(name) == 0).drop(name)
