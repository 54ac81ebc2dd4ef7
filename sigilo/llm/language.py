"""Language of web pages by Bayesian fusion: text likelihood, declared markup language, address suffix, host."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, settle

#: Labelled documents that the text model is fitted on at most, those of the smallest id hashes.
SAMPLE = 20_000
BUCKETS = 1 << 16
#: Weight of the text's log likelihood per trigram, for trigrams aren't independent, and the most that it may count.
TEMPER, MOST = 0.25, 30.0
#: Pseudo-pages of the wider prior that a host, a suffix and a declared language are smoothed with.
HOST, SUFFIX, DECLARED = 5.0, 20.0, 5.0
MARKUP = re.compile(r"<(script|style|noscript|template|head)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)", re.S | re.I)


def grams(text: str) -> np.ndarray:
    """Buckets of the character trigrams of the lower-cased text that hold a letter, digits and signs as gaps."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    c = np.where((c < 128) & ((c < 97) | (c > 122)), 0, c)
    c = np.concatenate([[0], c, [0]])
    x, y, z = c[:-2], c[1:-1], c[2:]
    real = y != 0
    return ((x * 1000003 + y * 8191 + z * 131) * 2654435761 >> 7)[real] % BUCKETS


def _counts(languages: list[str]):
    place = {lang: k for k, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                np.add.at(table[place[lang]], grams(text or ""), 1)
        for k in range(len(languages)):
            at = np.flatnonzero(table[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, dtype=np.int32)), pa.array(at), pa.array(table[k][at])], names=["lang", "bucket", "n"])

    return run


def learn(docs: DataFrame, languages: list[str], sample: int = SAMPLE) -> np.ndarray:
    """log P(trigram | language), hashed: a table of fixed size, from the labelled documents of the sample."""
    known = docs.where(F.col("lang").isin(languages) & F.col("doc_id").isNotNull()).select("doc_id", "lang").distinct()
    chosen = settle(known.orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(sample))  # bounds the broadcast
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), ["doc_id", "lang"])
    counted = rows.select("text", "lang").mapInArrow(_counts(languages), "lang int, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(languages), BUCKETS))
    table[counted.column("lang").to_numpy(), counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return np.log((table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)


def visible(page: str | None) -> str:
    return html.unescape(MARKUP.sub(" ", page or ""))


def _likelihoods(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page in b.column(b.num_columns - 1).to_pylist():
                at = grams(visible(page))
                total = model.value[:, at].sum(axis=1, dtype=np.float64) if len(at) else np.zeros(len(model.value))
                total = total - total.max()
                rows.append(np.maximum(TEMPER * total, -MOST).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], names=[*b.schema.names[:-1], "text_ll"])

    return run


def softmax(log: Column) -> Column:
    """Probabilities of an array of log weights."""
    most = F.array_max(log)
    scaled = F.transform(log, lambda x: F.exp(x - most))
    held = F.array(F.struct(scaled.alias("e"), F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x).alias("sum")))
    return F.transform(held, lambda h: F.transform(h["e"], lambda x: x / h["sum"]))[0]


def _sums(n: int, name: str = "p") -> list[Column]:
    return [F.sum(F.col(name)[k]).alias(f"_{k}") for k in range(n)]


def _array(n: int) -> Column:
    return F.array(*[F.col(f"_{k}") for k in range(n)])


def identify(pages: DataFrame, docs: DataFrame, languages: list[str]) -> DataFrame:
    """page_id, url, host, suffix, declared, text_lang, lang, probability, and the posterior of each language in order.

    P(lang | page) is in proportion to P(lang | host) P(text | lang)^t P(declared | lang). The host's prior is its
    pages' mean text posterior, smoothed by that of its suffix, that by the mean of all pages; a page's own part
    is left out of its host's. P(declared | lang) comes from the pages that declare it. All are grouped sums over all pages.

    Null html has no text, so priors decide; a missing or unknown declaration is 'none' or 'other'; a null or odd
    url has host and suffix ''. Ties go to the language named first. Repeated rows return each. An empty table
    gives none. Extra columns are not looked at. Hosts with a third of all pages are summed before they are shuffled.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    n = len(languages)
    model = spark.sparkContext.broadcast(learn(docs, languages))
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    named = F.lower(F.regexp_extract("html", r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})""", 1))
    declared = F.when(F.coalesce(named, F.lit("")) == "", "none").when(named.isin(languages), named).otherwise("other")
    base = pages.select("page_id", "url", host.alias("host"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"), declared.alias("declared"), "html")
    fields = "page_id long, url string, host string, suffix string, declared string, text_ll array<double>"
    told = settle(base.mapInArrow(_likelihoods(model), fields).withColumn("p", softmax(F.col("text_ll"))))

    hosts = settle(told.groupBy("host", "suffix").agg(F.count(F.lit(1)).alias("n"), *_sums(n)).withColumn("sums", _array(n)).select("host", "suffix", "n", "sums"))
    suffixes = settle(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), *_sums(n, "sums")).withColumn("sums", _array(n)).select(F.col("suffix").alias("_suffix"), F.col("n").alias("_n"), F.col("sums").alias("_sums")))
    world = suffixes.agg(F.sum("_n").alias("n"), *_sums(n, "_sums")).first()
    pages_, whole = float(world["n"] or 0), [float(world[f"_{k}"] or 0.0) for k in range(n)]
    overall = F.array(*[F.lit((w + 1.0) / (pages_ + n)) for w in whole])
    tld = F.transform(F.arrays_zip(F.col("_sums").alias("s"), overall.alias("o")), lambda z: (z["s"] + SUFFIX * z["o"]) / (F.col("_n") + SUFFIX))
    hosts = settle(hosts.join(suffixes, F.col("suffix") == F.col("_suffix")).select(F.col("host").alias("_host"), "n", "sums", tld.alias("tld")))
    rows = told.groupBy("declared").agg(*_sums(n)).collect()  # a row for each language at most, besides 'none' and 'other'
    marks = {r["declared"]: [r[f"_{k}"] for k in range(n)] for r in rows}
    kinds = [*languages, "other", "none"]
    share = {d: [(marks.get(d, [0.0] * n)[k] + DECLARED / len(kinds)) / (sum(m[k] for m in marks.values()) + DECLARED) for k in range(n)] for d in kinds}
    sign = F.create_map(*[c for d in kinds for c in (F.lit(d), F.array(*[F.lit(math.log(x)) for x in share[d]]))])

    at = told.join(hosts, F.col("host") == F.col("_host"))
    prior = F.transform(F.arrays_zip(F.col("sums").alias("s"), F.col("p").alias("p"), F.col("tld").alias("t")), lambda z: (F.greatest(z["s"] - z["p"], F.lit(0.0)) + HOST * z["t"]) / (F.col("n") - 1 + HOST))
    at = at.withColumn("prior", prior).withColumn("mark", sign[F.col("declared")])
    log = F.transform(F.arrays_zip(F.col("text_ll").alias("l"), F.col("mark").alias("m"), F.col("prior").alias("p")), lambda z: z["l"] + z["m"] + F.log(z["p"]))
    at = at.withColumn("posterior", softmax(log))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda a: names[(F.array_position(a, F.array_max(a)) - 1).cast("int")]
    return at.select("page_id", "url", "host", "suffix", "declared", best(F.col("p")).alias("text_lang"), best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("probability"), "posterior")
