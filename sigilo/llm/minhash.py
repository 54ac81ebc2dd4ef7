"""Document fingerprints by one-permutation MinHash, densified, packed to low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, settle, spread

BINS, BITS, WORDS = 256, 8, 5
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift steps): every output bit depends on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def probes(rounds: int = 64) -> np.ndarray:
    """probes[r][bin]: the bin that an empty bin looks into in its r-th try, from one universal hash of (bin, r)."""
    at = np.arange(rounds, dtype=np.uint64)[:, None] * np.uint64(BINS) + np.arange(BINS, dtype=np.uint64)[None, :]
    return (mixed(at + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int64)


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes of the word shingles of the lower-cased text: the whole sequence for too few words, none for no word."""
    parts = text.lower().encode("utf-8", "surrogatepass").split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    width = min(words, len(h))
    out = np.zeros(len(h) - width + 1, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B185EBCA87) + h[k : len(h) - width + 1 + k]
    return mixed(out)


def fingerprint(text: str) -> bytes:
    """BINS packed bytes, the low bits of each bin's smallest hash; empty for a text without words."""
    h = shingle_hashes(text)
    if not len(h):
        return b""
    least = np.full(BINS, NONE)
    np.minimum.at(least, (h >> np.uint64(56)).astype(np.int64), h)
    empty = np.flatnonzero(least == NONE)
    if len(empty):
        filled = least.copy()
        for tried in probes():
            found = least[tried[empty]]
            filled[empty] = np.where(found == NONE, filled[empty], found)
            empty = empty[found == NONE]
            if not len(empty):
                break
        for k in empty:  # after 64 tries: the next full bin, so that every bin is filled
            full = np.flatnonzero(least != NONE)
            filled[k] = least[full[np.searchsorted(full, k) % len(full)]]
        least = filled
    return mixed(least).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of the shingle sets: the share of equal bins, less what BITS bits match by chance."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    equal = float(np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8))) / BINS
    chance = 1 / (1 << BITS)
    return max(0.0, (equal - chance) / (1 - chance))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
FIELDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and place; the last of a bucket is a copy of the row that follows it, and only read."""
    before, out = None, []
    for b in batches:
        for bucket, last, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            here = (bucket, doc_id, text or "", fingerprint(text or ""))
            if before is not None and before[0] == bucket:
                _, left, own, print_ = before
                changed = edited(own, here[2])
                other = fingerprint(changed)
                digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((left, len(own), digest, print_.hex(), other.hex(), likeness(print_, other), likeness(print_, here[3])))
            before = None if last else here
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), FIELDS)], schema=FIELDS)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), FIELDS)], schema=FIELDS)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how like its fingerprint is to the edited and the next one's.

    The order is by doc_id, nulls first, then by text hash; after the last document comes the first. Documents
    are cut into ranges of doc_id; each range also gets a copy of the row that follows it, so neighbours meet in
    one task and no task has more than a range. Null texts are empty; an empty fingerprint is like another empty one only.
    Repeated rows follow each other. A single row follows itself. An empty table gives none. Extra columns are not looked at.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = spread(spark)
    ids = settle(docs.select("doc_id", F.xxhash64("text").alias("tie"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").withColumn("bucket", F.spark_partition_id()))
    key = F.struct(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), "tie")
    bounds = ids.groupBy("bucket").agg(F.min(key).alias("first")).orderBy("bucket").collect()  # a row for each partition
    if not bounds:
        return spark.createDataFrame([], OUT)
    firsts = [tuple(r["first"]) for r in bounds]
    lit = lambda k: F.struct(F.lit(bool(k[0])), F.lit(k[1]).cast("long"), F.lit(k[2]).cast("long"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).withColumn("_key", key)
    table = F.array(*[lit(k) for k in firsts])  # one literal, a key for each partition
    steps = F.array(*[F.lit(1 << k) for k in range(len(firsts).bit_length() - 1, -1, -1)])
    further = lambda at, step: F.when((at + step <= len(firsts)) & (F.get(table, at + step - 1) <= F.col("_key")), at + step).otherwise(at)
    rows = rows.withColumn("bucket", F.aggregate(steps, F.lit(0), further) - 1)  # by halving
    first = F.col("_key") == F.element_at(table, F.col("bucket") + 1)
    before = (F.col("bucket") + F.lit(len(firsts) - 1)) % F.lit(len(firsts))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("last"))
    copy = F.struct(before.cast("int").alias("bucket"), F.lit(True).alias("last"))
    dealt = rows.select(F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own))).alias("at"), "doc_id", "text", "_key")
    dealt = dealt.select("at.bucket", "at.last", "doc_id", "text", "_key").repartition(n, "bucket").sortWithinPartitions("bucket", "last", "_key")
    return dealt.select("bucket", "last", "doc_id", "text").mapInArrow(_neighbours, OUT)

