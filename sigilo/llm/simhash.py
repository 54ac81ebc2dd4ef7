"""Near copies by SimHash: fingerprints meet on keys made of an exact block and a decoded Golay codeword."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import bounded_batches, buckets, components, fresh, scratch, settle, similar_classes, small

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Generator of the binary Golay code of length 23: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
BLOCK, HALF = 16, 24


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the lower-cased words' shingles; 0 for no word, the whole sequence for too few."""
    words = (text or b"").translate(LOWER).split()  # bytes split on space and 09 to 0D only
    if not words:
        return 0
    n = len(words)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    hashed = xxhash.xxh64_intdigest
    if n < shingle:
        hashes = [hashed(joined, seed)]
    else:
        hashes = [hashed(joined[a:b], seed) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    h = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the 23 bits; by syndrome, the error of weight 3 at most and the index offsets of all codewords within 3, or, for a word 3 away from its own, within 4."""

    def remainder(word: int) -> int:
        for k in range(22, 10, -1):
            if word >> k & 1:
                word ^= GOLAY << (k - 11)
        return word

    unit = np.array([remainder(1 << k) for k in range(23)], dtype=np.int64)
    words = [w << 11 | remainder(w << 11) for w in range(4096)]
    sevens = [w for w in words if w.bit_count() == 7]
    error, offsets = np.zeros(2048, dtype=np.int64), np.full((2048, 6), -1, dtype=np.int64)
    offsets[:, 0] = 0
    for weight in range(4):
        for at in combinations(range(23), weight):
            e = sum(1 << k for k in at)
            s = int(np.bitwise_xor.reduce(unit[list(at)])) if at else 0
            error[s] = e
            if weight == 3:
                offsets[s, 1:] = [w >> 11 for w in sevens if w & e == e]
    return unit, error, offsets


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """Up to six 12-bit codeword indices of each 23-bit word (-1: none). Words that differ in one bit share one.

    A word up to 2 from its codeword decodes like its neighbours. One at 3 may have a neighbour that decodes
    elsewhere, to a codeword at 4 from it: there are five of those, and it takes their indices too.
    """
    unit, error, offsets = golay()
    syndrome = np.zeros(len(words), dtype=np.int64)
    for k in range(23):
        syndrome ^= np.where(words >> k & 1, unit[k], 0)
    own = (words ^ error[syndrome]) >> 11
    more = offsets[syndrome]
    return np.where(more < 0, -1, own[:, None] ^ more)


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every key of 64-bit fingerprints; two within 3 bits share one at least.

    Of four 16-bit blocks one is without error; of the two halves of the other 48 bits one has an error at
    most, so it decodes to a shared codeword. A key is the block's number and value, the half and the codeword.
    """
    rows, keys = [], []
    for block in range(4):
        by = np.uint64(block * BLOCK)
        turned = fingerprints if block == 0 else (fingerprints << by) | (fingerprints >> (np.uint64(64) - by))
        exact = (turned >> np.uint64(48)).astype(np.int64)
        for half in range(2):
            word = ((turned >> np.uint64(half * HALF)) & np.uint64((1 << 23) - 1)).astype(np.int64)
            index = codeword_indices(word)
            row, at = np.nonzero(index >= 0)
            rows.append(row)
            keys.append(((block * 2 + half) << 28) | exact[row] << 12 | index[row, at])
    return np.concatenate(rows), np.concatenate(keys)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).cast(pa.binary()).to_pylist()
        fp = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(fp), 4096):
            part = fp[at : at + 4096]
            row, key = keys_of(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "fp"])


def _block_bits(x: Column, block: int) -> Column:
    return F.shiftrightunsigned(x, 64 - BLOCK * (block + 1)).bitwiseAND((1 << BLOCK) - 1)


def links(fingerprints: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at most `distance` (3 at most) bits apart, from a column `fp` without repeats.

    A pair is told once for the first block it shares, whatever keys it meets on; the join's condition says so.
    Large keys are split by the adaptive skewed join. Sides are always shuffled: the optimizer takes them for about as large as the fingerprints,
    and would send all the keys of those, 42 and more each, through the driver.
    """
    if distance > 3:
        raise ValueError("the keys hold for 3 differing bits at most")
    keys = fingerprints.select("fp").mapInArrow(_keys, "key long, fp long")
    left, right = keys.withColumnRenamed("fp", "a"), keys.withColumnRenamed("fp", "b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    first = F.when(_block_bits(x, 0) == 0, 0).when(_block_bits(x, 1) == 0, 1).when(_block_bits(x, 2) == 0, 2).otherwise(3)
    met = (F.col("a") < F.col("b")) & (F.bit_count(x) <= distance) & (F.shiftright("key", 29) == first)
    return left.hint("merge").join(right, "key").where(met).select("a", "b").distinct()


def near_copies(docs: DataFrame, distance: int = 3) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for each row of docs (doc_id, text); component_id is the smallest
    doc_id that links reach from the row's fingerprint, itself included.

    Equal fingerprints count once, so copies add rows to a count and nothing to the join. Null and empty texts
    have fingerprint zero and link like any other. A null doc_id is the smallest of no class with another one;
    a class of nulls has a null component. Repeated rows return each. Extra columns are not looked at.
    """
    bounded_batches(docs.sparkSession)
    with scratch() as keep:
        rows = keep(settle(docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")))
        fps = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
        member = components(links(fps, distance))
        named = settle(fps.join(member.withColumnRenamed("node", "fp"), "fp").select("fp", "component", "least"))
        least = settle(named.groupBy("component").agg(F.min("least").alias("component_id")))
        linked = settle(named.join(least, "component").select("fp", "component_id"))
        classes = keep(settle(fps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))))
    return rows.join(classes, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Bands of the signature and bins of a band that make a candidate, and the least similarity.
BANDS, ROWS, SIMILAR = 36, 7, 0.8
#: Low-order bits of a bin that estimates compare.
LOW = 4
#: How far from SIMILAR an estimate must be to decide by itself: three standard errors. Nearer ones are decided by the texts.
MARGIN = 3 * (SIMILAR * (1 - SIMILAR) / minhash.BINS) ** 0.5 / (1 - 2**-LOW)
#: The band of texts without words, which have no bins.
WORDLESS = BANDS


def band_keys(signatures: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every band of every signature: the band's number and its bins, exactly; one key for a text without words.

    Two signatures whose bins are equal with probability s share a key with 1 - (1 - s^7)^36: 0.9998 at 0.8, 0.9987 at 0.775.
    """
    full = np.array([i for i, s in enumerate(signatures) if s], dtype=np.int64)
    bare = np.array([i for i, s in enumerate(signatures) if not s], dtype=np.int64)
    bins = np.frombuffer(b"".join(signatures), np.uint8).reshape(-1, minhash.BINS)[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.int64), bins.shape[:2]).copy()
    for k in range(ROWS):
        key = key << np.int64(8) | bins[:, :, k].astype(np.int64)
    return np.concatenate([np.repeat(full, BANDS), bare]), np.concatenate([key.ravel(), np.full(len(bare), WORDLESS << 8 * ROWS, dtype=np.int64)])


#: The signature as columns: the LOW bits of its bins in words of 64 bits, 0 for texts without words, which `bare` marks.
SIGNED = ["id", "bare", *[f"w{k}" for k in range(minhash.BINS * LOW // 64)]]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        signed = [minhash.fingerprint(t or "") for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(signed, pa.binary())], names=["doc_id", "id", "signature"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        signed = b.column(1).to_pylist()
        bins = np.frombuffer(b"".join(x or bytes(minhash.BINS) for x in signed), np.uint8).reshape(len(signed), -1)
        low = (bins[:, ::2] << np.uint8(LOW)) | (bins[:, 1::2] & np.uint8((1 << LOW) - 1))  # two bins a byte
        words = np.ascontiguousarray(low).view(np.int64)
        bare = pa.array([int(not x) for x in signed], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), bare, *[pa.array(w) for w in np.ascontiguousarray(words.T)]], names=SIGNED)


def differing(left, right) -> Column:
    """The number of bins whose low bits differ; of a text without words only another such is a copy."""

    def unlike(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(0x1111111111111111))

    apart = sum((unlike(left(w).bitwiseXOR(right(w))) for w in SIGNED[2:]), F.lit(0))
    return F.when(left("bare") != right("bare"), F.lit(minhash.BINS)).otherwise(apart).cast("int")


def most_differing(similarity: float) -> int:
    """The bins that differ at most where the estimated similarity is so high."""
    return int(minhash.BINS * (1 - 2**-LOW) * (1 - similarity) + 1e-9)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, signed = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
        for at in range(0, len(ids), 2048):
            row, key = band_keys(signed[at : at + 2048])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[at : at + 2048][row])], names=["key", "id"])


def similarity(a: str, b: str) -> float:
    """Jaccard similarity of the texts' five-word shingles."""
    x, y = (set(minhash.shingle_hashes(t).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [similarity(x, y) >= SIMILAR for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def text_id() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def similar_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, id, component_id): classes of texts whose five-word shingles have a similarity of 0.8 or more.

    Candidates share a band of their 256-bin MinHash signatures, whatever kind of edit sets them apart. The similarity that
    the whole signatures tell decides where it is three standard errors (0.08) or more from 0.8; candidates nearer to it are
    decided by the shingles of their texts. Equal texts count once (id: their 64-bit hash). Null texts are empty; empty texts
    are copies of each other. component_id is the smallest doc_id of the class, null for a class without one.
    """
    bounded_batches(docs.sparkSession)
    with scratch() as keep:
        rows = keep(settle(_classes(docs)))
    return rows


def _classes(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", text_id().alias("id"), "text")
    rows = settle(rows.mapInArrow(_signatures, "doc_id long, id long, signature binary"))
    texts = settle(rows.groupBy("id").agg(F.first("signature").alias("signature"), F.min("doc_id").alias("least")))
    shared = buckets(texts.select("id", "signature").mapInArrow(_band_rows, "key long, id long"))
    involved = settle(shared.select("id").distinct())
    signed = texts.join(small(involved), "id", "left_semi").select("id", "signature")
    loads = settle(signed.mapInArrow(_words, ", ".join(f"{c} long" for c in SIGNED)))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs)
        sure = pairs.where(F.col("score") <= most_differing(SIMILAR + MARGIN)).select("a", "b")
        close = pairs.where(F.col("score") > most_differing(SIMILAR + MARGIN))
        wanted = settle(close.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        said = docs.select(text_id().alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(small(wanted), "id", "left_semi")
        said = settle(said.groupBy("id").agg(F.first("text").alias("text")))
        x, y = said.toDF("a", "x"), said.toDF("b", "y")
        return sure.union(close.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long"))

    member = similar_classes(shared, loads, differing, most_differing(SIMILAR - MARGIN), verify)
    named = settle(texts.select("id", "least").join(member, "id", "left").select("id", F.coalesce("class", "id").alias("class"), "least"))
    least = settle(named.groupBy("class").agg(F.min("least").alias("component_id")))
    classes = settle(named.join(least, "class").select("id", "class", "component_id"))
    return rows.select("doc_id", "id").join(classes, "id").select("doc_id", "id", "class", "component_id")


def near_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, id, class) of each row of docs (doc_id, text): id is the 64-bit hash of its text, class the fingerprint that stands
    for all which links of `near_copies` reach."""
    rows = settle(docs.select("doc_id", text_id().alias("id"), "text").mapInArrow(_fingerprinted, "doc_id long, id long, fp long"))
    member = components(links(settle(rows.select("fp").distinct())))
    return rows.join(member.withColumnRenamed("node", "fp"), "fp", "left").select("doc_id", "id", F.coalesce("component", "fp").alias("class"))


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t) for t in b.column(2).cast(pa.binary()).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "id", "fp"])


def keep_one(docs: DataFrame, classes: Callable[[DataFrame], DataFrame] = _classes) -> DataFrame:
    """One document of each class, of similar texts or of those that `classes` tells, in the columns given: that of the smallest (doc_id, text hash).

    Rows are told apart by doc_id and text, so a doc_id with two texts is two documents; of rows that are equal in both
    one stays. Rows without a doc_id can't be told apart by it: they stay.
    """
    at, text = fresh("_id", docs), fresh("_said", docs)
    bounded_batches(docs.sparkSession)
    with scratch() as keep:
        found = settle(classes(docs))
        found = found.where("doc_id is not null")
        place = F.struct("doc_id", "id")
        best = settle(found.groupBy("class").agg(F.min(place).alias("best")))
        marked = settle(found.groupBy("doc_id", "id", "class").agg(F.count(F.lit(1)).alias("n")).join(best, "class"))
        chosen = F.col("best") == place
        named = [F.col("doc_id").alias(at), F.col("id").alias(text)]
        gone = keep(settle(marked.where(~chosen).select(*named)))
        twins = keep(settle(marked.where(chosen & (F.col("n") > 1)).select(*named)))
    same = (F.col("doc_id") == F.col(at)) & (text_id() == F.col(text))
    kept = docs.join(small(gone), same, "left_anti")
    if twins.isEmpty():
        return kept
    once = kept.join(small(twins), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(small(twins), same, "left_anti").unionByName(once)
