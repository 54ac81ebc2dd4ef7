"""Fuzzy line dedup: character-shingle MinHash, banding, exact Jaccard, union-find, one line of each component stays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_batches, buckets, fresh, scratch, settle, similar_classes, small

#: Characters of a shingle, bins of the signature, bands of how many bins, least Jaccard similarity.
CHARS, BANDS, ROWS, SIMILAR = 5, 16, 6, 0.8
#: Lines that a task remembers, so as not to sign a frequent line again and again; characters that are signed at a time.
REMEMBERED, AT_ONCE = 300_000, 1 << 17
BINS = BANDS * ROWS
#: Bits of a line's parity sketch, in words of 64.
SKETCH = 1024
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
MUL = np.uint64(0x9E3779B185EBCA87)
#: What is stripped from both ends of a line.
BLANK = " \t\n\x0b\x0c\r"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line number, hash) of every character shingle of the lines; a line shorter than a shingle has one, of all of it."""
    padded = [line if len(line) >= CHARS else line + "\0" * (CHARS - len(line)) for line in lines]
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    c += np.uint64(1)
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    h = c[: len(c) - CHARS + 1].copy()
    for k in range(1, CHARS):
        h *= MUL
        h += c[k : len(c) - CHARS + 1 + k]
    inside = np.ones(len(c), dtype=bool)
    for k in range(1, CHARS):
        inside[np.cumsum(lengths) - k] = False  # a shingle that begins there would run into the next line
    return np.repeat(np.arange(len(lines)), lengths - CHARS + 1), mixed(h[inside[: len(h)]])


@lru_cache(maxsize=1)
def probes(rounds: int = 64) -> np.ndarray:
    """probes[r][bin]: the bin that an empty bin looks into in its r-th try, alike for every line."""
    at = np.arange(rounds * BINS, dtype=np.uint64).reshape(rounds, BINS)
    return (mixed(mixed(at + NONE // np.uint64(3))) % np.uint64(BINS)).astype(np.int64)


def signatures(lines: list[str]) -> np.ndarray:
    """One-permutation MinHash of each line. An empty bin takes the value of a full one that its own row of tries finds
    (optimal densification), so that the bins of a short line agree about as independently as those of a long one."""
    line, h = shingle_hashes(lines)
    least = np.full(len(lines) * BINS, NONE)
    np.minimum.at(least, line * BINS + ((h >> np.uint64(40)) % np.uint64(BINS)).astype(np.int64), h)
    least = least.reshape(-1, BINS)
    out = least.copy()
    row, bin_ = np.nonzero(least == NONE)
    for tried in probes():
        found = least[row, tried[bin_]]
        full = found != NONE
        out[row[full], bin_[full]] = found[full]
        row, bin_ = row[~full], bin_[~full]
        if not len(row):
            return out
    out[row, bin_] = least[row].min(axis=1)  # after 64 tries: the line's smallest value
    return out


def band_keys(lines: list[str]) -> np.ndarray:
    """A 64-bit key for each line and band."""
    s = signatures(lines).reshape(len(lines), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), s.shape[:2]).copy()
    for k in range(ROWS):
        key = mixed(key * MUL + s[:, :, k])
    return key


def distinct_shingles(lines: list[str]) -> np.ndarray:
    """The line numbers (12 bits) and hashes (52 bits) of each line's distinct shingles, sorted. For fewer than 2^12 lines."""
    line, h = shingle_hashes(lines)
    every = np.sort((line.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12)))
    return every[np.concatenate([[True], every[1:] != every[:-1]])]


def sketches(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each line the number of its distinct shingles, and for SKETCH bits whether an odd number of them falls on the bit.

    A bit in which two lines differ needs a shingle that only one of them has. So as many shingles at least are in one line only.
    """
    distinct = distinct_shingles(lines)
    line, bit = (distinct >> np.uint64(52)).astype(np.int64), (distinct % np.uint64(SKETCH)).astype(np.int64)
    odd = (np.bincount(line * SKETCH + bit, minlength=len(lines) * SKETCH) & 1).astype(np.uint8)
    packed = np.packbits(odd.reshape(-1, SKETCH), axis=1, bitorder="little").view(np.int64)
    return np.bincount(line, minlength=len(lines)), packed


def _bunches(rows: Iterator[tuple[int, str]]) -> Iterator[tuple[list[int], list[str]]]:
    """Rows (id, line) in lists of bounded length."""
    ids, lines, size = [], [], 0
    for i, line in rows:
        ids.append(i)
        lines.append(line)
        size += len(line) + 1
        if size > AT_ONCE or len(ids) >= 2000:
            yield ids, lines
            ids, lines, size = [], [], 0
    if ids:
        yield ids, lines


def cut(text: str | None) -> list[tuple[int, str]]:
    """The numbers and words of the lines of a text that aren't blank, white space at their ends left out."""
    return [(k, line) for k, line in enumerate(map(_trim, (text or "").split("\n"))) if line]


def _trim(line: str) -> str:
    return line.strip(BLANK)


def line_id(line: str) -> int:
    """Spark's xxhash64 of the line, as an unsigned number."""
    return xxhash.xxh64_intdigest(line.encode("utf-8"), 42)


def signed(ids: list[int]) -> pa.Array:
    return pa.array(np.array(ids, dtype=np.uint64).view(np.int64))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, said, first, line_no, line) of the lines of texts (doc_id, said, text)."""
    for b in batches:
        counts, first, number, ids = [], [], [], []
        for text in b.column(2).to_pylist():
            before = len(ids)
            for k, line in enumerate((text or "").split("\n")):
                line = line.strip(BLANK)
                if line:
                    number.append(k)
                    ids.append(line_id(line))
            counts.append(len(ids) - before)
            first.append(number[before] if len(ids) > before else 0)
        rows = np.repeat(np.arange(len(counts)), counts)
        at = pa.array(rows)
        columns = [b.column(0).take(at), b.column(1).take(at), pa.array(np.array(first, dtype=np.int32)[rows]), pa.array(number, pa.int32()), signed(ids)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "said", "first", "line_no", "line"])


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
    """(id, line) of the lines of texts, each once as far as the task remembers."""
    seen: set[int] = set()
    for b in batches:
        for text in b.column(0).to_pylist():
            for _, line in cut(text):
                i = line_id(line)
                if i not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(i)
                    yield i, line


def _wanted(ids: Broadcast | None):
    """(line, words) of the lines of texts; of those in a broadcast sorted array only, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[int, str] = {}
            for text in b.column(0).to_pylist():
                said = [line for _, line in cut(text)]
                here = np.fromiter(map(line_id, said), np.uint64, len(said))
                if ids is not None and len(ids.value):
                    known = ids.value
                    at = np.minimum(np.searchsorted(known, here), len(known) - 1)
                    chosen = np.flatnonzero(known[at] == here)
                else:
                    chosen = range(len(said) if ids is None else 0)
                for k in chosen:
                    found[int(here[k])] = said[k]
            yield pa.RecordBatch.from_arrays([signed(list(found)), pa.array(found.values(), pa.string())], names=["line", "words"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys of the lines of texts."""
    for ids, lines in _bunches(_lines_of(batches)):
        keys = band_keys(lines).view(np.int64)
        own = np.repeat(np.array(ids, dtype=np.uint64).view(np.int64), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(own)], names=["key", "id"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id, size and sketch of lines (id, said)."""
    rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    for ids, lines in _bunches(rows):
        n, words = sketches(lines)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n.astype(np.int64)), *[pa.array(w) for w in np.ascontiguousarray(words.T)]], names=LOADS)


LOADS = ["id", "n", *[f"w{k}" for k in range(SKETCH // 64)]]


def excess(left, right) -> Column:
    """Over 0 for lines that can't have a similarity of 0.8: the sizes alone forbid it, or more shingles than a ninth of both
    sizes' sum are in one line only. (With S for that sum and D for those shingles the similarity is (S - D) / (S + D).)"""
    n, m = left("n"), right("n")
    apart = sum((F.bit_count(left(w).bitwiseXOR(right(w))) for w in LOADS[2:]), F.lit(0))
    return F.when(5 * F.least(n, m) < 4 * F.greatest(n, m), F.lit(1)).otherwise(9 * apart - n - m).cast("long")


def jaccard(a: list[str], b: list[str]) -> np.ndarray:
    """Similarities of the shingle sets of pairs of lines, fewer than 2^12. Shingles are told apart by 52 bits of their hashes."""
    x, y = distinct_shingles(a), distinct_shingles(b)
    every = np.sort(np.concatenate([x, y]))
    both = np.bincount((every[1:][every[1:] == every[:-1]] >> np.uint64(52)).astype(np.int64), minlength=len(a))
    sizes = np.bincount((every >> np.uint64(52)).astype(np.int64), minlength=len(a))
    return both / (sizes - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The similar pairs of rows (a, b, x, y)."""
    for batch in batches:
        a, b, held = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
        x, y = [], []
        for k, (said, other) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            x.append(said)
            y.append(other)
            held += len(said) + len(other)
            if held > AT_ONCE or len(x) >= 2000 or k == batch.num_rows - 1:
                at = k + 1 - len(x)
                ok = np.flatnonzero(jaccard(x, y) >= SIMILAR - 1e-12) + at
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in ok], pa.int64()), pa.array([b[i] for i in ok], pa.int64())], names=["a", "b"])
                x, y, held = [], [], 0


def line_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, said, first, line_no, line, class, keep) for every line of every text that isn't blank; said is the text's hash,
    first the number of its first line that isn't blank.

    line is a 64-bit hash of the line's text, class the smallest line reached by links of similarity 0.8 or more
    over five-character shingles, and keep marks the first place of a class by (doc_id, text hash, line_no). Lines that are
    equal meet once, however often they occur. Hash twins among different lines count as equal (odds of 2^-64 a pair).

    Null and empty texts have no line; null doc_id comes first. Rows of one doc_id with different texts are documents of their
    own; rows that are equal in both repeat their lines, with the same marks. An empty table gives none. Extra columns are
    not looked at. Lines of any length are read whole.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with scratch() as keep:
        said = docs.select("doc_id", F.xxhash64("text").alias("said"), "text")
        fields = f"doc_id {dict(docs.dtypes)['doc_id']}, said long, first int, line_no int, line long"
        places = keep(settle(said.mapInArrow(_places, fields)))
        shared = buckets(docs.select("text").mapInArrow(_keys, "key long, id long"))
        involved = settle(shared.select(F.col("id").alias("line")).distinct())
        few = involved.count() <= BROADCAST_ROWS  # ids that are broadcast; more are joined
        ids = spark.sparkContext.broadcast(np.sort(involved.toArrow().column("line").to_numpy().view(np.uint64))) if few else None
        words = docs.select("text").mapInArrow(_wanted(ids), "line long, words string")
        words = words if few else words.join(involved, "line", "left_semi")
        texts = settle(words.groupBy("line").agg(F.first("words").alias("words")))
        loads = settle(texts.mapInArrow(_sketches, ", ".join(f"{c} long" for c in LOADS)))
        x, y = texts.toDF("a", "x"), texts.toDF("b", "y")
        verify = lambda pairs: pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long")
        member = similar_classes(shared, loads, excess, 0, verify).where("class <> id").toDF("line", "component")
        member = keep(settle(member))  # lines that have a smaller one in their class; all others are their class
    named = places.join(small(member), "line", "left").withColumn("class", F.coalesce("component", "line"))
    kept = named.groupBy("class").agg(F.min(_place()).alias("kept"))
    return named.join(kept, "class").select("doc_id", "said", "first", "line_no", "line", "class", _place().eqNullSafe(F.col("kept")).alias("keep"))


def _place() -> Column:
    return F.struct(F.col("doc_id").isNotNull().alias("given"), F.col("doc_id"), F.col("said"), F.col("line_no"))


def dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs that has a line: doc_id, n_lines, n_kept, the numbers of the lines that go, in order, and
    said (the text's hash) and twin (from 0, among rows of equal doc_id and text). Twins but the first keep no line."""
    found = line_classes(docs)
    of = ["doc_id", "said"]
    gone = F.sort_array(F.collect_set(F.when(~F.col("keep"), F.col("line_no"))))  # of one text, never more than it has lines
    copies = F.count_if(F.col("line_no") == F.col("first"))
    each = settle(found.groupBy(*of).agg(copies.alias("n"), F.floor(F.count(F.lit(1)) / copies).cast("int").alias("n_lines"), gone.alias("dropped")))
    first = each.select("doc_id", "n_lines", (F.col("n_lines") - F.size("dropped")).alias("n_kept"), "dropped", "said", F.lit(0).cast("long").alias("twin"))
    again = each.where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in of], "n")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in of]
    every = found.join(again, same).groupBy(*of).agg(F.sort_array(F.collect_set("line_no")).alias("dropped"), F.first("n").alias("n"))
    twins = every.withColumn("twin", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1)))
    twins = twins.select("doc_id", F.size("dropped").alias("n_lines"), F.lit(0).alias("n_kept"), "dropped", "said", "twin")
    return first if again.isEmpty() else first.unionByName(twins)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the lines taken out of their texts that another place keeps. Blank lines and order stay, columns as given.

    Rows are told apart by doc_id (null is a value) and text; of rows that are equal in both one keeps its lines, so
    every class of lines stays in one row.
    """
    given, said, twin, drop = (fresh(c, docs) for c in ("_id", "_said", "_twin", "_dropped"))
    gone = settle(dedup(docs).where(F.size("dropped") > 0).select(F.xxhash64("doc_id", F.col("doc_id").isNull(), "said").alias(given), F.col("twin").alias(twin), F.col("dropped").alias(drop)))
    out = docs.withColumn(given, F.xxhash64("doc_id", F.col("doc_id").isNull(), F.xxhash64("text")))
    out = out.withColumn(twin, F.row_number().over(Window.partitionBy(given).orderBy(F.lit(0))) - 1)
    out = out.join(gone, [given, twin], "left")
    lines = F.split("text", "\n", -1)
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)  # by a hash set, in order
    left = F.element_at(F.transform(F.array(lines), lambda all_: F.transform(numbers, lambda i: F.get(all_, i))), 1)
    return out.withColumn("text", F.when(F.col(drop).isNotNull(), F.array_join(left, "\n")).otherwise(F.col("text"))).select(*docs.columns)
