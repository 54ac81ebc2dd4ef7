"""Vector code compression: product quantisation by Lloyd's rounds, with heaps of bounds that tell which parts to look at again."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, scratch, settle, small

#: Parts of a vector, entries of a part's codebook, rounds, steps that a unit is cut into.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components further from zero than this many steps count as so far, so that squared distances stay whole numbers of 64 bits.
MOST = 1 << 26
#: Bounds are rounded by this share to the side that makes a part be looked at.
ROUNDING = 1e-12
#: Vectors that are compared to a codebook at a time.
AT_ONCE = 2048


def whole(vector: Column) -> Column:
    """The components as numbers of steps, rounded down."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of parts (n, width) to entries (k, width)."""
    d = np.zeros((len(x), len(book)), np.int64)
    for j in range(x.shape[1]):
        d += np.square(x[:, j, None] - book[None, :, j])
    return d


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each part's nearest entry, the lower one on ties, and its slack: how much nearer it is than the next, rounded down."""
    entry, slack = np.empty(len(x), np.uint8), np.empty(len(x))
    for at in range(0, len(x), AT_ONCE):
        d = distances(x[at : at + AT_ONCE], book)
        rows = np.arange(len(d))
        best = d.argmin(axis=1)
        upper = np.sqrt(d[rows, best].astype(float)) * (1 + ROUNDING)
        other = d.astype(float)
        other[rows, best] = np.inf
        entry[at : at + AT_ONCE], slack[at : at + AT_ONCE] = best, np.sqrt(other.min(axis=1)) * (1 - ROUNDING) - upper
    return entry, slack


def drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By how much each entry's slack may have shrunk: its own way and the longest way of another entry of its codebook."""
    way = np.sqrt(np.square(new - old).sum(axis=2).astype(float)) * (1 + ROUNDING)
    longest = np.sort(np.concatenate([np.zeros((len(way), 1)), way], axis=1), axis=1)
    others = np.where(np.arange(way.shape[1]) == way.argmax(axis=1)[:, None], longest[:, -2:-1], longest[:, -1:])
    return (way + others) * (1 + ROUNDING)


def violated(entry: np.ndarray, key: np.ndarray, gone: np.ndarray) -> list[int]:
    """Rows whose slack the drift of their entry has used up: each entry's heap is popped as long as its least key isn't over its drift."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in gone]
    for row, (e, k) in enumerate(zip(entry.tolist(), key.tolist())):
        heaps[e].append((k, row))
    popped = []
    for heap, limit in zip(heaps, gone.tolist()):
        heapq.heapify(heap)
        while heap and heap[0][0] <= limit:
            popped.append(heapq.heappop(heap)[1])
    return popped


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), PARTS, width).astype(np.int64)


def _state(b: pa.RecordBatch, entry: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    codes = pa.array([row.tobytes() for row in entry], pa.binary())
    keys = pa.FixedSizeListArray.from_arrays(pa.array(key.ravel()), PARTS).cast(pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([b.column(0), codes, keys, *b.columns[3:]], names=["_x", "_entry", "_key", *b.schema.names[3:]])


def _entries(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, PARTS)


def _begun(batches: Iterator[pa.RecordBatch], book: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All parts assigned by comparing each to all entries."""
    for b in batches:
        x = _matrix(b.column(0), book.shape[2])
        pairs = [nearest(x[:, p], book[p]) for p in range(PARTS)]
        yield _state(b, *(np.stack(c, axis=1) for c in zip(*pairs)))


def _moved(batches: Iterator[pa.RecordBatch], book: np.ndarray, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Parts assigned anew where the drift since they were compared (`gone` is the sum from the beginning) may have changed their entry."""
    for b in batches:
        x, entry = _matrix(b.column(0), book.shape[2]), _entries(b).copy()
        key = b.column(2).flatten().to_numpy().reshape(-1, PARTS).copy()
        for p in range(PARTS):
            rows = violated(entry[:, p], key[:, p], gone[p])
            if rows:
                entry[rows, p], slack = nearest(x[rows, p], book[p])
                key[rows, p] = slack + gone[p][entry[rows, p]]
        yield _state(b, entry, key)


def _sums(batches: Iterator[pa.RecordBatch], entries: int, width: int) -> Iterator[pa.RecordBatch]:
    """Of a task's parts (x, entry): count and sums of each entry."""
    counts, sums = np.zeros(PARTS * entries, np.int64), np.zeros((PARTS * entries, width), np.int64)
    for b in batches:
        at = (np.arange(PARTS) * entries + _entries(b)).ravel()
        np.add.at(counts, at, 1)
        np.add.at(sums, at, _matrix(b.column(0), width).reshape(-1, width))
    used = np.flatnonzero(counts)
    columns = [pa.array(used // entries, pa.int32()), pa.array(used % entries, pa.int32()), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "total"])


def _coded(batches: Iterator[pa.RecordBatch], book: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, entry = _matrix(b.column(0), book.shape[2]), _entries(b)
        error = np.square(x - book[np.arange(PARTS), entry]).sum(axis=(1, 2))
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(error), *b.columns[3:]], names=["_code", "_error", *b.schema.names[3:]])


def recentred(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks with each entry the mean of its parts, rounded down; entries without parts stay. At most PARTS x ENTRIES rows reach the driver."""
    _, entries, width = book.shape
    told = state.select("_x", "_entry").mapInArrow(partial(_sums, entries=entries, width=width), "part int, entry int, n long, total array<long>")
    sums = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(k))) for k in range(width)]).alias("total"))
    out = book.copy()
    for r in sums.collect():
        out[r.part, r.entry] = [s // r.n for s in r.total]
    return out


def compress(vectors: DataFrame, keep: list[str], order: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(keep, code, error) of each vector, and the codebooks (part, entry, component). code has a byte for each part, its entry;
    error is the squared distance of the vector to what its code stands for, in steps.

    Each task keeps its parts in heaps, one for each entry, by slack and the drift when they were compared; a round pops and
    compares those whose slack the drift has used up, and no others. All other parts provably keep their entry. The state goes
    from round to round in written tables, a row for each vector; the driver has the codebooks only.

    Vectors that are null or hold null, NaN or infinite components go. Components are cut at MOST steps. Codebooks begin with the vectors
    of smallest `order` (null last, then by components); fewer vectors give fewer entries. Vectors shorter than the longest end
    in zeros, as does a length that PARTS doesn't divide. Equal rows have equal codes. An empty table gives none, and no entries.
    Columns that aren't kept are not looked at, and names may clash.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    others = [f"_k{i}" for i in range(len(keep))]
    types = dict(vectors.dtypes)
    rest = "".join(f", {o} {types[c]}" for o, c in zip(others, keep))
    slim = vectors.where(usable(F.col(vector))).select(whole(F.col(vector)).alias("_x"), F.col(order).alias("_order"), *[F.col(c).alias(o) for o, c in zip(others, keep)])
    with scratch() as held:
        given = settle(slim)
        longest = given.agg(F.max(F.size("_x"))).first()[0]
        width = -(-max(longest or 0, 1) // PARTS)
        padded = F.slice(F.concat("_x", F.array_repeat(F.lit(0), PARTS * width)), 1, PARTS * width)
        seeds = [r._x for r in given.select("_order", padded.alias("_x")).orderBy(F.col("_order").asc_nulls_last(), "_x").limit(ENTRIES).collect()]
        book = np.array(seeds, np.int64).reshape(len(seeds), PARTS, width).transpose(1, 0, 2)
        fields = "_x array<int>, _entry binary, _key array<double>" + rest
        blank = given.select(padded.alias("_x"), F.lit(None).cast("binary").alias("_entry"), F.lit(None).cast("array<double>").alias("_key"), *others)
        state, gone = settle(blank.mapInArrow(partial(_begun, book=book), fields)), np.zeros(book.shape[:2])
        for _ in range(ROUNDS if seeds else 0):
            after = recentred(state, book)
            gone, book = gone + drift(book, after), after
            state = settle(state.mapInArrow(partial(_moved, book=book, gone=gone), fields))
        held(state)
    out = state.mapInArrow(partial(_coded, book=book), "_code binary, _error long" + rest)
    return out.select(*[F.col(o).alias(c) for o, c in zip(others, keep)], F.col("_code").alias("code"), F.col("_error").alias("error")), book


#: Copies of a group's sum that its rows are dealt to, if groups are too many to be broadcast.
SALTS = 32


def with_group_sum(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows of equal group, null being one. No group's rows meet in one task: sums are made ahead of the shuffle, and meet the
    rows by broadcast if their counted rows are within the bound, by salted copies if not."""
    sums = settle(df.groupBy(F.col(group).alias("_group")).agg(F.sum(value).alias(name)))
    sided = small(sums)
    if sided is not sums:
        return df.join(sided, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    copies = sums.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    dealt = df.withColumn("_own", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_own") == F.col("_salt"))).drop("_group", "_own", "_salt")
