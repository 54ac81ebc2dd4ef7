"""Sharding by a Hilbert curve over metadata, for files that several columns can prune."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, scratch, settle, spread, with_rank


#: The largest group of equal texts that is never cut, as a share of a shard.
WHOLE = 0.25


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression tree would repeat it at each mention."""
    return F.transform(F.array(value), body)[0]


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a point with `bits` bits in each dimension, as a column expression.

    The axes are turned into the transposed index by undoing excess work from the highest bit down, then by a
    Gray decoding, and the bits are interleaved (Skilling, 2004).
    """
    n = len(dims)

    def turn(a: Column, q: Column) -> Column:
        """Axis by axis, at the bit q: invert the lower bits of the first axis, or exchange them with this one's."""

        def axis(i: int, a: Column) -> Column:
            first, here = a[0], a[i]
            swap = first.bitwiseXOR(here).bitwiseAND(q - 1)
            inverted = here.bitwiseAND(q) != 0
            head = F.when(inverted, first.bitwiseXOR(q - 1)).otherwise(first.bitwiseXOR(swap))
            rest = [F.when(inverted, a[k]).otherwise(a[k].bitwiseXOR(swap)) if k == i else a[k] for k in range(1, n)]
            return F.array(head, *rest)

        for i in range(n):
            a = let(a, lambda v: axis(i, v))  # noqa: B023  called at once
        return a

    levels = F.array(*[F.lit(1 << k).cast("long") for k in range(bits - 1, 0, -1)])
    x = F.array(*[d.cast("long") for d in dims])
    x = F.aggregate(levels, x, turn) if bits > 1 else x
    gray = let(x, lambda a: F.array(*[reduce(Column.bitwiseXOR, [a[j] for j in range(i + 1)]) for i in range(n)]))

    def interleaved(a: Column) -> Column:
        last, none = a[n - 1], F.lit(0).cast("long")
        fixes = [F.when(last.bitwiseAND(1 << k) != 0, F.lit((1 << k) - 1).cast("long")).otherwise(none) for k in range(1, bits)]

        def joined(t: Column) -> Column:
            each = [(F.shiftright(a[i].bitwiseXOR(t), k).bitwiseAND(1), k * n + n - 1 - i) for k in range(bits) for i in range(n)]
            return reduce(Column.__add__, [F.shiftleft(bit, by) for bit, by in each])

        return let(reduce(Column.bitwiseXOR, fixes, none), joined)

    return let(gray, interleaved)


def quantised(name: str, bits: int) -> Column:
    """A text dimension as the first bits of its hash: equal values share a cell, as many cells at every size."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(name), F.lit(""))), F.lit(1 << bits))


def shard(docs: DataFrame, shards: int = 16, bits: int = 6) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law 'bytes', shard, slot, grown_shard (null), curve.

    Dimensions of the curve: language, source and the logarithm of the size. Copies of a text count as one
    group with the smallest language and source among them, so they lie together on the curve. Runs are cut
    where the bytes ahead of a row pass a multiple of total/shards; a group of at most WHOLE of a shard's bytes, or of
    the largest row's, goes whole to the shard of its middle. So no cut is off by more than half of that. Larger groups are cut like other rows: kept whole,
    they would make shards of very different sizes.

    Null text: size 1, CRC of the empty text, its own group. Null doc_id, lang, source: as values of their own.
    Repeated rows each get a slot. An empty table gives none. Extra columns are not looked at.
    """
    with scratch() as keep:
        at, total, starts = _placed(docs, shards, bits)
        keep(at), keep(starts)
    out = at.withColumn("shard", _shard(F.col("before"), shards, total)).join(F.broadcast(starts), "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", "g1", "g2", "none")


def _slim(docs: DataFrame, bits: int, more: list[str]) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col("text")).alias("g1"), F.xxhash64(F.lit(7), F.col("text")).alias("g2"), F.col("text").isNull().alias("none"), *more,
    )
    rows = settle(rows)
    groups = settle(rows.groupBy("g1", "g2", "none").agg(F.min("lang").alias("_lang"), F.min("source").alias("_source"), F.count(F.lit(1)).alias("copies")))
    joined = rows.join(groups, ["g1", "g2", "none"])
    width = F.least(F.lit((1 << bits) - 1), F.floor(F.log2("size") * ((1 << bits) / 32))).cast("long")  # a text has 2^31 bytes at most
    return joined.withColumn("curve", hilbert_index([quantised("_lang", bits), quantised("_source", bits), width], bits))


def _placed(docs: DataFrame, shards: int, bits: int, more: list[str] = ()) -> tuple[DataFrame, int, DataFrame]:
    """The slim rows with rank, before (bytes ahead) and, for rows of a group that isn't cut, first and held (its bytes);
    the sum of all sizes; and (shard, start): the smallest rank of each shard."""
    order = [F.col("curve"), F.col("g1"), F.col("g2"), F.col("none"), F.col("doc_id")]
    placed = settle(with_rank(_slim(docs, bits, list(more)), [], order, size="size"))
    total, most = placed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    group = placed.where("copies > 1").groupBy("g1", "g2", "none").agg(F.min("before").alias("first"), F.sum("size").alias("held"))
    at = settle(placed.join(settle(group.where(F.col("held") <= max(most, WHOLE * total / shards))), ["g1", "g2", "none"], "left"))
    starts = at.groupBy(_shard(F.col("before"), shards, total).alias("shard")).agg(F.min("rank").alias("start"))
    return at, total, settle(starts, 1)  # a row for each shard


def _shard(before: Column, shards: int, total: int) -> Column:
    """The shard of the middle of the row, or of its group where that stays whole. It never falls along the ranks."""
    middle = F.coalesce(F.col("first") + F.col("held") / 2, before + F.col("size") / 2)
    return F.least(F.lit(shards - 1), F.floor(middle * shards / max(total, 1))).cast("int")


def laid_out(docs: DataFrame, shards: int = 16, bits: int = 6) -> DataFrame:
    """docs with shard and slot (columns of those names are replaced), dealt and sorted by them for the writer.

    Whole rows move twice: to their places, which meet them by a 128-bit hash of doc_id and text, and to the files. Rows that
    are equal in both have ranks in a row, so one place holds for all of them and a count within them tells the rest.
    Null doc_id and null text are values of their own. An empty table gives none.
    """
    parts = spread(docs.sparkSession)
    kept = docs.select(*[c for c in docs.columns if c not in ("shard", "slot")])
    names = [fresh(c, kept) for c in ("_k1", "_k2", "_twin", "_rank", "_before", "_part")]
    k1, k2, twin, rank, before, part = names

    def keys(g1: Column, g2: Column) -> list[Column]:
        null = F.col("doc_id").isNull()
        return [F.xxhash64("doc_id", null, g1).alias(k1), F.xxhash64(g2, null, "doc_id").alias(k2)]

    with scratch() as keep:
        at, total, starts = _placed(kept, shards, bits)
        g1, g2 = (F.when(~F.col("none"), F.col(g)) for g in ("g1", "g2"))
        places = at.groupBy(*keys(g1, g2)).agg(F.min("rank").alias(rank), F.min("before").alias(before), *[F.min(c).alias(c) for c in ("size", "first", "held")])
        places = keep(settle(places.select(k1, k2, F.struct(rank, before, "size", "first", "held").alias(part))))
        keep(starts)
    g1, g2 = F.when(F.col("text").isNotNull(), F.xxhash64("text")), F.when(F.col("text").isNotNull(), F.xxhash64(F.lit(7), "text"))
    own = kept.select(F.struct("*").alias("_row"), *keys(g1, g2)).join(places, [k1, k2])
    own = own.withColumn(twin, F.row_number().over(Window.partitionBy(k1, k2).orderBy(F.lit(0))) - 1).select("_row", twin, f"{part}.*")
    own = own.withColumns({rank: F.col(rank) + F.col(twin), before: F.col(before) + F.col(twin) * F.col("size")})
    own = own.withColumn("shard", _shard(F.col(before), shards, total)).join(F.broadcast(starts), "shard")
    own = own.withColumn(part, F.least(F.lit(parts - 1), F.floor(F.col(before) * parts / max(total, 1))).cast("int"))
    own = own.withColumn("slot", F.col(rank) - F.col("start")).repartitionById(parts, part).sortWithinPartitions("shard", "slot")
    return own.select("_row.*", "shard", "slot")


def file_order(docs: DataFrame) -> list[Column]:
    """Where the rows of a table read from files lie, in the order they were written: file, then row. Nothing for other tables."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return []
    name = F.col("_metadata.file_name")
    return [F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long"), name, F.col("_metadata.row_index")]


def laid_out_in(docs: DataFrame, order: list[Column], shards: int = 16, bits: int = 6) -> DataFrame:
    """docs with shard as in `laid_out`, and slot by another order, such as that of a mix: the curve tells which rows share a shard, and
    the order how they lie in it. `order` must tell all rows apart, as `file_order` does. Columns named shard and slot are replaced.

    Slim rows are ranked, first along the curve, then in the order within their shards, both by ranges; whole rows move twice.
    """
    parts = spread(docs.sparkSession)
    kept = docs.select(*[c for c in docs.columns if c not in ("shard", "slot")])
    at_ = [fresh(f"_at{i}", kept) for i in range(len(order))]
    keyed = docs.select(*kept.columns, *[o.alias(c) for o, c in zip(order, at_)])
    with scratch() as keep:
        at, total, _ = _placed(keyed, shards, bits, at_)
        at = at.select(*at_, "size", _shard(F.col("before"), shards, total).alias("_shard"))
        places = with_rank(at, ["_shard"], [F.col(c) for c in at_], size="size")
        here = (F.col("_shard").cast("double") * total / shards + F.col("before")) * parts / max(total, 1)
        part = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(here))).cast("int")
        places = keep(settle(places.select(*at_, F.struct("_shard", F.col("rank").alias("_slot"), part.alias("_part")).alias("_place"))))
    same = [F.col(c).eqNullSafe(F.col(f"_of{i}")) for i, c in enumerate(at_)]
    own = keyed.select(F.struct(*kept.columns).alias("_row"), *at_).join(places.toDF(*[f"_of{i}" for i in range(len(at_))], "_place"), same)
    own = own.select("_row", F.col("_place._shard").alias("shard"), F.col("_place._slot").alias("slot"), F.col("_place._part").alias("_part"))
    return own.repartitionById(parts, "_part").sortWithinPartitions("shard", "slot").select("_row.*", "shard", "slot")
