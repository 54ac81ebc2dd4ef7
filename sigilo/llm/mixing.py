"""Mixing sources to target weights by Pfair scheduling: blocks have release slots and deadlines, the earliest deadline goes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, scratch, settle, spread, with_rank

OTHER = "(other)"
ADDED = ("stream", "block", "mix_slot", "mix_offset")


def edf(counts: Column) -> Column:
    """Slots of one round: for each slot, in order, the index of the source that has it.

    counts: an array of the blocks c_i that the sources have in the round, of C slots in all. Block k of source
    i is released at floor(kC/c_i) and due by ceil((k+1)C/c_i). In each slot the released block of the earliest
    deadline goes, the lowest index on ties. Unit jobs on one processor: this order meets every window, so each
    source's share never strays a whole block from its weight.
    """
    total = F.aggregate(counts, F.lit(0), lambda a, c: a + c)
    begin = F.struct(F.transform(counts, lambda c: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("slots"), total.alias("all"), counts.alias("counts"))

    def slot(acc: Column, t: Column) -> Column:
        def due(c: Column, i: Column) -> Column:
            k = acc["done"][i]
            released = F.floor(k * acc["all"] / c) <= t
            return F.when((k < c) & released, F.struct(F.ceil((k + 1) * acc["all"] / c).alias("due"), i.alias("i")))

        pick = F.array_min(F.filter(F.transform(acc["counts"], due), lambda x: x.isNotNull()))["i"]
        done = F.transform(acc["done"], lambda k, i: F.when(i == pick, k + 1).otherwise(k))
        return F.struct(done.alias("done"), F.concat(acc["slots"], F.array(pick)).alias("slots"), acc["all"].alias("all"), acc["counts"].alias("counts"))

    slots = F.sequence(F.lit(0), total - 1)
    return F.aggregate(slots, begin, slot, lambda acc: acc["slots"])


def schedule(blocks: DataFrame) -> DataFrame:
    """(source, quota, kind columns): the slot of every block, as a table over rounds of one kind.

    blocks: a row for each source with its weight `quota` in whole blocks of a round and its `blocks`. In round
    r a source has min(quota, blocks - r quota) blocks, none after its end: the weights of those that are left
    hold among themselves. Rounds between two ends are alike, so 2m+1 kinds of rounds at most have a schedule
    each, whatever the number of rounds. Rows: first and last round of the kind, source, k (its block in the
    round), slot in the round, and base: slots ahead of the first round, with `width` slots a round.
    """
    full = F.floor(F.col("blocks") / F.col("quota"))
    ends = blocks.select(F.explode(F.array(F.lit(0).cast("long"), full, full + 1)).alias("first")).distinct()
    longest = blocks.agg(F.max(F.ceil(F.col("blocks") / F.col("quota"))).alias("rounds"))
    nexts = Window.orderBy("first")  # three rows a source at most
    kinds = ends.join(F.broadcast(longest), F.col("first") < F.col("rounds"))
    kinds = kinds.withColumn("last", F.coalesce(F.lead("first").over(nexts), F.col("rounds")) - 1)
    given = blocks.agg(F.array_sort(F.collect_list(F.struct("source", "quota", "blocks"))).alias("given"))  # the sources, a bounded table
    left = lambda r: F.transform("given", lambda s: F.greatest(F.lit(0), F.least(s["quota"], s["blocks"] - r * s["quota"])).cast("int"))
    ahead = F.aggregate("given", F.lit(0).cast("long"), lambda a, s: a + F.least(s["blocks"], F.col("first") * s["quota"]))
    kinds = kinds.join(F.broadcast(given), F.col("first") >= 0).withColumn("counts", left(F.col("first"))).withColumn("base", ahead)
    kinds = kinds.withColumn("slots", edf(F.col("counts")))
    slots = kinds.select("first", "last", "base", F.size("slots").alias("width"), "given", F.posexplode("slots").alias("slot", "i"))
    turn = Window.partitionBy("first", "i").orderBy("slot")
    return slots.select("first", "last", "base", "width", "slot", F.col("given")[F.col("i")]["source"].alias("source"), (F.row_number().over(turn) - 1).alias("k"))


def mix(docs: DataFrame, quotas: dict[str, int], block_docs: int = 16) -> DataFrame:
    """Adds stream, block (of the stream), mix_slot (of the block, from 0 without gaps) and mix_offset (in the block).

    quotas: whole blocks that each source has in a round of sum(quotas) slots, its target weight. Sources that it
    doesn't name, nulls among them, are one stream of quota 1. A source's documents go by doc_id (null first),
    then a hash of the row, in blocks of block_docs, the last one perhaps smaller. Sources that end leave their slots to
    the others, by their weights; all rows are kept. Repeated rows and ties in doc_id have places of their own.
    An empty table gives no row. Other columns are kept, but for those that have the name of an added one.
    """
    others = [c for c in docs.columns if c not in ADDED]
    with scratch() as keep:
        packed = docs.select(F.struct(*others).alias("_row"), _stream(quotas).alias("stream"), F.col("doc_id").alias("_id"), F.xxhash64(*others).alias("_tie"))
        own = keep(settle(with_rank(packed, ["stream"], [F.col("_id"), F.col("_tie")])))
        plan = _plan(own, quotas, block_docs)
        keep(plan)
    return _slotted(own, plan, block_docs).select("_row.*", "stream", "block", "mix_slot", "mix_offset")


def _stream(quotas: dict[str, int]) -> Column:
    if not quotas or min(map(int, quotas.values())) < 1:
        raise ValueError("quotas must be whole blocks, one at least")
    return F.when(F.col("source").isin(list(quotas)), F.col("source")).otherwise(F.lit(OTHER))


def _plan(own: DataFrame, quotas: dict[str, int], block_docs: int) -> DataFrame:
    """The slots of every kind of round, with the quota of each stream: (2m+1) rounds of sum(quotas) slots at most, both given."""
    given = {k: int(q) for k, q in quotas.items()}
    rows = own.sparkSession.createDataFrame([*given.items()] + ([] if OTHER in given else [(OTHER, 1)]), "source string, quota long")
    sizes = own.groupBy(F.col("stream").alias("source")).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_docs)).alias("blocks"))
    blocks = settle(sizes.join(rows, "source"))
    return settle(schedule(blocks).join(blocks.select("source", "quota"), "source").withColumnRenamed("source", "_source"))


def _slotted(rows: DataFrame, plan: DataFrame, block_docs: int) -> DataFrame:
    """rows (stream, rank, ...) with block, mix_slot and mix_offset."""
    at = rows.withColumns({"block": F.floor(F.col("rank") / block_docs), "mix_offset": (F.col("rank") % block_docs).cast("int")})
    quota = plan.select(F.col("_source").alias("_s"), F.col("quota").alias("_q")).distinct()
    at = at.join(F.broadcast(quota), F.col("stream") == F.col("_s"))
    at = at.withColumn("_round", F.floor(F.col("block") / F.col("_q"))).withColumn("_k", F.col("block") % F.col("_q"))
    same = (F.col("stream") == F.col("_source")) & (F.col("_k") == F.col("k")) & F.col("_round").between(F.col("first"), F.col("last"))
    slot = F.col("base") + (F.col("_round") - F.col("first")) * F.col("width") + F.col("slot")
    return at.join(F.broadcast(plan), same).withColumn("mix_slot", slot.cast("long"))


def in_order(docs: DataFrame, quotas: dict[str, int], block_docs: int = 16) -> DataFrame:
    """docs, in the columns given, dealt and sorted by their places in the mix, so that files hold it in order.

    Every row has a place of its own, by its source, doc_id (null first) and a hash of the row, as in `mix`. Whole rows move
    twice: to their places, which meet them by a 128-bit hash of the row, and to the files. Equal rows have ranks in
    a row, so one place holds for all of them and a count within them tells the rest.
    """
    parts = spread(docs.sparkSession)
    told = [c for c, t in docs.dtypes if "map<" not in t]
    keys = [F.xxhash64(*told).alias("_k1"), F.xxhash64(F.lit(7), *told, *[F.col(c).isNull() for c in told]).alias("_k2")]
    with scratch() as keep:
        slim = docs.select(*keys, _stream(quotas).alias("stream"), F.col("doc_id").alias("_id"))
        own = settle(with_rank(slim, ["stream"], [F.col("_id"), F.col("_k1"), F.col("_k2")]))
        plan = keep(_plan(own, quotas, block_docs))
        places = keep(settle(own.groupBy("_k1", "_k2").agg(F.min("stream").alias("stream"), F.min("rank").alias("_first"))))
        slots = plan.agg(F.max(F.col("base") + (F.col("last") - F.col("first") + 1) * F.col("width"))).first()[0] or 1
    rows = docs.select(F.struct("*").alias("_row"), *keys).join(places, ["_k1", "_k2"])
    rows = rows.withColumn("rank", F.col("_first") + F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy(F.lit(0))) - 1)
    rows = _slotted(rows.select("_row", "stream", "rank"), plan, block_docs).select("_row", "mix_slot", "mix_offset")
    rows = rows.withColumn("_part", F.floor(F.col("mix_slot") * parts / slots).cast("int"))
    return rows.repartitionById(parts, "_part").sortWithinPartitions("mix_slot", "mix_offset").select("_row.*")
