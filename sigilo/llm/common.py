"""What the corpus operators share: materialised steps, exact ranks without a one-task group, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir. Where it is unset a local master gets one of its own; a cluster must name it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sigilo-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table; does nothing where the session or its JVM has ended, as at exit."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    try:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    except (Py4JError, OSError):
        return


#: Settled tables that are still there, in the order they were written.
_settled: list[tuple[SparkSession, str]] = []


@atexit.register
def _forget_all() -> None:
    for spark, path in _settled:
        forget(spark, path)


def settle(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there and lost executors cost nothing.

    parts: tasks that write it, for a table known to be small; each takes several shuffle partitions. Tables live
    until the session ends, for the result that reads them is lazy, or until the `scratch` that they were settled in.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    (df.coalesce(parts) if parts else df).write.option("compression", "zstd").parquet(path)
    _settled.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables settled inside are deleted at its end, but for those given to what it yields. Nothing lazy that reads one may leave it."""
    mark, kept = len(_settled), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._settled_at)
        return df

    try:
        yield keep
    finally:
        for spark, path in _settled[mark:]:
            if path not in kept:
                forget(spark, path)
        _settled[mark:] = [x for x in _settled[mark:] if x[1] in kept]


def release(df: DataFrame) -> None:
    """Deletes a settled table that nothing reads any more."""
    at = getattr(df, "_settled_at", None)
    for spark, path in [x for x in _settled if x[1] == at]:
        forget(spark, path)
        _settled.remove((spark, path))


#: Rows of one id (or of one id and little more) that are broadcast at most; larger tables are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A settled table of narrow rows, marked for broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Rows that a task takes of tables whose size was counted.
TASK_ROWS = 100_000


def tasks_for(rows: int, spark: SparkSession) -> int:
    return max(1, min(spread(spark), -(-rows // TASK_ROWS)))


def fresh(name: str, df: DataFrame) -> str:
    """The name, or a longer one if a column of df has it."""
    while name in df.columns:
        name += "_"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes, the same for every operator, so that very long texts don't pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_rank(df: DataFrame, group: list[str], order: list[Column], size: str | None = None) -> DataFrame:
    """Adds `rank` (from 0) of each row within its group under the order and, for a size column, `before`:
    the sum of the sizes of the rows ahead of it. Adds `part`, the range partition of the row.

    Rows are dealt by ranges of (group, order), so a group of any size is cut over as many tasks as it needs.
    Only the groups that go on from an earlier range have an offset: one at most for each range, which bounds
    what is broadcast by the number of partitions.
    """
    named = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(named, order)))
    keys = [F.col(c).asc_nulls_first() for c in [*group, *named]]
    held = settle(keyed.repartitionByRange(spread(df.sparkSession), *keys).withColumn("part", F.spark_partition_id()))
    sizes = F.sum(size) if size else F.lit(0).cast("long")
    per = held.groupBy("part", *group).agg(F.count(F.lit(1)).alias("_n"), sizes.alias("_s"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("part", *group, F.sum("_n").over(earlier).alias("_rank0"), F.sum("_s").over(earlier).alias("_before0")).where("_rank0 > 0")
    offsets = offsets.select(F.col("part").alias("_part"), *[F.col(c).alias(f"_g_{c}") for c in group], "_rank0", "_before0")
    match = F.col("part") == F.col("_part")
    for c in group:
        match = match & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    within = Window.partitionBy("part", *group).orderBy(*[F.col(c).asc_nulls_first() for c in named])
    ahead = within.rowsBetween(Window.unboundedPreceding, -1)
    out = held.withColumn("_r", F.row_number().over(within) - 1)
    if size:
        out = out.withColumn("_b", F.coalesce(F.sum(size).over(ahead), F.lit(0)))
    out = out.join(F.broadcast(offsets), match, "left").withColumn("rank", F.col("_r") + F.coalesce("_rank0", F.lit(0)))
    if size:
        out = out.withColumn("before", F.col("_b") + F.coalesce("_before0", F.lit(0)))
    return out.select(*df.columns, "part", "rank", *(["before"] if size else []))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): component is the smallest node it reaches.

    Each round hooks every node to its smallest neighbour, follows the pointers once more, and contracts the
    edges; the edges shrink at least by half, so rounds grow with the logarithm of a component. No step holds
    more than a row for each edge, and nothing reaches the driver but whether edges are left.
    """
    with scratch() as keep:
        e = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
        labels = None
        while n := e.count():
            parts = tasks_for(2 * n, edges.sparkSession)  # nodes are twice the edges at most
            e = e.coalesce(parts)
            both = e.union(e.select("b", "a"))
            up = settle(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), parts)
            further = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = settle(up.join(further, "up").select("node", F.col("top").alias("up")), parts)
            if labels is None:
                labels, most = up.select("node", F.col("up").alias("component")), parts
            else:
                step = up.select(F.col("node").alias("component"), "up")
                labels = labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
            labels = settle(labels, most)
            left, right = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
            moved = e.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            e = settle(moved.where("a < b").distinct(), parts)
        return keep(labels if labels is not None else settle(e.select(F.col("a").alias("node"), F.col("b").alias("component"))))


def buckets(keys: DataFrame) -> DataFrame:
    """(key, id, pivot) of every id in a key that several ids share, each once, from (key, id), in which rows may repeat;
    pivot is the key's smallest id.

    The rows are dealt once and sorted, which spills; the least and the largest id of a key meet its rows as they go by. What a key has is
    kept in Spark's spilling buffer, no hash table holds any, and most keys, those of one id, go no further.
    """
    w = Window.partitionBy("key").orderBy("id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = keys.select("key", "id", F.first("id").over(whole).alias("pivot"), F.last("id").over(whole).alias("_last"), F.lag("id").over(w).alias("_before"))
    return settle(ends.where((F.col("pivot") < F.col("_last")) & ~F.col("id").eqNullSafe(F.col("_before"))).select("key", "id", "pivot"))


#: Pairs that a join scores in about the time that a round takes for a row.
ROUND_PAIRS = 64


def similar_classes(shared: DataFrame, loads: DataFrame, score: Callable[[Callable, Callable], Column], most: int, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, class) of every id of `loads`: class is the smallest id that verified links reach, itself included.

    shared: (key, id, pivot) of `buckets`. Every two ids of a key are candidates; a candidate whose score(left, right),
    an integer over the columns of loads (id and whatever tells two ids apart), is over `most` can't be similar, and
    verify(pairs: a, b, score) gives those that are. No verified link between two classes is missing from the result.

    First each id is held against one pivot, the one it shares most keys with. Then, round by round, the ids of keys that still
    have several classes are held against one id of another class there, a row for each id: first the one with most neighbours
    in all of its keys, which the centre of a group of edited copies has, then one drawn anew.
    Rounds go on while they cut the pairs over classes to three quarters or less, until those are so few that a round costs more.
    The pairs that are left over classes are then all scored within the join, so that only those which may be similar are rows, each
    once: at the smallest key that its two ids share.
    """
    with scratch() as keep:
        classes = settle(loads.select("id", F.col("id").alias("class")))
        x, y = (loads.select(*[F.col(c).alias(f"{c}_{side}") for c in loads.columns]).withColumnRenamed(f"id_{side}", side) for side in "ab")
        told = score(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b"))
        near = lambda pairs: verify(pairs.join(x, "a").join(y, "b").select("a", "b", told.alias("score")).where(F.col("score") <= most))

        def joined(classes: DataFrame, links: DataFrame) -> DataFrame:
            """The classes with those of linked ids made one."""
            of = classes.toDF("a", "x"), classes.toDF("b", "y")
            edges = links.select("a", "b").join(of[0], "a").join(of[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
            met = components(edges).toDF("class", "to")
            return settle(classes.join(met, "class", "left").select("id", F.coalesce("to", "class").alias("class")))

        def mixed(rows: DataFrame) -> DataFrame:
            """(key, id, class) of the keys whose ids are in several classes."""
            named = settle(rows.select("key", "id").join(classes, "id"))
            ends = named.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("key")
            return settle(named.join(settle(ends), "key").select("key", "id", "class"))

        pivots = shared.where("pivot <> id").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
        classes = joined(classes, settle(near(_most_shared(pivots))))
        rest, turn, before = mixed(shared), 0, None
        while True:
            per = rest.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
            ids, pairs = per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.lit(0.0))).first()
            if pairs <= ROUND_PAIRS * ids or before is not None and pairs > 0.75 * before:
                break
            before, turn = pairs, turn + 1
            if turn == 1:
                sizes = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
                about = settle(rest.join(sizes, "key").groupBy("id").agg((-F.sum("n")).alias("h")))
                ordered = rest.join(about, "id")
            else:
                ordered = rest.withColumn("h", F.xxhash64("id", F.lit(turn)))
            drawn = ordered.groupBy("key").agg(F.min(F.struct("h", "id", "class")).alias("rep"))
            held = rest.join(settle(drawn), "key").where(F.col("class") != F.col("rep.class")).select(F.col("rep.id").alias("a"), F.col("id").alias("b"))
            classes = joined(classes, settle(near(_most_shared(held))))
            rest = mixed(rest)
        if ids:
            of = rest.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys"))  # as many as the method gives an id
            full = settle(rest.join(settle(of.join(loads, "id")), "id"))
            left, right = (full.select("key", *[F.col(c).alias(f"{c}_{side}") for c in full.columns if c != "key"]) for side in "ab")
            # The last test is a higher-order function, which is not compiled into the join: a large method isn't optimised.
            earlier = F.exists("keys_a", lambda k: (k < left["key"]) & F.array_contains("keys_b", k))
            over = left.join(right, (left["key"] == right["key"]) & (F.col("class_a") < F.col("class_b")) & (told <= most) & ~earlier)
            over = settle(over.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), told.alias("score")))
            classes = joined(classes, settle(verify(over)))
        return keep(classes)


def _most_shared(pairs: DataFrame) -> DataFrame:
    """For each b the a that it is paired with most often, the smaller one on ties."""
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return settle(counted.groupBy("b").agg(F.max(F.struct("n", F.bitwise_not("a").alias("less"))).alias("m")).select(F.bitwise_not("m.less").alias("a"), "b"))
