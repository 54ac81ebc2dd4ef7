"""Interval joins, sweeps and greedy matching against brute force, and on one long document."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sigilo.operators import evaluate, intervals, spans

SPANS = "doc_id long, seq long, tipo string, ini int, fim int"


def drawn(n, seed, docs=4, reach=900, longest=700):
    draw = random.Random(seed)
    out = []
    for k in range(n):
        ini = draw.randrange(reach)
        out.append((draw.randrange(docs), k, draw.choice(["PESSOA", "PER", "LOCAL", "CPF"]), ini, ini + draw.choice([0, 1, 5, 9, draw.randrange(longest)])))
    return out


def over(a, b):
    return a[0] == b[0] and a[3] < b[4] and a[4] > b[3]


@pytest.mark.parametrize("width", [1, 64, 256])
def test_overlaps_equal_brute_force(spark, width):
    a, b = drawn(120, 1), drawn(150, 2) + [(1, 900, "CPF", 0, 5000)]
    got = intervals.overlaps(spark.createDataFrame(a, SPANS), spark.createDataFrame(b, SPANS).withColumnRenamed("seq", "o"), ["o"], width)
    assert sorted((r.seq, r.o) for r in got.collect()) == sorted((x[1], y[1]) for x in a for y in b if over(x, y))


@pytest.mark.parametrize("block", [7, 300, 1 << 16])
def test_overlapped_equals_brute_force(spark, block):
    a, b = drawn(150, 3) + drawn(3, 3), drawn(25, 4, longest=60)
    got = intervals.overlapped(spark.createDataFrame(a, SPANS), spark.createDataFrame(b, SPANS), block)
    assert sorted((r.seq, r._over) for r in got.collect()) == sorted((x[1], any(over(x, y) for y in b)) for x in a)
    assert sorted(r.seq for r in spans.overlap_anti(spark.createDataFrame(a, SPANS), spark.createDataFrame(b, SPANS)).collect()) == sorted(x[1] for x in a if not any(over(x, y) for y in b))


def sequential(truth, found, least):
    """The rule itself: truths in order, each takes the first free detection that overlaps enough."""
    kind = lambda t: {"PER": "PESSOA", "ENDERECO": "LOCAL"}.get(t, t)
    taken, out = set(), []
    for g in sorted(truth, key=lambda x: x[1]):
        for d in sorted(found, key=lambda x: x[1]):
            if d[1] in taken or not over(g, d) or kind(g[2]) != kind(d[2]):
                continue
            if (min(g[4], d[4]) - max(g[3], d[3])) / (max(g[4], d[4]) - min(g[3], d[3])) >= least:
                taken.add(d[1])
                out.append((g[0], g[1], d[1]))
                break
    return sorted(out)


@pytest.mark.parametrize("least", [0.5, 0.1])
def test_matches_equal_the_sequential_rule(spark, least):
    a, b = drawn(160, 5, docs=2, reach=200, longest=30), drawn(160, 6, docs=2, reach=200, longest=30)
    got = evaluate.match(spark.createDataFrame(a, SPANS), spark.createDataFrame(b, SPANS), least)
    assert sorted(map(tuple, got.collect())) == sequential(a, b, least)


def test_one_long_document(spark):
    """A million words and as many spans of one document: linear, where pairs would be 10^12."""
    words = spark.range(1_000_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("seq"), F.lit("CPF").alias("tipo"), (F.col("id") * 10).cast("int").alias("ini"), (F.col("id") * 10 + 8).cast("int").alias("fim"))
    moved = words.where("seq % 2 = 0").withColumns({"ini": F.col("ini") + 2, "fim": F.col("fim") + 1})
    began = time.time()
    assert intervals.overlaps(words, moved.select("doc_id", "ini", "fim")).count() == 500_000
    assert spans.overlap_anti(words, moved).count() == 500_000
    assert evaluate.match(words.where("seq < 200000"), moved).count() == 100_000
    assert time.time() - began < 240
