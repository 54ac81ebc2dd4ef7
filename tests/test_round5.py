"""What the fourth round found: lines without a number, and pairs of spans that are dealt and sorted by their rows."""

from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from test_round3 import agrees

import __spark_entry__ as entry
from sigilo.operators import evaluate, intervals
from sigilo.plans import tagging


def test_preannotation_takes_lines_without_a_number_last(spark, tmp_path):
    """A null line number ahead of, behind and beside others of its place, and by itself."""
    rows = [(1, 6, 2, None, "A"), (1, 6, 2, 3, "N"), (2, 7, 3, 4, "R"), (2, 7, 3, None, "A"), (3, 8, 2, None, "N"), (3, 8, 2, None, "R"), (None, 6, 2, None, "A"), (None, 6, 2, 1, "R"), (4, None, 2, None, "A"), (4, None, 2, 9, None)]
    kinds = [("l_orderkey", pa.int64()), ("l_partkey", pa.int64()), ("l_suppkey", pa.int64()), ("l_linenumber", pa.int32()), ("l_returnflag", pa.string())]
    pq.write_table(pa.table({c: pa.array(v, t) for (c, t), v in zip(kinds, zip(*rows))}), tmp_path / "lineitem.parquet")
    agrees(spark, tmp_path, "preannotation_dedupe", "lineitem")


def test_dense_bins_fall_into_groups(spark):
    """One place that 300 spans and 400 others share, beside bins of few: every pair once, and no task has them all."""
    rows = [(1, k, 10, 20) if k < 300 else (1, k, 40 * k, 40 * k + 50) for k in range(500)] + [(1, 900, 12, 18), (1, 900, 12, 18), (None, 901, 10, 20), (1, 902, None, 20)]
    spans = spark.createDataFrame(rows, "doc_id long, seq long, ini int, fim int")
    others = spark.createDataFrame([(1, k, 15, 25) if k < 400 else (1, k, 40 * k, 40 * k + 10) for k in range(600)], "doc_id long, o long, ini int, fim int")
    plain = intervals.overlaps(spans, others, ["o"]).select("seq", "o")
    cut = intervals.overlaps(spans, others, ["o"], tasks=8, cut=60).select("seq", "o")
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, plain.collect()))
    per = [r["count"] for r in cut.groupBy(F.spark_partition_id()).count().collect()]
    assert max(per) < 300 * 400 / 2 and sum(per) > 300 * 400


def test_span_pairs_is_dealt_by_its_rows(spark, monkeypatch):
    """No side is broadcast, however small the files are, tasks grow with the rows, and cut bins give the same pairs."""
    sf = "/root/testdata/sf0.001"
    whole = Counter(map(tuple, entry.queries()["span_pairs"](spark, sf).collect()))
    monkeypatch.setattr(evaluate, "TASK_ROWS", 500)
    monkeypatch.setattr(tagging, "BIN_ROWS", 5)
    out = entry.queries()["span_pairs"](spark, sf)
    assert Counter(map(tuple, out.collect())) == whole and whole
    plan = out._jdf.queryExecution().executedPlan().toString()
    pairs = plan.split("Final Plan")[-1]
    assert "SortMergeJoin [doc_id" in pairs and out.rdd.getNumPartitions() == 15
