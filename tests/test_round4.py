"""Truth and detections are read once, and tasks grow with their rows."""

from pyspark.sql import functions as F

from sigilo.operators import evaluate
from sigilo.plans import tagging

SPANS = "doc_id long, seq long, tipo string, ini int, fim int"


def spans(n):
    return [(k % 7, k, "PER" if k % 3 else None, k * 20, k * 20 + 10) for k in range(n)]


def test_detections_are_made_once(spark):
    """What finds them may be a recogniser, which is dear."""
    made = spark.sparkContext.accumulator(0)

    def find(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    found = spark.createDataFrame(spans(60), SPANS).mapInArrow(find, SPANS)
    rows = evaluate.outcomes(spark.createDataFrame(spans(60), SPANS), found)
    told = {r.outcome: r["count"] for r in rows.groupBy("outcome").count().collect()}
    assert made.value == 60
    assert told == {"TP": 40, "FN": 20, "FP": 20}


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    truth, found = spark.createDataFrame(spans(300), SPANS), spark.createDataFrame(spans(300), SPANS)
    whole = sorted(map(tuple, evaluate.match(truth, found).collect()))
    monkeypatch.setattr(evaluate, "TASK_ROWS", 50)
    out = evaluate.match(truth, found)
    assert out.rdd.getNumPartitions() == 12 and sorted(map(tuple, out.collect())) == whole
    leak = evaluate.zero_leak(evaluate.outcomes(truth, found)).first()
    assert tuple(leak) == (7, 0, 0.0)


def test_texts_of_the_tagger_are_written_once(spark):
    texts, ents = tagging.labelled(spark, "/root/testdata/sf0.001")
    assert all("settled-" in f for f in texts.inputFiles() + ents.inputFiles())
    assert ents.where(F.expr("substring(text, ini + 1, fim - ini) <> valor") if "text" in ents.columns else F.expr("ini < 0 or fim <= ini")).count() == 0
