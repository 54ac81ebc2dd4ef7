"""What the third round found: floats, ties, and tables of several files, against the queries' SQL."""

import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
import corpus_pipeline
from sigilo.llm import simhash
from sigilo.operators import detect, evaluate, geometry


def agrees(spark, folder, name, *tables):
    c = duckdb.connect()
    c.execute("set threads = 1")  # with more, rows that an ORDER BY leaves open come as they like
    for t in tables:
        at = folder / f"{t}.parquet"
        c.execute(f"create view {t} as select * from '{at}{'/*.parquet' if at.is_dir() else ''}'")
    out = c.execute(entry.oracle_sql()[name])
    names, wanted = [d[0] for d in out.description], Counter(out.fetchall())
    got = entry.queries()[name](spark, str(folder))
    assert Counter(tuple(r) for r in got.select(*names).collect()) == wanted and wanted
    return got


def test_polygon_bbox_multiplies_floats(spark, tmp_path):
    """Floats beside thousandths, of which the product is rounded to a whole number or isn't."""
    near = (np.arange(-500, 500) / 1000).astype(np.float32)
    every = np.concatenate([near, np.nextafter(near, np.float32(9)), np.nextafter(near, np.float32(-9))])
    pq.write_table(pa.table({"vec_id": pa.array(range(len(every)), pa.int64()), "embedding": pa.array([[float(x)] * 8 for x in every], pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    agrees(spark, tmp_path, "polygon_bbox", "embeddings")


def test_preannotation_takes_the_first_of_a_table(spark, tmp_path):
    """Lines of one number at one place: the first counts, in whatever order the files are read."""
    rnd = random.Random(3)
    at = tmp_path / "lineitem.parquet"
    at.mkdir()
    for k, n in enumerate((40, 4000, 200, 9000)):  # larger files are read first
        rows = [(rnd.randrange(60), rnd.randrange(6), rnd.randrange(2), rnd.randrange(1, 4), rnd.choice("ANR")) for _ in range(n)]
        kinds = [("l_orderkey", pa.int64()), ("l_partkey", pa.int64()), ("l_suppkey", pa.int64()), ("l_linenumber", pa.int32()), ("l_returnflag", pa.string())]
        pq.write_table(pa.table({c: pa.array(v, t) for (c, t), v in zip(kinds, zip(*rows))}), at / f"part-{k}.parquet")
    agrees(spark, tmp_path, "preannotation_dedupe", "lineitem")


def test_keys_of_fingerprints_are_not_broadcast(spark):
    fps = spark.range(1000).selectExpr("xxhash64(id) AS fp")
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pipeline_takes_near_copies_by_simhash(spark):
    """Texts of one SimHash class leave one document, whatever their words have in common; others stay."""
    rnd = random.Random(4)
    words = [f"word{k}" for k in range(500)]
    rows = []
    for k in range(30):
        base = [rnd.choice(words) for _ in range(400)]
        rows += [(4 * k + j, " ".join(base[:-1] + [f"end{j}"] if j else base)) for j in range(4)]
    rows += [(901, "one"), (902, None), (903, ""), (None, None), (900, "one"), (900, "one")]
    rows += [(800, "so " * 300 + "ein zwei drei vier"), (801, "so " * 300 + "un deux trois quatre")]  # few words in common, one fingerprint
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    component = {}
    for r in simhash.near_copies(docs).where("doc_id is not null").select("fingerprint", "component_id").distinct().collect():
        component[r.fingerprint] = r.component_id
    kept = corpus_pipeline.without_copies(spark, docs, "").where("doc_id is not null").collect()
    classes = [component[f"{simhash.fingerprint((r.text or '').encode()):016x}"] for r in kept]
    assert sorted(classes) == sorted(set(component.values())) and all(r.doc_id == c for r, c in zip(kept, classes))
    assert len(kept) < 60 and {800, 801} & {r.doc_id for r in kept} == {800}


def test_pages_are_packed_as_they_come(spark):
    """Words that come page by page are a row a page; in another order whole pages are the same."""
    kinds = [(d, p) for d in (1, None, 2) for p in (1, None, 2) if d or p]
    rows = [(d, p, 50 * i + k, f"w{k}") for i, (d, p) in enumerate(kinds) for k in range(50)]
    ddl = "doc_id long, pagina int, seq long, texto string"
    assert geometry.pages(spark.createDataFrame(rows, ddl).coalesce(1), ["seq", "texto"]).count() == 8
    wanted = sorted((str((d, p)), sorted((s, t) for a, b, s, t in rows if (a, b) == (d, p))) for d, p in {r[:2] for r in rows})
    for some in (rows, random.Random(1).sample(rows, len(rows))):
        got = geometry.whole_pages(spark.createDataFrame(some, ddl), ["seq", "texto"]).collect()
        assert sorted((str((r.doc_id, r.pagina)), sorted(zip(r.seq, r.texto))) for r in got) == wanted


def test_greedy_matches_of_one_place_make_no_pairs(spark):
    """30 000 truths and as many detections at one place: 900 million pairs."""
    at = ["1L AS doc_id", "id AS seq", "'CPF' AS tipo", "10 AS ini", "20 AS fim"]
    got = evaluate.match(spark.range(30_000).selectExpr(*at), spark.range(5, 30_005).selectExpr(*at)).collect()
    assert sorted((r.gt, r.det) for r in got) == [(k, k + 5) for k in range(30_000)]


def test_places_of_pieces_are_held_in_few_bytes(spark):
    """A recogniser that reads 200 000 texts and then tells what the worker holds beside it."""

    def extract(frames):
        import tracemalloc

        tracemalloc.start()
        for f in frames:
            last = f["doc_id"].iloc[-1]
        held = tracemalloc.get_traced_memory()[0]
        tracemalloc.stop()
        yield pd.DataFrame([(last, "X", "x", 0, 1, float(held))], columns=["doc_id", "tipo", "valor", "ini", "fim", "score"])

    docs = spark.range(200_000, numPartitions=1).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    (r,) = detect.recognised(docs, extract).collect()
    assert r.doc_id == 199_999 and r.score < 20e6
