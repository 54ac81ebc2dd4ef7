"""Queries of the benchmark flow, the service, page geometry and job progress, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigilo.operators import audit, dataset, evaluate, geometry, review
from sigilo.sources import files
from sigilo.streaming import progress

from .registry import query, table


def view(spark, sf, sql: str, *names: str) -> DataFrame:
    """The rows of a SQL text that both engines read, over tables of these names."""
    for n in names:
        table(spark, sf, n).createOrReplaceTempView(f"_{n}")
        sql = sql.replace(f"FROM {n}", f"FROM _{n}")
    return spark.sql(sql.replace("VARCHAR", "STRING"))


# Truth and detections of orders, moved by 0 to 7 of 10 places: up to 3 they overlap by half. ENDERECO is LOCAL, PER is PESSOA.
PLACE = "CAST(floor(o_orderkey / 300.0) AS INTEGER) * 20"
TRUTH = f"SELECT o_orderkey % 300 AS doc_id, o_orderkey AS seq, CASE o_custkey % 4 WHEN 0 THEN 'LOCAL' WHEN 1 THEN 'PER' WHEN 2 THEN 'ORG' ELSE 'CPF' END AS tipo, {PLACE} AS ini, {PLACE} + 10 AS fim FROM orders"
MOVED = "CAST(o_custkey * 7 % 8 AS INTEGER)"
FOUND = f"SELECT o_orderkey % 300 AS doc_id, o_orderkey AS seq, CASE o_custkey % 4 WHEN 0 THEN 'ENDERECO' WHEN 1 THEN 'PESSOA' WHEN 2 THEN 'ORGANIZACAO' ELSE CASE o_orderkey % 2 WHEN 0 THEN 'CPF' ELSE 'CNPJ' END END AS tipo, {PLACE} + {MOVED} AS ini, {PLACE} + {MOVED} + 10 AS fim FROM orders"
HIT = f"SELECT t.doc_id, t.seq, t.tipo AS truth, f.tipo AS found, f.ini - t.ini <= 3 AND (t.tipo <> 'CPF' OR f.tipo = 'CPF') AS hit FROM ({TRUTH}) t JOIN ({FOUND}) f ON t.doc_id = f.doc_id AND t.seq = f.seq"


@query(f"SELECT outcome, tipo, count(*) AS n FROM (SELECT CASE WHEN hit THEN 'TP' ELSE 'FN' END AS outcome, truth AS tipo FROM ({HIT}) UNION ALL SELECT 'FP', found FROM ({HIT}) WHERE NOT hit) GROUP BY outcome, tipo")
def eval_comparable_types(spark, sf):
    rows = evaluate.outcomes(view(spark, sf, TRUTH, "orders"), view(spark, sf, FOUND, "orders"))
    return rows.groupBy("outcome", "tipo").agg(F.count(F.lit(1)).alias("n"))


# Customers' documents name a value twice; two of three have a truth, at the first place; every fifth detection is missing.
CASES = "SELECT c_custkey AS doc_id, 'De V' || c_custkey || ' e V' || c_custkey AS text, 'V' || c_custkey AS valor FROM customer"


def _benchmark(spark, sf):
    docs = view(spark, sf, CASES, "customer")
    seq = F.lit(0).cast("long").alias("seq")
    truth = docs.where("doc_id % 3 > 0").select("doc_id", seq, F.lit("CPF").alias("tipo"), F.lit(3).alias("ini"), (3 + F.length("valor")).alias("fim"))
    found = docs.where("doc_id % 5 > 0").select("doc_id", seq, F.lit("CPF").alias("tipo"), "valor", F.when(F.col("doc_id") % 2 == 0, "regex").otherwise("ner").alias("fonte"), F.lit(3).alias("ini"), (3 + F.length("valor")).alias("fim"))
    moved = found.withColumn("ini", F.when(F.col("fonte") == "regex", F.lit(900)).otherwise(F.col("ini")))
    times = docs.select("doc_id", (F.col("doc_id") % 40).alias("ms"))
    return evaluate.benchmark(docs, truth, moved, times)


@query(f"SELECT count(*) AS docs, count(*) FILTER (WHERE doc_id % 5 > 0) AS limpos, round(avg(CASE WHEN doc_id % 5 > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 4) AS taxa, round(avg(doc_id % 40)::DOUBLE, 2) AS media_ms FROM ({CASES}) WHERE doc_id % 3 > 0")
def benchmark_summary(spark, sf):
    return _benchmark(spark, sf)["summary"]


@query(f"SELECT fonte, count(*) AS tp, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS pct FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'regex' ELSE 'ner' END AS fonte FROM ({CASES}) WHERE doc_id % 3 > 0 AND doc_id % 5 > 0) GROUP BY fonte")
def benchmark_sources(spark, sf):
    return _benchmark(spark, sf)["by_source"]


@query(f"SELECT count(*) FILTER (WHERE doc_id % 5 > 0) AS tp, count(*) FILTER (WHERE doc_id % 5 = 0) AS fn, 0::BIGINT AS fp FROM ({CASES}) WHERE doc_id % 3 > 0")
def benchmark_counts(spark, sf):
    return _benchmark(spark, sf)["total"].select("tp", "fn", "fp")


LABEL = "CASE c_custkey % 9 WHEN 0 THEN 'O' WHEN 1 THEN 'B-PER' WHEN 2 THEN 'I-LOC' WHEN 3 THEN 'B-ORG' WHEN 4 THEN 'B-TEMPO' WHEN 5 THEN 'I-PESSOA' WHEN 6 THEN 'X' WHEN 7 THEN 'I-ORGANIZACAO' ELSE 'B-LEGISLACAO' END"


@query("SELECT c_custkey AS k, CASE c_custkey % 9 WHEN 1 THEN 'B-PESSOA' WHEN 2 THEN 'I-LOCAL' WHEN 3 THEN 'B-ORGANIZACAO' WHEN 5 THEN 'I-PESSOA' WHEN 7 THEN 'I-ORGANIZACAO' ELSE 'O' END AS label FROM customer")
def baseline_remap(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.expr(LABEL).alias("l"))
    return c.select("k", evaluate.remapped(F.col("l"), dataset.LABELS).alias("label"))


@query("SELECT k, list_reduce(list_prepend('', list_transform(list_filter([k % 7, -100, (k + 3) % 7, -100], lambda x: x <> -100), lambda x: ['O', 'B-PESSOA', 'I-PESSOA', 'B-ORGANIZACAO', 'I-ORGANIZACAO', 'B-LOCAL', 'I-LOCAL'][x + 1])), lambda a, b: a || '|' || b) AS verdade, '|' || ['O', 'B-PESSOA', 'I-PESSOA', 'B-ORGANIZACAO', 'I-ORGANIZACAO', 'B-LOCAL', 'I-LOCAL'][(k + 1) % 7 + 1] || '|' || 'O' AS previsto FROM (SELECT c_custkey AS k FROM customer)")
def kept_labels(spark, sf):
    k = F.col("k").cast("int")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    ids, preds = F.array(k % 7, F.lit(-100), (k + 3) % 7, F.lit(-100)), F.array((k + 1) % 7, F.lit(5), F.lit(0), F.lit(6))
    said = lambda a: F.concat(F.lit("|"), F.array_join(a, "|"))
    return c.select("k", said(evaluate.kept_labels(ids, ids, dataset.LABELS)).alias("verdade"), said(evaluate.kept_labels(ids, preds, dataset.LABELS)).alias("previsto"))


SPLIT = "CASE WHEN h < 0.70 THEN 'train' WHEN h < 0.85 THEN 'dev' ELSE 'test' END"
HASHED = "SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT AS DOUBLE) / 4294967295.0 AS h FROM documents"


@query(f"SELECT split, count(*) AS n, min(doc_id) AS primeiro, max(doc_id) AS ultimo, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, {SPLIT} AS split FROM ({HASHED})) GROUP BY split")
def split_metadata(spark, sf):
    meta = dataset.split_metadata(dataset.checked_split(table(spark, sf, "documents").select("doc_id")))
    return meta.select("split", "n", F.array_min("docs").alias("primeiro"), F.array_max("docs").alias("ultimo"), F.size("docs").cast("bigint").alias("docs"))


SPOTS = "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS seq, CAST(l_partkey % 6 * 10 AS INTEGER) AS ini, CAST(l_partkey % 6 * 10 + 5 + l_suppkey % 2 AS INTEGER) AS fim, l_returnflag AS tipo FROM lineitem"


@query(f"SELECT doc_id, seq, ini, fim, tipo FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ini, fim ORDER BY seq) AS r FROM ({SPOTS})) WHERE r = 1")
def preannotation_dedupe(spark, sf):
    """Lines repeat an order's line numbers: of equal ones the first in the table counts, by file and row. Lines without a number come last, as in SQL."""
    lines = table(spark, sf, "lineitem").select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    lines.createOrReplaceTempView("_lineitem")
    spots = spark.sql(SPOTS.replace("FROM lineitem", ", _file, _row FROM _lineitem"))
    return dataset.preannotated(spots, [F.col("seq").asc_nulls_last(), "_file", "_row"]).drop("_file", "_row")


@query(f"SELECT doc_id, seq, ini, fim FROM ({SPOTS}) WHERE seq <= 2 UNION ALL SELECT doc_id, seq, ini, fim FROM ({SPOTS}) h WHERE seq > 2 AND NOT EXISTS (SELECT 1 FROM ({SPOTS}) e WHERE e.seq <= 2 AND e.doc_id = h.doc_id AND h.ini < e.fim AND h.fim > e.ini)")
def hints_beside_entities(spark, sf):
    s = view(spark, sf, SPOTS, "lineitem").drop("tipo")
    return dataset.hints_beside(s.where("seq > 2"), s.where("seq <= 2")).select("doc_id", "seq", "ini", "fim")


# Log entries of orders, several for a job; the last line counts.
ENTRIES = "SELECT CAST(o_orderkey % 500 AS VARCHAR) AS job_id, o_orderkey AS line_no, 'a' || o_custkey AS arquivo_original, 'b' || o_custkey AS arquivo_anonimizado, CAST(o_custkey % 9 AS INTEGER) AS total_redacoes, '10.0.0.1' AS ip_origem FROM orders"


@query(f"SELECT job_id, line_no, arquivo_original FROM ({ENTRIES}) WHERE job_id = '17' ORDER BY line_no DESC LIMIT 1")
def audit_lookup(spark, sf):
    return audit.lookup(view(spark, sf, ENTRIES, "orders"), "17").select("job_id", "line_no", "arquivo_original")


@query(f"SELECT job_id, arquivo_original, total_redacoes, ip_origem FROM ({ENTRIES})")
def audit_told(spark, sf):
    return audit.told(view(spark, sf, ENTRIES, "orders"))


# Parts as detections on page images, 50 documents of 4 pages of which 3 are there.
SEEN = "SELECT p_partkey % 50 AS doc_id, CAST(p_size % 4 AS INTEGER) AS pagina, CASE p_partkey % 3 WHEN 0 THEN 'ROSTO' WHEN 1 THEN 'CARIMBO' END AS tipo, CAST(p_partkey % 700 AS DOUBLE) AS x, CAST(p_size * 10 AS DOUBLE) AS y, CAST(40 AS DOUBLE) AS largura, CAST(30 AS DOUBLE) AS altura, 0.9 AS confianca, 'face' AS fonte FROM part"
PAGES = "SELECT DISTINCT p_partkey % 50 AS doc_id, CAST(p_size % 4 AS INTEGER) AS pagina, CAST(1654 AS DOUBLE) AS img_w, CAST(2339 AS DOUBLE) AS img_h, CAST(595 AS DOUBLE) AS pdf_w, CAST(842 AS DOUBLE) AS pdf_h FROM part WHERE p_size % 4 > 0"
VISUAL = f"SELECT s.doc_id, s.pagina, coalesce(tipo, 'ASSINATURA') AS tipo, '[' || coalesce(tipo, 'ASSINATURA') || ' DETECTADO]' AS valor, round(x * (595::DOUBLE / 1654), 6) AS x0, round((y + 30) * (842::DOUBLE / 2339), 6) AS y1 FROM ({SEEN}) s JOIN ({PAGES}) p ON s.doc_id = p.doc_id AND s.pagina = p.pagina"


def _visual(spark, sf) -> DataFrame:
    seen = view(spark, sf, SEEN, "part")
    return geometry.visual_findings(seen, view(spark, sf, PAGES, "part"))


@query(VISUAL)
def visual_findings(spark, sf):
    return _visual(spark, sf).select("doc_id", "pagina", "tipo", "valor", F.round(F.col("x0").cast("double"), 6).alias("x0"), F.round(F.col("y1").cast("double"), 6).alias("y1"))


@query(f"SELECT stage, count(*) AS n FROM (SELECT 0 AS stage FROM ({TRUTH}) UNION ALL SELECT 1 FROM ({VISUAL})) GROUP BY stage")
def visual_after_text(spark, sf):
    """Visual findings come after the text's and keep their repeats."""
    text = view(spark, sf, TRUTH, "orders").select("doc_id", "tipo")
    return geometry.with_visual(text, _visual(spark, sf).select("doc_id", "tipo")).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


AREAS = "SELECT p_partkey % 50 AS doc_id, CAST(p_size % 4 AS INTEGER) AS pagina, CAST(p_size AS DOUBLE) AS x0, 1.0 AS y0, CAST(p_size + 9 AS DOUBLE) AS x1, 2.0 AS y1, p_brand AS tipo FROM part"


@query(f"SELECT doc_id, pagina, count(*) AS n, min(x0) AS primeira FROM ({AREAS}) WHERE pagina > 0 GROUP BY doc_id, pagina")
def area_plan(spark, sf):
    """What is covered on each page that is there; page 0 isn't."""
    plan = geometry.area_plan(view(spark, sf, AREAS, "part"), view(spark, sf, PAGES, "part"))
    return plan.select("doc_id", "pagina", "n", F.col("areas")[0]["x0"].alias("primeira"))


@query("SELECT a.doc_id, a.pagina, 1210.0::DOUBLE AS largura, 'a' || a.doc_id AS antes, 'b' || a.doc_id AS depois FROM (SELECT DISTINCT p_partkey % 50 AS doc_id, CAST(p_size % 4 AS INTEGER) AS pagina FROM part WHERE p_size % 4 > 1) a")
def pages_side_by_side(spark, sf):
    """Pages that both sides have: the first side lacks page 0, the second page 1."""
    p = table(spark, sf, "part").selectExpr("p_partkey % 50 AS doc_id", "CAST(p_size % 4 AS INT) AS pagina").distinct()
    a = p.where("pagina > 0").selectExpr("*", "595D AS largura", "'a' || doc_id AS texto")
    b = p.where("pagina <> 1").selectExpr("*", "'b' || doc_id AS texto")
    return geometry.side_by_side(a, b)


@query("""SELECT p_partkey AS k, round(((CASE WHEN a BETWEEN 2.5 AND 5.5 THEN 0.9 WHEN a BETWEEN 1.5 AND 7.0 THEN 0.5 ELSE 0.2 END) + (CASE WHEN y > 0.6 THEN 0.8 WHEN y > 0.4 THEN 0.5 ELSE 0.3 END) + (CASE WHEN c >= 8 THEN 0.9 WHEN c >= 5 THEN 0.7 ELSE 0.4 END)
 + coalesce(d, 0)) / (CASE WHEN d IS NULL THEN 3 ELSE 4 END), 6) AS escore
FROM (SELECT p_partkey, p_size / 5.0 AS a, p_partkey % 10 / 10.0 AS y, p_partkey % 11 AS c, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0.3 WHEN 2 THEN 0.8 ELSE 0.3 END::DOUBLE AS d FROM part)""")
def signature_scores(spark, sf):
    """The dark share is none, 0, a third or a half of three and two pixels."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    pixels = F.when(k % 4 == 0, F.array().cast("array<int>")).when(k % 4 == 1, F.array(F.lit(200), F.lit(130))).when(k % 4 == 2, F.array(F.lit(127), F.lit(128), F.lit(255))).otherwise(F.array(F.lit(0), F.lit(255)))
    score = geometry.signature_score(F.col("p_size") / 5.0, k % 10 / F.lit(10.0), k % 11, geometry.dark_ratio(pixels))
    return p.select(k.alias("k"), F.round(score, 6).alias("escore"))


@query("SELECT p_partkey % 50 AS doc_id, string_agg(p_name, chr(10) ORDER BY p_size % 4, p_partkey % 7, p_size, p_partkey) AS texto FROM part GROUP BY p_partkey % 50")
def box_lines(spark, sf):
    """A line a box, by page, top, left."""
    return files.box_text(table(spark, sf, "part").selectExpr("p_partkey % 50 AS doc_id", "p_size % 4 AS pagina", "p_partkey % 7 AS y", "p_size AS x", "p_partkey AS seq", "p_name AS texto"))


# Events as updates of 200 jobs, half a minute and more apart.
UPDATES = "SELECT CAST(event_id % 200 AS VARCHAR) AS job_id, event_id AS seq, ts, 'detection' AS etapa, CASE WHEN event_id % 1400 >= 1200 THEN 100.0 ELSE 45.0 END AS porcentagem FROM events"


@query(f"""WITH u AS (SELECT *, lag(floor(epoch(ts))) OVER (PARTITION BY job_id ORDER BY seq) AS b, max(CASE WHEN porcentagem >= 100 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM ({UPDATES})),
 t AS (SELECT * FROM u WHERE coalesce(e, 0) = 0)
 SELECT job_id, count(*) AS updates, sum(greatest(coalesce(floor((floor(epoch(ts)) - b) / 30), 0), 0))::BIGINT AS batidas, count(*) FILTER (WHERE porcentagem >= 100) AS fins FROM t GROUP BY job_id""")
def progress_event_lines(spark, sf):
    """Lines of each job's stream by their kinds; nothing follows the end."""
    lines = progress.event_lines(view(spark, sf, UPDATES, "events"))
    count = lambda c: F.count_if(c)
    return lines.groupBy("job_id").agg(count(F.col("linha").startswith('data: {"job')).alias("updates"), count(F.col("linha") == ": heartbeat").alias("batidas"), count(F.col("linha") == 'data: {"done": true}').alias("fins"))


@query(f"SELECT job_id, listener, count(*) AS n, max(seq) AS ultimo FROM (SELECT u.job_id, l.listener, u.seq, row_number() OVER (PARTITION BY u.job_id, l.listener ORDER BY u.seq) AS r FROM ({UPDATES}) u JOIN (SELECT unnest([1, 2]) AS listener) l ON u.seq > l.listener * 300) WHERE r <= 3 GROUP BY job_id, listener")
def progress_listeners(spark, sf):
    """Two listeners of every job, who came at different times and can hold three updates."""
    u = view(spark, sf, UPDATES, "events")
    who = u.select("job_id").distinct().select("job_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("listener")).withColumn("since", F.col("listener") * 300)
    return progress.listened(u, who, 3).groupBy("job_id", "listener").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("ultimo"))


@query(f"SELECT seq FROM ({UPDATES}) WHERE porcentagem < 100 OR floor(epoch(ts)) >= (SELECT max(floor(epoch(ts))) FROM events) - 3600")
def progress_unfinished(spark, sf):
    u = view(spark, sf, UPDATES, "events")
    now = u.agg(F.max("ts")).first()[0]
    return progress.unfinished(u, F.lit(now)).select("seq")


@query("SELECT c_custkey AS k, list_sort(list_distinct(['PESSOA', 'CPF', CASE WHEN c_custkey % 2 = 0 THEN 'CPF' ELSE 'IBAN' END]))::VARCHAR AS labels FROM customer")
def deep_labels(spark, sf):
    both = review.deep_labels(F.array(F.lit("PESSOA"), F.lit("CPF")), F.array(F.when(F.col("c_custkey") % 2 == 0, "CPF").otherwise("IBAN")))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("["), F.array_join(F.array_sort(both), ", "), F.lit("]")).alias("labels"))


@query("SELECT event_id, floor((epoch_us(ts + INTERVAL 1500 MICROSECONDS) - epoch_us(ts)) / 1000)::BIGINT AS ms FROM events")
def elapsed(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", review.elapsed_ms(F.col("ts"), F.expr("ts + INTERVAL '0.0015' SECOND")).cast("bigint").alias("ms"))
