"""Named queries over the driver's tables: each operator applied to whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigilo.functions import rules as R
from sigilo.functions import text as T
from sigilo.operators import allowlist as A
from sigilo.operators import api, audit, context, dataset, detect, evaluate, geometry, review, spans, transform
from sigilo.sources import files
from sigilo.streaming import progress

from .registry import query, table

# Patterns in the other dialect, for ASCII data.
EMAIL = R.rule("EMAIL").pattern
PHONE = R.rule("TELEFONE").pattern


def span_sql(pattern: str, tipo: str) -> str:
    """Spans from the lengths of matches and of the pieces between them."""
    return f"""SELECT doc_id, '{tipo}' AS tipo, m[i] AS valor,
  CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS ini,
  CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS INTEGER) AS fim
FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM documents))"""


MERGED = f"""WITH s AS ({span_sql(EMAIL, "EMAIL")} UNION ALL {span_sql(PHONE, "TELEFONE")}),
 p AS (SELECT *, max(fim) OVER (PARTITION BY doc_id ORDER BY ini, fim ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM s),
 q AS (SELECT *, sum(CASE WHEN ahead >= ini THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ini, fim ROWS UNBOUNDED PRECEDING) AS grp FROM p)
 SELECT doc_id, CAST(min(ini) AS INTEGER) AS ini, CAST(max(fim) AS INTEGER) AS fim, count(*) AS n FROM q GROUP BY doc_id, grp"""


def found(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return detect.find_all(docs, tipos=["EMAIL", "TELEFONE"])


@query(span_sql(EMAIL, "EMAIL"))
def rgx_email_spans(spark, sf):
    return detect.find_by_type(table(spark, sf, "documents"), "EMAIL").select("doc_id", "tipo", "valor", "ini", "fim")


@query(span_sql(PHONE, "TELEFONE"))
def rgx_phone_spans(spark, sf):
    return detect.find_by_type(table(spark, sf, "documents"), "TELEFONE").select("doc_id", "tipo", "valor", "ini", "fim")


@query(f"SELECT tipo, count(*) AS n, count(DISTINCT valor) AS distintos FROM ({span_sql(EMAIL, 'EMAIL')} UNION ALL {span_sql(PHONE, 'TELEFONE')}) GROUP BY tipo")
def rgx_counts_by_tipo(spark, sf):
    return found(spark, sf).groupBy("tipo").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("valor").alias("distintos"))


@query(f"""WITH m AS ({MERGED}) SELECT count(*) AS docs, sum(CAST(n AS BIGINT))::BIGINT AS spans, sum(fim - ini)::BIGINT AS chars FROM (SELECT doc_id, sum(n) AS n, sum(fim) AS fim, sum(ini) AS ini FROM m GROUP BY doc_id)""")
def rgx_redaction_stats(spark, sf):
    m = spans.merge(found(spark, sf)).groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("fim").alias("fim"), F.sum("ini").alias("ini"))
    return m.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("spans"), F.sum(F.col("fim") - F.col("ini")).alias("chars"))


@query(MERGED)
def span_merge(spark, sf):
    return spans.merge(found(spark, sf))


@query(f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '{R.REDACTED}', 'g') AS texto FROM documents")
def redact_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return transform.redact(docs, detect.find_by_type(docs, "EMAIL"))


@query(f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '[[EMAIL:\\0]]', 'g') AS texto FROM documents")
def highlight_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return transform.highlight(docs, detect.find_by_type(docs, "EMAIL"))


@query(f"""SELECT doc_id, ini, '...' || substr(text, greatest(ini - 50, 0) + 1, ini - greatest(ini - 50, 0)) || '[' || substr(text, ini + 1, fim - ini) || ']' || substr(text, fim + 1, 50) || '...' AS contexto
FROM ({span_sql(EMAIL, 'EMAIL')}) JOIN documents USING (doc_id)""")
def context_snippet(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    s = detect.find_by_type(docs, "EMAIL").join(docs, "doc_id")
    return s.select("doc_id", "ini", T.snippet(F.col("text"), F.col("ini"), F.col("fim")).alias("contexto"))


def digits_sql(s: str, weights: list[int]) -> str:
    total = " + ".join(f"CAST(substr({s}, {i + 1}, 1) AS BIGINT) * {w}" for i, w in enumerate(weights))
    return f"(CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END)"


CPF_SQL = f"""SELECT k, b || d1 || {digits_sql("(b || d1)", T.CPF2)} AS cpf FROM (SELECT k, b, CAST({digits_sql("b", T.CPF1)} AS VARCHAR) AS d1 FROM (SELECT c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS b FROM customer))"""
CNPJ_SQL = f"""SELECT k, b || d1 || {digits_sql("(b || d1)", T.CNPJ2)} AS cnpj FROM (SELECT k, b, CAST({digits_sql("b", T.CNPJ1)} AS VARCHAR) AS d1 FROM (SELECT s_suppkey AS k, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '0001' AS b FROM supplier))"""
BROKEN = "substr({0}, 1, {1}) || CASE WHEN k % 5 = 0 THEN CAST((CAST(substr({0}, {2}, 1) AS BIGINT) + 1) % 10 AS VARCHAR) ELSE substr({0}, {2}, 1) END"


def broken(c: Column, k: Column, size: int) -> Column:
    last = F.substring(c, size, 1)
    return F.concat(F.substring(c, 1, size - 1), F.when(k % 5 == 0, ((last.cast("long") + 1) % 10).cast("string")).otherwise(last))


@query(f"SELECT k, {BROKEN.format('cpf', 10, 11)} AS valor, k % 5 <> 0 AS valido FROM ({CPF_SQL})")
def cpf_validate(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), T.cpf_of(F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("cpf"))
    c = c.select("k", broken(F.col("cpf"), F.col("k"), 11).alias("valor"))
    return c.withColumn("valido", T.valid_cpf(F.regexp_replace("valor", r"^(...)(...)(...)", "$1.$2.$3-")))


@query(f"SELECT k, {BROKEN.format('cnpj', 13, 14)} AS valor, k % 5 <> 0 AS valido FROM ({CNPJ_SQL})")
def cnpj_validate(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), T.cnpj_of(F.concat(F.lpad(F.col("s_suppkey").cast("string"), 8, "0"), F.lit("0001"))).alias("cnpj"))
    s = s.select("k", broken(F.col("cnpj"), F.col("k"), 14).alias("valor"))
    return s.withColumn("valido", T.valid_cnpj(F.col("valor")))


ROLE = "CASE k % 7 WHEN 0 THEN 'Juiz ' WHEN 1 THEN 'Autor: ' WHEN 2 THEN 'Requerente: ' WHEN 3 THEN '' WHEN 4 THEN '' WHEN 5 THEN 'Exequente ' ELSE 'Perito ' END"
AFTER = "CASE k % 7 WHEN 3 THEN ', magistrado' WHEN 4 THEN ', requerente' ELSE ' compareceu' END"
ENTITY = f"SELECT k, {ROLE} || nome || {AFTER} AS text, nome, length({ROLE}) AS ini, CASE WHEN k % 11 = 0 THEN 'ORGANIZACAO' ELSE 'PESSOA' END AS tipo FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 22 = 0 THEN 'Banco ' || c_custkey ELSE 'Nome ' || c_custkey END AS nome FROM customer)"


def role_entities(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).withColumn("nome", F.expr("CASE WHEN k % 22 = 0 THEN 'Banco ' || k ELSE 'Nome ' || k END"))
    return c.select("k", F.expr(f"{ROLE} || nome || {AFTER}").alias("text"), "nome", F.expr(f"length({ROLE})").alias("ini"), F.expr("CASE WHEN k % 11 = 0 THEN 'ORGANIZACAO' ELSE 'PESSOA' END").alias("tipo"))


@query(f"""SELECT k, CASE k % 7 WHEN 0 THEN false WHEN 6 THEN false WHEN 3 THEN false ELSE true END AS anonimizar,
 CASE k % 7 WHEN 0 THEN 'cargo publico antes' WHEN 6 THEN 'cargo publico antes' WHEN 3 THEN 'cargo publico depois' WHEN 4 THEN 'papel privado depois' ELSE 'papel privado antes' END AS motivo FROM ({ENTITY})""")
def context_decision(spark, sf):
    e = role_entities(spark, sf).withColumn("valor", F.col("nome")).withColumn("fim", F.col("ini") + F.length("nome"))
    return context.decide(e).select("k", "decisao.anonimizar", "decisao.motivo")


@query("SELECT c_custkey AS doc_id, 'Nome ' || c_custkey AS valor FROM customer WHERE c_custkey % 4 < 2")
def header_parties(spark, sf):
    lead = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'Autor: ' WHEN 1 THEN 'Requeridos: ' WHEN 2 THEN 'Vistos ' ELSE 'Autor: ' END")
    name = F.when(F.col("c_custkey") % 4 == 3, F.lit("os")).otherwise(F.concat(F.lit("Nome "), F.col("c_custkey").cast("string")))
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(lead, name, F.lit(", brasileiro\nfim")).alias("text"))
    return detect.header_parties(docs).select("doc_id", "valor")


@query("""SELECT doc_id, palavra, count(*) AS n FROM (SELECT doc_id, palavra, unnest(range(0, length(text))) AS i, lower(text) AS t FROM documents, (VALUES ('aids'), ('hiv'), ('menor'), ('ana')) w(palavra) WHERE contains(lower(text), palavra))
WHERE substr(t, CAST(i + 1 AS BIGINT), length(palavra)) = palavra GROUP BY doc_id, palavra""")
def topic_keywords(spark, sf):
    hits = detect.topic_keywords(table(spark, sf, "documents"), ["aids", "hiv", "menor", "ana"])
    return hits.groupBy("doc_id", "palavra").agg(F.count(F.lit(1)).alias("n"))


# Names of customers and of suppliers on an allowlist with inactive, padded, upper-case and single-token entries.
NAMES = "SELECT c_custkey AS k, 'Nome ' || c_custkey % 97 || ' Silva' AS nome FROM customer"
LIST = """SELECT s_suppkey AS seq, CASE s_suppkey % 3 WHEN 0 THEN '  NOME ' || s_suppkey || ' SILVA ' WHEN 1 THEN 'Silva Nome ' || s_suppkey ELSE 'Nome' || s_suppkey END AS nome,
 CASE s_suppkey % 4 WHEN 0 THEN 'juiz' WHEN 1 THEN 'advogado' WHEN 2 THEN 'promotor' ELSE 'servidor' END AS tipo, s_suppkey % 5 <> 0 AS ativo FROM supplier"""


def names(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").selectExpr("c_custkey AS k", "'Nome ' || c_custkey % 97 || ' Silva' AS nome")


def listed(spark, sf) -> DataFrame:
    table(spark, sf, "supplier").createOrReplaceTempView("_supplier")
    return spark.sql(LIST.replace("FROM supplier", "FROM _supplier"))


@query(f"SELECT k, nome FROM ({NAMES}) WHERE lower(trim(nome)) IN (SELECT lower(trim(nome)) FROM ({LIST}) WHERE ativo)")
def allow_exact(spark, sf):
    return A.exact(names(spark, sf), listed(spark, sf))


SUBSET_SQL = f"""SELECT DISTINCT n.nome FROM ({NAMES}) n, ({LIST}) l WHERE ativo AND len(list_distinct(string_split(lower(trim(n.nome)), ' '))) >= 2 AND len(list_distinct(string_split(lower(trim(l.nome)), ' '))) >= 2
 AND len(list_intersect(string_split(lower(trim(n.nome)), ' '), string_split(lower(trim(l.nome)), ' '))) >= least(len(list_distinct(string_split(lower(trim(n.nome)), ' '))), len(list_distinct(string_split(lower(trim(l.nome)), ' '))))"""


@query(SUBSET_SQL)
def allow_subset(spark, sf):
    return A.subset(names(spark, sf), listed(spark, sf))


@query(f"""SELECT nome, entry, tipo FROM (SELECT n.nome, l.nome AS entry, l.tipo, row_number() OVER (PARTITION BY n.nome ORDER BY l.tipo, l.seq) AS r
FROM (SELECT DISTINCT nome FROM ({NAMES})) n, ({LIST}) l WHERE ativo AND (contains(lower(trim(n.nome)), lower(trim(l.nome))) OR contains(lower(trim(l.nome)), lower(trim(n.nome))))) WHERE r = 1""")
def allow_match_first(spark, sf):
    return A.match_first(names(spark, sf), listed(spark, sf))


@query(f"SELECT tipo, count(*) FILTER (WHERE ativo) AS ativos FROM ({LIST}) GROUP BY tipo")
def allow_stats(spark, sf):
    return A.stats(listed(spark, sf))


@query(f"""SELECT k, CASE WHEN k % 3 > 0 AND (nome IN ({SUBSET_SQL}) OR lower(trim(nome)) IN (SELECT lower(trim(nome)) FROM ({LIST}) WHERE ativo)) THEN 'ignorado' ELSE 'anonimizado' END AS status FROM ({NAMES})""")
def allow_route(spark, sf):
    f = names(spark, sf).selectExpr("k", "nome AS valor", "CASE WHEN k % 3 > 0 THEN 'PESSOA' ELSE 'ORGANIZACAO' END AS tipo")
    return A.route(f, listed(spark, sf)).select("k", "status")


FINDING = "SELECT l_orderkey % 50 AS job_id, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber % 2 = 0 THEN 'ABC' ELSE 'abc' END || l_partkey % 20 AS valor, CAST(l_linenumber AS INTEGER) AS pagina, CAST(l_quantity AS DOUBLE) / 2 AS x0, CAST(l_suppkey % 10 AS DOUBLE) / 4 AS y0, CASE l_partkey % 3 WHEN 0 THEN 'CPF' WHEN 1 THEN 'PESSOA' ELSE 'EMAIL' END AS tipo FROM lineitem"


def findings(spark, sf) -> DataFrame:
    table(spark, sf, "lineitem").createOrReplaceTempView("_lineitem")
    return spark.sql(FINDING.replace("FROM lineitem", "FROM _lineitem"))


@query(f"""SELECT job_id, seq, valor, pagina FROM (SELECT *, row_number() OVER (PARTITION BY job_id, lower(valor), pagina, round_even(x0, 0), round_even(y0, 0) ORDER BY seq) AS r FROM ({FINDING})) WHERE r = 1""")
def span_dedupe(spark, sf):
    return spans.dedupe_findings(findings(spark, sf), ["seq"]).select("job_id", "seq", "valor", "pagina")


RANGE_A = "SELECT l_orderkey AS doc_id, l_linenumber AS seq, CAST(l_partkey % 100 AS INTEGER) AS ini, CAST(l_partkey % 100 + 5 + l_suppkey % 7 AS INTEGER) AS fim FROM lineitem WHERE l_linenumber % 2 = 0"
RANGE_B = RANGE_A.replace("% 2 = 0", "% 2 = 1")


def ranges(spark, sf, which: str) -> DataFrame:
    table(spark, sf, "lineitem").createOrReplaceTempView("_lineitem")
    return spark.sql(which.replace("FROM lineitem", "FROM _lineitem"))


@query(f"SELECT * FROM ({RANGE_A}) a WHERE NOT EXISTS (SELECT 1 FROM ({RANGE_B}) b WHERE a.doc_id = b.doc_id AND a.ini < b.fim AND a.fim > b.ini)")
def span_overlap_anti(spark, sf):
    return spans.overlap_anti(ranges(spark, sf, RANGE_A), ranges(spark, sf, RANGE_B))


@query("SELECT doc_id, CAST(i AS INTEGER) AS chunk, CAST(i * 3300 AS INTEGER) AS ini, substr(text, i * 3300 + 1, 3500) AS texto FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 3300 + 1)) AS i FROM documents WHERE length(text) > 0)")
def chunk_spans(spark, sf):
    return spans.chunks(table(spark, sf, "documents"), 3500, 200)


@query("SELECT c_custkey AS k, substr(c_name, 1, 3) || '***' AS m, CASE WHEN length(CAST(c_custkey AS VARCHAR)) <= 4 THEN '***' ELSE substr(CAST(c_custkey AS VARCHAR), 1, 3) || '***' END AS u, CASE WHEN length(c_name) > 15 THEN substr(c_name, 1, 12) || '...' ELSE c_name END AS e, substr(sha256(c_name), 1, 16) || '...' AS h FROM customer")
def mask_values(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("k"), T.mask3(F.col("c_name")).alias("m"), T.mask_long(F.col("c_custkey").cast("string")).alias("u"), T.ellipsis(F.col("c_name"), 15).alias("e"), T.hash_label(F.sha2("c_name", 256)).alias("h"))


def stream_sql(i: int, n: int, value: str = "v", seed: str = "'j'") -> str:
    return f"(CAST('0x' || substr(sha256({seed} || ':' || {value} || ':{i}'), 1, 8) AS BIGINT) % {n})"


_NINE = " || ".join(f"CAST({stream_sql(i, 10)} AS VARCHAR)" for i in range(9))


@query(f"""SELECT k, substr(c, 1, 3) || '.' || substr(c, 4, 3) || '.' || substr(c, 7, 3) || '-' || substr(c, 10, 2) AS falso FROM (SELECT k, b || d1 || {digits_sql("(b || d1)", T.CPF2)} AS c
 FROM (SELECT k, b, CAST({digits_sql("b", T.CPF1)} AS VARCHAR) AS d1 FROM (SELECT k, {_NINE} AS b FROM (SELECT c_custkey AS k, c_name AS v FROM customer))))""")
def pseudonym_cpf(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("k"), transform.pseudonym(F.lit("j"), F.lit("CPF"), F.col("c_name")).alias("falso"))


def words_sql(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"""SELECT k, {words_sql(transform.MALE)}[{stream_sql(0, len(transform.MALE))} + 1] || ' ' || {words_sql(transform.SURNAMES)}[{stream_sql(1, len(transform.SURNAMES))} + 1] || ' ' || {words_sql(transform.SURNAMES)}[{stream_sql(2, len(transform.SURNAMES))} + 1] AS falso
 FROM (SELECT c_custkey AS k, c_name AS v FROM customer)""")
def pseudonym_name(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("k"), transform.pseudonym(F.lit("j"), F.lit("PESSOA"), F.col("c_name")).alias("falso"))


_CEP = " || ".join(f"CAST({stream_sql(i, 10, seed='CAST(job_id AS VARCHAR)')} AS VARCHAR)" if i != 5 else "'-'" for i in range(9))


@query(f"SELECT job_id, v AS valor_original, {_CEP} AS valor_pseudonimo, substr(sha256(v), 1, 16) AS hash_original FROM (SELECT DISTINCT job_id, valor AS v FROM ({FINDING}))")
def pseudonym_mapping(spark, sf):
    f = findings(spark, sf).withColumn("tipo", F.lit("CEP"))
    return transform.mapping(f).drop("tipo")


@query("""SELECT doc_id, termo, tipo, CAST(i AS INTEGER) AS ini FROM (SELECT doc_id, text, unnest(range(0, length(text))) AS i, termo, tipo FROM documents, (VALUES ('the', 'PESSOA'), ('anan', 'OUTRO'), ('ção', 'OUTRO')) t(termo, tipo) WHERE contains(text, termo)) WHERE substr(text, CAST(i + 1 AS BIGINT), length(termo)) = termo""")
def custom_terms_all_hits(spark, sf):
    terms = spark.createDataFrame([("the", "PESSOA"), (" anan ", None), ("ção", None), ("  ", "X")], "termo string, tipo string")
    return transform.custom_terms(table(spark, sf, "documents"), terms).select("doc_id", "termo", "tipo", "ini")


@query(f"SELECT job_id, seq, valor FROM ({FINDING}) WHERE seq % 3 = 0")
def selective_review(spark, sf):
    f = findings(spark, sf)
    return transform.selected(f, f.select("job_id", "seq", (F.col("seq") % 3 == 0).alias("selected"))).select("job_id", "seq", "valor")


@query(f"""SELECT CASE WHEN grouping(tipo) = 0 THEN 'tipo' WHEN grouping(pagina) = 0 THEN 'pagina' ELSE 'total' END AS nivel, tipo, pagina, count(*) AS n FROM ({FINDING}) GROUP BY GROUPING SETS ((tipo), (pagina), ())""")
def stats_grouping_sets(spark, sf):
    return transform.stats(findings(spark, sf))


LOG = """SELECT CAST(o_orderkey % 5000 AS VARCHAR) AS job_id, o_orderkey AS line_no, CAST(o_orderdate AS VARCHAR) AS dia, CAST(floor(o_totalprice) AS BIGINT) AS tempo_processamento_ms, CAST(o_custkey % 40 AS BIGINT) AS total_redacoes,
 sha256(o_orderstatus) AS hash_original, sha256(o_orderpriority) AS hash_anonimizado, o_orderpriority AS regra FROM orders"""
LOG_SPARK = LOG.replace("sha256(o_orderstatus)", "sha2(o_orderstatus, 256)").replace("sha256(o_orderpriority)", "sha2(o_orderpriority, 256)").replace("FROM orders", "FROM _orders").replace("VARCHAR", "STRING")


def log(spark, sf) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("_orders")
    return spark.sql(LOG_SPARK)


LAST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY line_no DESC) AS r FROM ({LOG})) WHERE r = 1"


@query(f"SELECT job_id, line_no, total_redacoes FROM ({LAST})")
def audit_last_write(spark, sf):
    return audit.last_write(log(spark, sf)).select("job_id", "line_no", "total_redacoes")


@query(f"SELECT count(*) AS jobs, CAST(sum(total_redacoes) AS BIGINT) AS redacoes, CAST(floor(sum(tempo_processamento_ms) / count(*)) AS BIGINT) AS media_ms FROM ({LAST})")
def audit_stats(spark, sf):
    return audit.statistics(audit.last_write(log(spark, sf)))


@query(f"SELECT regra, count(*) AS jobs FROM ({LAST}) GROUP BY regra")
def audit_jobs_by_rule(spark, sf):
    return audit.jobs_by_rule(audit.last_write(log(spark, sf)).withColumn("regras_aplicadas", F.array("regra", "regra")))


@query(f"SELECT job_id, line_no FROM ({LOG}) WHERE substr(dia, 1, 10) BETWEEN '1995-01-01' AND '1996-12-31' AND line_no % 9 <> 0")
def audit_by_date(spark, sf):
    stamp = F.when(F.col("line_no") % 9 == 0, F.lit("sem data")).when(F.col("line_no") % 2 == 0, F.concat(F.substring("dia", 1, 10), F.lit("T12:00:00Z"))).otherwise(F.concat(F.substring("dia", 1, 10), F.lit("T09:00:00-03:00")))
    return audit.between(log(spark, sf).withColumn("timestamp", stamp), "1995-01-01T00:00:00Z", "1996-12-31T23:59:59Z").select("job_id", "line_no")


CHECKED = "SELECT CAST(c_custkey AS VARCHAR) AS job_id, CASE c_custkey % 3 WHEN 0 THEN sha256('O') WHEN 1 THEN sha256('x') ELSE sha256('2-HIGH') END AS hash FROM customer"


@query(f"""SELECT f.job_id, CASE WHEN l.job_id IS NULL THEN 'nao_encontrado' WHEN f.hash = hash_original THEN 'original' WHEN f.hash = hash_anonimizado THEN 'anonimizado' ELSE 'divergente' END AS veredito FROM ({CHECKED}) f LEFT JOIN ({LAST}) l USING (job_id)""")
def audit_verify(spark, sf):
    h = F.expr("CASE c_custkey % 3 WHEN 0 THEN sha2('O', 256) WHEN 1 THEN sha2('x', 256) ELSE sha2('2-HIGH', 256) END")
    return audit.verify(table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("job_id"), h.alias("hash")), log(spark, sf))


@query(f"SELECT job_id, tipo, substr(sha256(valor), 1, 16) AS hash FROM ({FINDING})")
def digest16(spark, sf):
    return audit.digest(findings(spark, sf))


WORDS = """SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, w[i] AS palavra FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents))"""


@query(WORDS)
def word_offsets(spark, sf):
    return dataset.words(table(spark, sf, "documents")).select("doc_id", "i", "palavra")


#: Each customer's sentence of six five-letter words at known offsets, with two entities.
IOB = """SELECT k AS doc_id, i, CASE WHEN i BETWEEN k % 3 + 1 AND k % 3 + 2 AND k % 4 > 0 THEN CASE WHEN i = k % 3 + 1 THEN 'B-LOCAL' ELSE 'I-LOCAL' END WHEN i BETWEEN k % 3 AND k % 3 + 1 THEN CASE WHEN i = k % 3 THEN 'B-PESSOA' ELSE 'I-PESSOA' END ELSE 'O' END AS label
FROM (SELECT c_custkey AS k, unnest(range(0, 6)) AS i FROM customer)"""


def tagged(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"))
    w = dataset.words(c.withColumn("text", F.lit("aaaaa bbbbb ccccc ddddd eeeee fffff")))
    at = (F.col("doc_id") % 3).cast("int")
    ent = F.array(
        F.struct(F.lit(1).alias("ent"), F.lit("PESSOA").alias("label"), (at * 6).alias("ini"), (at * 6 + 11).alias("fim")),
        F.struct(F.lit(2).alias("ent"), F.when(F.col("doc_id") % 4 > 0, "LOCAL").otherwise("DATA").alias("label"), (at * 6 + 4).alias("ini"), (at * 6 + 17).alias("fim")),
    )
    return dataset.iob2(w, c.select("doc_id", F.explode(ent).alias("e")).select("doc_id", "e.*")).select("doc_id", "i", "label")


@query(IOB.replace("unnest(range(0, 6)) AS i", "CAST(unnest(range(0, 6)) AS INTEGER) AS i"))
def iob2_labels(spark, sf):
    return tagged(spark, sf)


@query("""SELECT k AS doc_id, t AS tipo, CAST(ini AS INTEGER) AS ini, CAST(fim AS INTEGER) AS fim FROM (SELECT c_custkey AS k, 'PESSOA' AS t, c_custkey % 3 AS ini, c_custkey % 3 + CASE WHEN c_custkey % 4 > 0 THEN 1 ELSE 2 END AS fim FROM customer
UNION ALL SELECT c_custkey, 'LOCAL', c_custkey % 3 + 1, c_custkey % 3 + 3 FROM customer WHERE c_custkey % 4 > 0)""")
def iob2_decode(spark, sf):
    return evaluate.decode_iob2(tagged(spark, sf), "label")


@query("""SELECT k AS doc_id, CAST(j AS INTEGER) AS janela, CAST(j * 382 AS INTEGER) AS ini, CAST(least(510, n - j * 382) AS INTEGER) AS n FROM (SELECT k, n, unnest(range(0, CAST(ceil(greatest(n - 510, 0) / 382.0) AS BIGINT) + 1)) AS j FROM (SELECT c_custkey AS k, c_custkey % 1500 + 1 AS n FROM customer))""")
def token_windows(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.sequence(F.lit(0), (F.col("c_custkey") % 1500).cast("int")).alias("ids"))
    return dataset.windows(c).select("doc_id", "janela", "ini", F.size("ids").alias("n"))


SPLIT = "SELECT doc_id, CASE WHEN h < 0.70 THEN 'train' WHEN h < 0.85 THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT AS DOUBLE) / 4294967295.0 AS h FROM documents)"


@query(SPLIT)
def split_hash(spark, sf):
    return dataset.split(table(spark, sf, "documents")).select("doc_id", "split")


@query(f"SELECT split, count(*) AS n FROM ({SPLIT}) GROUP BY split")
def split_counts(spark, sf):
    return dataset.split(table(spark, sf, "documents")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


LABEL_GRID = "(VALUES " + ", ".join(f"({k}, '{x}')" for k, x in enumerate(dataset.LABELS)) + ") g(id, label)"
FREQ = f"SELECT id, label, coalesce(n, 0) AS n FROM {LABEL_GRID} LEFT JOIN (SELECT label, count(*) AS n FROM ({IOB}) GROUP BY label) USING (label)"


@query(FREQ)
def label_freq(spark, sf):
    return dataset.label_counts(tagged(spark, sf))


@query(f"SELECT id, label, round(w / avg(w) OVER (), 6) AS peso FROM (SELECT *, (sum(greatest(n, 1)) OVER ())::DOUBLE / (count(*) OVER () * greatest(n, 1)) * CASE WHEN label = 'O' THEN 1.0 ELSE 3.0 END AS w FROM ({FREQ}))")
def class_weights(spark, sf):
    return dataset.class_weights(dataset.label_counts(tagged(spark, sf)))


def graded(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Truth every 20 characters; detections shifted by seq % 4, every seventh dropped, every eleventh twice."""
    keys = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    li = keys.repartition(evaluate.tasks_for(keys), "l_orderkey", "l_linenumber").distinct().select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("seq"), (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("k"))
    tipo = F.expr("CASE k % 3 WHEN 0 THEN 'PESSOA' WHEN 1 THEN 'LOCAL' ELSE 'ORGANIZACAO' END")
    truth = li.select("doc_id", "seq", tipo.alias("tipo"), (F.col("seq") * 20).alias("ini"), (F.col("seq") * 20 + 10).alias("fim"))
    moved = li.where("k % 7 > 0").select("doc_id", "seq", tipo.alias("tipo"), (F.col("seq") * 20 + F.col("k") % 5).alias("ini"), (F.col("seq") * 20 + 10 + F.col("k") % 5).alias("fim"))
    extra = li.where("k % 11 = 0").select("doc_id", (F.col("seq") + 100).alias("seq"), tipo.alias("tipo"), (F.col("seq") * 20 + 12).alias("ini"), (F.col("seq") * 20 + 18).alias("fim"))
    return truth, moved.union(extra)


TIPO = "CASE k % 3 WHEN 0 THEN 'PESSOA' WHEN 1 THEN 'LOCAL' ELSE 'ORGANIZACAO' END"
GRADED = f"""(SELECT DISTINCT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS seq, l_orderkey * 7 + l_linenumber AS k, {TIPO} AS tipo FROM lineitem)"""
HIT = "k % 7 > 0 AND k % 5 <= 3"
OUTCOME = f"""SELECT doc_id, tipo, CASE WHEN {HIT} THEN 'TP' ELSE 'FN' END AS outcome FROM {GRADED} UNION ALL SELECT doc_id, tipo, 'FP' FROM {GRADED} WHERE k % 7 > 0 AND k % 5 > 3 UNION ALL SELECT doc_id, tipo, 'FP' FROM {GRADED} WHERE k % 11 = 0"""


@query(f"SELECT doc_id, seq AS gt, seq AS det FROM {GRADED} WHERE {HIT}")
def eval_match(spark, sf):
    return evaluate.match(*graded(spark, sf))


PRF = """SELECT {k} tp, fn, fp, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 4) AS f1 FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fn) END AS r
 FROM (SELECT {k} count(*) FILTER (WHERE outcome = 'TP') AS tp, count(*) FILTER (WHERE outcome = 'FN') AS fn, count(*) FILTER (WHERE outcome = 'FP') AS fp FROM ({o}) {g}))"""


@query(PRF.format(k="tipo,", o=OUTCOME, g="GROUP BY tipo"))
def eval_prf_by_type(spark, sf):
    return evaluate.prf(evaluate.outcomes(*graded(spark, sf)), "tipo")


@query(PRF.format(k="", o=OUTCOME, g=""))
def eval_micro(spark, sf):
    return evaluate.prf(evaluate.outcomes(*graded(spark, sf)))


@query(f"SELECT count(*) AS docs, count(*) FILTER (WHERE fn = 0) AS limpos, round(avg(CASE WHEN fn = 0 THEN 1.0 ELSE 0.0 END), 4) AS taxa FROM (SELECT doc_id, count(*) FILTER (WHERE outcome = 'FN') AS fn FROM ({OUTCOME}) GROUP BY doc_id)")
def zero_leak(spark, sf):
    return evaluate.zero_leak(evaluate.outcomes(*graded(spark, sf)))


@query(f"SELECT doc_id, count(*) AS fn FROM ({OUTCOME}) WHERE outcome = 'FN' GROUP BY doc_id ORDER BY doc_id LIMIT 10")
def leaking_top10(spark, sf):
    return evaluate.leaking(evaluate.outcomes(*graded(spark, sf)))


@query(f"SELECT fonte, tp, round(100.0 * tp / sum(tp) OVER (), 4) AS pct FROM (SELECT CASE seq % 2 WHEN 0 THEN 'regex' ELSE 'ner' END AS fonte, count(*) AS tp FROM {GRADED} WHERE {HIT} GROUP BY 1)")
def eval_by_source(spark, sf):
    m = evaluate.match(*graded(spark, sf))
    return evaluate.by_source(m.withColumn("fonte", F.when(F.col("det") % 2 == 0, "regex").otherwise("ner")))


@query("""SELECT CASE WHEN toxic > 0 THEN 'toxico' ELSE 'limpo' END AS "true", count(*) FILTER (WHERE quality = 0) AS limpo, count(*) FILTER (WHERE quality = 1) AS toxico FROM labels GROUP BY 1 UNION ALL SELECT 'outro', 0, 0""")
def confusion_matrix(spark, sf):
    rows = table(spark, sf, "labels").select(F.when(F.col("toxic") > 0, "toxico").otherwise("limpo").alias("true"), F.when(F.col("quality") == 0, "limpo").otherwise("toxico").alias("pred"))
    return evaluate.confusion(rows, ["limpo", "toxico", "outro"]).drop("outro")


ENTS = "SELECT DISTINCT l_orderkey % 500 AS doc_id, l_returnflag AS tipo, CAST(l_linenumber AS INTEGER) AS ini, CAST(l_linenumber + 2 AS INTEGER) AS fim FROM lineitem WHERE l_partkey % {0} > 0"


@query(f"SELECT 'FN' AS outcome, * FROM (({ENTS.format(3)}) EXCEPT ({ENTS.format(5)})) UNION ALL SELECT 'FP', * FROM (({ENTS.format(5)}) EXCEPT ({ENTS.format(3)}))")
def set_missed_false_alarm(spark, sf):
    t, p = (ranges(spark, sf, ENTS.format(n)) for n in (3, 5))
    return evaluate.strict(t, p).where("outcome <> 'TP'").select("outcome", "doc_id", "tipo", "ini", "fim")


BOXES = "SELECT doc_id, CAST((i - 1) // 600 + 1 AS INTEGER) AS pagina, i AS seq, w[i] AS texto, 10.0 * ((i - 1) % 12) AS x0, 14.0 * ((i - 1) % 600 // 12) AS y0 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents))"


def boxes(spark, sf) -> DataFrame:
    w = dataset.words(table(spark, sf, "documents"))
    i = F.col("i")
    return w.select("doc_id", (F.floor(i / 600) + 1).cast("int").alias("pagina"), (i + 1).cast("long").alias("seq"), F.col("palavra").alias("texto"), (F.lit(10.0) * (i % 12)).alias("x0"), (F.lit(14.0) * F.floor((i % 600) / 12)).alias("y0"))


def asked(spark, sf) -> DataFrame:
    """The document's third word, and its third and fourth, as entities."""
    w = boxes(spark, sf).where("seq in (3, 4)").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "texto"))).alias("w"))
    third = F.transform(F.filter("w", lambda s: s["seq"] == 3), lambda s: F.struct(F.lit(1).alias("ent"), s["texto"].alias("valor")))
    both = F.when(F.size("w") == 2, F.array(F.struct(F.lit(2).alias("ent"), F.array_join("w.texto", " ").alias("valor"))))
    return w.select("doc_id", F.explode(F.concat(third, F.coalesce(both, F.array().cast("array<struct<ent:int,valor:string>>")))).alias("e")).select("doc_id", "e.*")


ASKED = f"(SELECT doc_id, 1 AS ent, texto AS valor FROM ({BOXES}) WHERE seq = 3 UNION ALL SELECT doc_id, 2, string_agg(texto, ' ' ORDER BY seq) FROM ({BOXES}) WHERE seq IN (3, 4) GROUP BY doc_id HAVING count(*) = 2)"
# A run of two words, with both places: the query's entities have two words at most.
RUNS = f"(SELECT doc_id, pagina, seq AS run, min(seq) OVER (PARTITION BY doc_id, pagina) AS page_first, row_number() OVER (PARTITION BY doc_id, pagina ORDER BY round_even(y0 / 5, 0) * 5, x0, seq) AS pos, lower(texto) || ' ' || lower(lead(texto) OVER o) AS phrase, lead(seq) OVER o AS second FROM ({BOXES}) WINDOW o AS (PARTITION BY doc_id, pagina ORDER BY round_even(y0 / 5, 0) * 5, x0, seq))"


@query(f"SELECT e.doc_id, e.ent, r.pagina, r.run, unnest([r.run, r.second]) AS seq FROM {ASKED} e JOIN {RUNS} r ON e.doc_id = r.doc_id AND lower(e.valor) = r.phrase WHERE ent = 2")
def locate_multiword(spark, sf):
    return geometry.multiword(boxes(spark, sf), asked(spark, sf))


# The rule of each tier as it is defined, over all words of the document.
CASCADE = f"""WITH e AS (SELECT *, lower(trim(valor)) AS v FROM {ASKED}), w AS (SELECT doc_id, pagina, seq, lower(texto) AS t FROM ({BOXES})),
 p AS (SELECT e.doc_id, ent, 1 AS tier, 0 AS r1, seq AS r2, pagina, [seq] AS seqs FROM e JOIN w USING (doc_id) WHERE t = v
  UNION ALL SELECT e.doc_id, ent, 2, 0, seq, pagina, [seq] FROM e JOIN w USING (doc_id) WHERE contains(t, v)
  UNION ALL SELECT e.doc_id, ent, 3, page_first, pos, pagina, [run, second] FROM e JOIN {RUNS} r ON e.doc_id = r.doc_id AND v = phrase WHERE ent = 2
  UNION ALL SELECT e.doc_id, ent, 4, 0, seq, pagina, [seq] FROM e JOIN w USING (doc_id) WHERE t = string_split(v, ' ')[1] OR starts_with(t, string_split(v, ' ')[1] || ' '))
 SELECT doc_id, ent, tier, pagina, unnest(seqs) AS seq FROM (SELECT *, {{rank}} AS r FROM p) WHERE r = 1"""


@query(CASCADE.format(rank="row_number() OVER (PARTITION BY doc_id, ent ORDER BY tier, r1, r2)"))
def locate_cascade(spark, sf):
    return geometry.locate(boxes(spark, sf), asked(spark, sf))


@query(CASCADE.format(rank="dense_rank() OVER (PARTITION BY doc_id, ent ORDER BY tier)"))
def locate_all_places(spark, sf):
    return geometry.locate(boxes(spark, sf), asked(spark, sf), "all")


@query(f"SELECT doc_id, pagina, CAST(l AS INTEGER) AS linha, string_agg(texto, ' ' ORDER BY x0, seq) AS texto FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id, pagina ORDER BY y0) - 1 AS l FROM (SELECT * REPLACE (y0 * 2 AS y0) FROM ({BOXES}))) GROUP BY doc_id, pagina, l")
def line_assembly(spark, sf):
    return geometry.lines(boxes(spark, sf).select("doc_id", "pagina", F.col("x0").cast("int").alias("x"), (F.col("y0") * 2).cast("int").alias("y"), F.col("seq"), "texto"))


@query("SELECT p_partkey AS k, round(p_size * 0.24::DOUBLE, 6) AS x0, round((3000 - p_partkey % 2000 - 40) * 0.24::DOUBLE, 6) AS y0, round((p_size + 30) * 0.24::DOUBLE, 6) AS x1, round((3000 - p_partkey % 2000) * 0.24::DOUBLE, 6) AS y1 FROM part")
def pixel_to_points(spark, sf):
    p = table(spark, sf, "part")
    b = geometry.to_points(F.col("p_size"), F.col("p_partkey") % 2000, F.lit(30), F.lit(40), F.lit(3000), 300, True)
    return p.select(F.col("p_partkey").alias("k"), b.alias("b")).select("k", *[F.round(f"b.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("""SELECT k, round(s, 6) AS tamanho, CASE WHEN 0.55 * s * n <= w - 2 THEN t ELSE substr(t, 1, greatest(CAST(floor((w - 2) / 3.3) AS BIGINT), 0)) END AS texto FROM (SELECT *, CASE WHEN 0.55 * s0 * n > w - 2 THEN greatest((w - 2) / (0.55 * n), 6.0) ELSE s0 END AS s
 FROM (SELECT p_partkey AS k, p_name AS t, length(p_name) AS n, CAST(p_size * 3 + 10 AS DOUBLE) AS w, least(greatest((p_size / 2.0 - 2) * 0.8, 6.0), 12.0)::DOUBLE AS s0 FROM part))""")
def font_fit(spark, sf):
    p = table(spark, sf, "part")
    f = geometry.font_fit((F.col("p_size") * 3 + 10).cast("double"), F.col("p_size") / 2.0, F.col("p_name"))
    return p.select(F.col("p_partkey").alias("k"), f.alias("f")).select("k", F.round("f.tamanho", 6).alias("tamanho"), "f.texto")


@query(f"SELECT CASE tipo WHEN 'PESSOA' THEN 'Pessoas' WHEN 'CPF' THEN 'Documentos' ELSE 'Contato' END AS grupo, count(*) AS n FROM ({FINDING}) GROUP BY 1")
def ui_buckets(spark, sf):
    return review.grouped(findings(spark, sf))


@query("SELECT event_id FROM events WHERE epoch(ts) < (SELECT max(floor(epoch(ts))) FROM events) - 86400")
def ttl_expired(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").alias("modified"))
    now = e.agg(F.max("modified")).first()[0]
    return progress.expired(e, F.lit(now)).select("event_id")


@query("SELECT user_id AS ip, count(*) AS n, min(epoch(date_trunc('hour', ts)))::BIGINT AS inicio FROM events GROUP BY user_id, date_trunc('hour', ts) HAVING count(*) > 2")
def rate_limit_window(spark, sf):
    calls = table(spark, sf, "events").select("ts", F.col("user_id").alias("ip"))
    return progress.over_limit(calls, 2, "1 hour").select("ip", "n", F.unix_timestamp("inicio").alias("inicio"))


STAGE = "CASE event_id % 6 WHEN 0 THEN 'upload' WHEN 1 THEN 'extraction' WHEN 2 THEN 'detection' WHEN 3 THEN 'redaction' WHEN 4 THEN 'finalization' ELSE 'outra' END"
PERCENT = f"""SELECT event_id, user_id, {STAGE} AS etapa, least(CASE event_id % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 5.0 WHEN 2 THEN 45.0 WHEN 3 THEN 85.0 WHEN 4 THEN 95.0 ELSE 0.0 END + CASE WHEN event_id % 5 > 0 THEN event_id % 5 / 4.0 ELSE 1.0 END * CASE event_id % 6 WHEN 0 THEN 5 WHEN 1 THEN 40 WHEN 2 THEN 40 WHEN 3 THEN 10 WHEN 4 THEN 5 ELSE 0 END, 100.0)::DOUBLE AS porcentagem FROM events"""


def updates(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", F.expr(STAGE).alias("etapa"))
    return e.withColumn("porcentagem", progress.percent(F.col("etapa"), F.col("event_id") % 5, F.lit(4)))


@query(f"SELECT event_id, etapa, porcentagem FROM ({PERCENT})")
def progress_percent(spark, sf):
    return updates(spark, sf).select("event_id", "etapa", "porcentagem")


@query(f"SELECT user_id AS job_id, arg_max(etapa, event_id) AS etapa, arg_max(porcentagem, event_id) AS porcentagem, max(event_id) AS seq FROM ({PERCENT}) GROUP BY user_id")
def progress_latest(spark, sf):
    return progress.latest(updates(spark, sf).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "etapa", "porcentagem"))


@query("SELECT page_id, coalesce(nullif(regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '[^\\w\\-.]', '_', 'g'), ''), 'upload') AS nome FROM pages")
def filename_sanitize(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.sanitized(F.col("url")).alias("nome"))


@query(f"SELECT doc_id, CASE WHEN avg(n) >= 100 THEN 'nativo' ELSE 'imagem' END AS tipo, count(*) AS total_paginas FROM (SELECT doc_id, pagina, length(string_agg(texto, ' ' ORDER BY seq)) AS n FROM ({BOXES}) GROUP BY doc_id, pagina) GROUP BY doc_id")
def native_vs_scanned(spark, sf):
    return files.full_text(files.pages_text(boxes(spark, sf))).select("doc_id", "tipo", "total_paginas")


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS classe FROM embeddings")
def logits_argmax(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", dataset.argmax(F.col("embedding")).alias("classe"))


SIZES = "SELECT event_id, CAST(floor(value * 1000 * (event_id % 5000)) AS BIGINT) AS n FROM events"
TENTH = "printf('%.1f', floor(n / {0}.0 * 10 + 0.5) / 10)"


@query(f"SELECT event_id, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN {TENTH.format(1024)} || ' KB' WHEN n IS NOT NULL THEN {TENTH.format(1048576)} || ' MB' END AS tamanho FROM ({SIZES})")
def file_sizes(spark, sf):
    """Bytes, kB and MB of all events; a missing size is none."""
    n = F.floor(F.col("value") * 1000 * (F.col("event_id") % 5000))
    return table(spark, sf, "events").select("event_id", T.file_size(n).alias("tamanho"))


@query()
def signature_clusters(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey % 40 AS doc_id", "CAST(p_size % 3 AS INT) AS pagina", "p_partkey AS seq", "CAST(p_partkey * 37 % 900 AS INT) AS x", "CAST(p_partkey * 91 % 700 AS INT) AS y", "10 AS largura", "8 AS altura")
    return geometry.clusters(p)


@query(f"SELECT job_id, seq, tipo, substr(valor, 1, 3) || '***' AS valor, x0 AS x, y0 AS y, x0 AS width, y0 + 1 AS height FROM ({FINDING})")
def api_answer(spark, sf):
    f = findings(spark, sf).withColumn("x1", F.col("x0") * 2).withColumn("y1", F.col("y0") * 2 + 1)
    return review.answer(f).select("job_id", "seq", "tipo", "valor", "posicao.x", "posicao.y", "posicao.width", "posicao.height")


@query(f"SELECT job_id AS doc_id, tipo, count(*) AS n, count(*) FILTER (WHERE y0 > 0.8) AS seguras, min(seq) AS primeiro FROM ({FINDING}) GROUP BY job_id, tipo")
def entities_by_type(spark, sf):
    e = findings(spark, sf).selectExpr("job_id AS doc_id", "tipo", "valor", "seq AS ini", "seq + 1 AS fim", "y0 AS score")
    return review.by_type(e).select("doc_id", "tipo", "n", "seguras", F.col("entidades")[0]["ini"].alias("primeiro"))


@query(f"SELECT job_id, string_agg(tipo, ',' ORDER BY tipo) AS regras FROM (SELECT DISTINCT job_id, tipo FROM ({FINDING}) UNION SELECT DISTINCT job_id, 'OUTRO' FROM ({FINDING}) WHERE job_id % 3 = 0) GROUP BY job_id")
def applied_rules(spark, sf):
    f = findings(spark, sf)
    return review.applied_rules(f, f.where("job_id % 3 = 0")).select("job_id", F.array_join("regras", ",").alias("regras"))


@query(f"SELECT job_id, count(*) + count(*) FILTER (WHERE pagina = 1) AS identificados, count(*) FILTER (WHERE seq % 3 = 0) + count(*) FILTER (WHERE pagina = 1) AS aprovados FROM ({FINDING}) GROUP BY job_id")
def review_summary(spark, sf):
    f = findings(spark, sf)
    return review.summary(f, f.select("job_id", "seq", (F.col("seq") % 3 == 0).alias("selected")), f.where("pagina = 1"))


@query(f"SELECT tipo, count(DISTINCT (job_id, valor)) AS n FROM ({FINDING}) GROUP BY tipo")
def mapping_report(spark, sf):
    return transform.mapping_report(transform.mapping(findings(spark, sf))).select("tipo", F.size("itens").cast("bigint").alias("n"))


@query("SELECT page_id, regexp_replace(coalesce(nullif(regexp_extract(url, '([^/]*)$', 1), ''), 'upload'), '\\.[^.]*$', '') || CASE WHEN page_id % 2 = 0 THEN '_pseudonimizado.pdf' ELSE '_anonimizado.pdf' END AS nome FROM pages")
def output_names(spark, sf):
    name = F.coalesce(F.nullif(F.regexp_extract("url", "([^/]*)$", 1), F.lit("")), F.lit("upload"))
    mode = F.when(F.col("page_id") % 2 == 0, "pseudonym").otherwise("redact")
    return table(spark, sf, "pages").select("page_id", review.output_name(name, mode).alias("nome"))


@query(f"SELECT doc_id, seq, greatest(ini - 20, 0) AS x0, least(fim - 20, 50) AS x1 FROM ({RANGE_A}) WHERE least(fim - 20, 50) > greatest(ini - 20, 0)")
def clip_boxes(spark, sf):
    b = ranges(spark, sf, RANGE_A).select("doc_id", "seq", (F.col("ini") - 20).alias("x0"), (F.col("fim") - 20).alias("x1"), F.lit(1).alias("y0"), F.lit(2).alias("y1"))
    return geometry.clipped(b, F.lit(50), F.lit(50)).select("doc_id", "seq", "x0", "x1")


@query("SELECT p_partkey AS k FROM part WHERE p_size * 20 BETWEEN 50 AND 50000 AND 4 * 3.141592653589793::DOUBLE * p_size * 20 / ((p_partkey % 90 + 20) * (p_partkey % 90 + 20)) < 0.5")
def signature_contours(spark, sf):
    p = table(spark, sf, "part")
    return p.where(geometry.signature_like((F.col("p_size") * 20).cast("double"), (F.col("p_partkey") % 90 + 20).cast("double"))).select(F.col("p_partkey").alias("k"))


@query("SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'PESSOA' WHEN 1 THEN 'CPF' ELSE 'OUTRO' END AS tipo FROM customer")
def label_map(spark, sf):
    e = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("gliner").alias("engine"), F.expr("CASE c_custkey % 3 WHEN 0 THEN 'First Name' WHEN 1 THEN 'tax id' ELSE 'unknown' END").alias("label"))
    known = spark.createDataFrame([("gliner", "first_name", "PESSOA"), ("gliner", "tax_id", "CPF")], "engine string, label string, tipo string")
    return detect.mapped_labels(e, known).select("k", "tipo")


@query("SELECT c_custkey AS k, CAST(CASE WHEN c_custkey % 4 = 3 THEN 0 ELSE 1 END AS INTEGER) AS n, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE c_name END AS texto FROM customer")
def llm_salvage(spark, sf):
    body = F.concat(F.lit('[{"texto": "'), F.col("c_name"), F.lit('", "tipo": "pessoa"}]'))
    k = F.col("c_custkey") % 4
    said = F.when(k == 0, body).when(k == 1, F.concat(F.lit('{"entidades": '), body, F.lit("}"))).when(k == 2, F.concat(F.lit("Aqui: "), body, F.lit(" fim"))).otherwise("nada")
    out = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), detect.salvaged_json(said).alias("e"))
    return out.select("k", F.size("e").alias("n"), F.get("e", F.lit(0))["texto"].alias("texto"))


@query("SELECT vec_id, CAST(floor(list_min(list_transform(range(1, 5), lambda i: embedding[i * 2 - 1])) * 1000) AS BIGINT) AS x, CAST(floor(list_min(list_transform(range(1, 5), lambda i: embedding[i * 2])) * 1000) AS BIGINT) AS y FROM embeddings")
def polygon_bbox(spark, sf):
    e = F.col("embedding")
    box = geometry.polygon_box(F.array(*[F.array(e[2 * i], e[2 * i + 1]) for i in range(4)]))
    thousand = F.lit(1000).cast("float")  # a float by an integer is a double here, a float in SQL
    return table(spark, sf, "embeddings").select("vec_id", F.floor(box["x"] * thousand).alias("x"), F.floor(box["y"] * thousand).alias("y"))


@query(f"SELECT tipo, count(*) AS n, count(*) FILTER (WHERE ativo) AS ativos FROM (SELECT * FROM ({LIST}) WHERE seq <> (SELECT min(seq) FROM ({LIST}) WHERE lower(trim(nome)) = 'silva nome 4') UNION ALL SELECT 0, 'Nova Pessoa', 'juiz', true) GROUP BY tipo")
def allow_edit(spark, sf):
    new = spark.createDataFrame([("Nova Pessoa", "juiz", True, 0), (" silva nome 1 ", "advogado", True, 0)], "nome string, tipo string, ativo boolean, seq long")
    out = A.delete(A.insert(listed(spark, sf), new), "SILVA nome 4")
    return out.groupBy("tipo").agg(F.count(F.lit(1)).alias("n"), F.count_if("ativo").alias("ativos"))


@query(f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '{R.REDACTED}', 'g') AS texto FROM documents WHERE regexp_matches(text, '{EMAIL}') AND doc_id IN (SELECT doc_id FROM ({span_sql(EMAIL, 'EMAIL')}))")
def anonymise_emails_selected(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    f = detect.find_by_type(docs, "EMAIL").select(F.col("doc_id").alias("job_id"), F.col("ini").alias("seq"), "tipo", "valor", "ini", "fim")
    out = api.anonymise_selected(docs, f, review.select_all(f.select("job_id", "seq")), spark.createDataFrame([], "termo string, tipo string"))
    return out.join(f.select(F.col("job_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
