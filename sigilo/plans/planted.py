"""A query for each detection rule, over texts that hold its forms, near misses and other words, with the places that SQL finds."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigilo.functions import rules as R
from sigilo.functions import text as T
from sigilo.operators import api, detect, transform

from .catalogue import digits_sql, stream_sql, words_sql
from .registry import query, table


def digits(n: int, by: int = 7919) -> str:
    """SQL for n digits that differ from customer to customer."""
    return f"lpad(CAST((c_custkey * {by} + {by // 3}) % {10**n} AS VARCHAR), {n}, '0')"


def put(form: str) -> str:
    """SQL for a form: # is a run of as many digits as it is long."""
    out, at, by = [], 0, 7919
    while at < len(form):
        end = at
        while end < len(form) and (form[end] == "#") == (form[at] == "#"):
            end += 1
        out.append(digits(end - at, by) if form[at] == "#" else "'" + form[at:end].replace("'", "''") + "'")
        at, by = end, by + 1022
    return " || ".join(out)


# Three texts for each rule, which the customers take by turns.
FORMS = {
    "CPF": ["CPF ###.###.###-## e ###########.", "numero ############ nao", "(###.###.###-##), ###.######-##"],
    "CNPJ": ["CNPJ ##.###.###/####-## e ##############", "conta ##.###.### nao", "##.###.###/####-##; ########/####-##"],
    "PROC_CNJ": ["autos #######-##.####.#.##.#### e #######-##.####.#.##.####", "autos #######-##.#### nao", "#######-##.####.#.##.####"],
    "OAB": ["OAB/MG ###.### e oab ######", "OAB nada", "OAB-SP###A, OAB ####"],
    "EMAIL": ["ana.b#@x.com.br, b_#@y-z.org", "ana@ nada #", "<u###@mail.example.net>"],
    "TELEFONE": ["(##) 9####-#### ou ## #### ####", "ramal ####", "+55 ## 9####.####"],
    "CEP": ["CEP: #####-### e cep ##.###-###", "CEP ####", "C.E.P. ########"],
    "RG": ["RG: MG-##.###.### e rg ########", "nada ####", "Identidade ##.###-#, C.I. ####"],
    "PASSAPORTE": ["Passaporte: AB###### e pass. c#######", "passaporte #######", "PASSAPORTE XY#######"],
    "DATA_NASCIMENTO": ["nascido ##/##/####, DN: #-#-##", "nascida em ##/##/####", "data de nascimento: ##-##-####"],
    "ENDERECO": ["Rua das Flores, ### apto ## e Av. Brasil ####.", "Rua sem numero", "Avenida Central, ### Bloco B; estrada velha ##"],
    "CTPS": ["CTPS: ####### e carteira de trabalho n. #####", "CTPS ###", "ctps ########"],
    "PIS_PASEP": ["PIS: ###.#####.##-# e NIT ###########", "PIS ###", "pasep ###.#####.##-#"],
    "TITULO_ELEITOR": ["Título de Eleitor: #### #### #### e T.E. ############", "Título ####", "título eleitor ############"],
    "CNH": ["CNH: ########### e Permissão para Dirigir #########", "CNH ###", "Carteira Nacional de Habilitação: ##########"],
    "RENAVAM": ["RENAVAM: ########### e renavam #########", "renavam ###", "Renavam. ##########"],
    "PLACA_VEICULO": ["placa ABC-#### e DEF#G##", "placa abc####", "veículo HIJ ####, KLM####"],
    "CONTA_BANCARIA": ["Conta: #####-# e C/C ########.##", "conta ###", "Poupança: ######-##"],
    "AGENCIA": ["Agência: ####-# e ag. ###", "agencia ##", "Agência n. #####"],
    "CHAVE_PIX": ["pix ########-####-####-####-############", "########-####-#### nao", "A#######-b###-c###-D###-e########### fim"],
    "BENEFICIO_INSS": ["benefício: ###.###.###-# e NB ##########", "NB ###", "beneficio ###.###.###-#"],
    "CNS": ["CNS: 7############## e SUS 1##############", "CNS 3##############", "Cartão Nacional de Saúde: 8##############"],
    "SIAPE": ["SIAPE: ####### e matrícula SIAPE #######", "siape ###", "mat. SIAPE #######"],
    "REGISTRO_PROFISSIONAL": ["CRM/MG ##### e crea ######", "CRM ##", "CREFITO-SP.####A, CRO ###"],
    "PESSOA_CONTEXTO": ["Autor: Nome Da Silva e Ré Outra Pessoa #", "autor nome da silva #", "Sr. Nome de Teste Santos, Testemunha: Um Dois #"],
}


def text_sql(tipo: str) -> str:
    a, b, c = map(put, FORMS[tipo])
    return f"SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END AS text FROM customer"


def places_sql(rule: R.Rule, texts: str) -> str:
    """Places from the lengths of matches and of the pieces between them; a group's from the end of its match, else by search."""
    p = ("(?i)" if rule.ignore_case else "") + rule.pattern.replace("'", "''")
    group = detect.group_of(R.rule(rule.tipo))  # the same in every form of a rule
    return f"""SELECT doc_id, '{rule.tipo}' AS tipo, v AS valor, ini, CAST(ini + length(m) AS INTEGER) AS fim, CAST(vi AS INTEGER) AS v_ini, CAST(vi + length(v) AS INTEGER) AS v_fim FROM (
 SELECT doc_id, m, v, ini, CASE WHEN ends_with(m, v) THEN ini + length(m) - length(v) ELSE ini + strpos(m, v) - 1 END AS vi FROM (
  SELECT doc_id, ms[i] AS m, CASE WHEN vs[i] = '' THEN ms[i] ELSE vs[i] END AS v,
   CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS ini
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {group}) AS vs, string_split_regex(text, '{p}') AS g FROM ({texts})))))"""


def _add(tipo: str) -> None:
    compat = tipo == "RG"  # the mended pattern looks ahead, which the SQL dialect can't
    texts = text_sql(tipo)

    @query(places_sql(R.rule(tipo, compat), texts), f"rgx_planted_{tipo.lower()}")
    def run(spark, sf):
        table(spark, sf, "customer").createOrReplaceTempView("_customer")
        docs = spark.sql(texts.replace("FROM customer", "FROM _customer").replace("VARCHAR", "STRING"))
        return detect.find_by_type(docs, tipo, compat).select("doc_id", "tipo", "valor", "ini", "fim", "v_ini", "v_fim")


for _tipo in FORMS:
    _add(_tipo)


EVERY = " || '; ' || ".join(f"({text_sql(t).split(' AS doc_id, ', 1)[1].rsplit(' AS text', 1)[0]})" for t in ("EMAIL", "CEP", "SIAPE", "CTPS", "RENAVAM"))
TEXTS = f"SELECT c_custkey AS doc_id, {EVERY} AS text FROM customer"
TOGETHER = ["EMAIL", "CEP", "CTPS", "RENAVAM", "SIAPE"]


@query(" UNION ALL ".join(places_sql(R.rule(t), TEXTS) for t in TOGETHER))
def rgx_planted_together(spark, sf):
    """Several rules in one scan of the same texts."""
    table(spark, sf, "customer").createOrReplaceTempView("_customer")
    docs = spark.sql(TEXTS.replace("FROM customer", "FROM _customer").replace("VARCHAR", "STRING"))
    return detect.find_all(docs, tipos=TOGETHER).select("doc_id", "tipo", "valor", "ini", "fim", "v_ini", "v_fim")


TOPIC_TEXT = "SELECT c_custkey AS doc_id, 'Sobre ' || " + "(" + "CASE c_custkey % {0} ".format(len(R.TOPICS)) + " ".join(f"WHEN {k} THEN '{w.upper() if k % 2 else w}'" for k, w in enumerate(R.TOPICS)) + " END) || ' e mais ' || " + "(" + "CASE c_custkey % 7 WHEN 0 THEN 'guarda, GUARDA' WHEN 1 THEN 'menores' ELSE 'nada' END) AS text FROM customer"


@query(f"""SELECT doc_id, palavra, CAST(i AS INTEGER) AS ini FROM (SELECT doc_id, palavra, unnest(range(0, length(text))) AS i, lower(text) AS t FROM ({TOPIC_TEXT}), (VALUES {', '.join(f"('{w}')" for w in R.TOPICS)}) w(palavra))
 WHERE substr(t, CAST(i + 1 AS BIGINT), length(palavra)) = palavra""")
def topic_keywords_planted(spark, sf):
    """All words of the sensitive topics, in any case."""
    table(spark, sf, "customer").createOrReplaceTempView("_customer")
    docs = spark.sql(TOPIC_TEXT.replace("FROM customer", "FROM _customer"))
    return detect.topic_keywords(docs).select("doc_id", "palavra", F.col("ini"))


# All rules over the documents. The mended RG looks ahead: its keyword ends at a word's end, or at a point that no word follows.
# The other one takes letters of any script, which the dialect's word class doesn't hold.
RG = R.rule("RG")._replace(pattern=r"\b(?:(?:R\.?G|C\.?I|Identidade|Registro\s+Geral)(?:\.\B|\b))\s*[:º]?\s*([\w.-]*\d[\w.-]*)")
RG_COMPAT = R.rule("RG", True)._replace(pattern=r"(?:R\.?G\.?|C\.?I\.?|Identidade|Registro\s+Geral)\s*[:º]?\s*([\p{L}\p{N}_.-]+)")
VALID = {"CPF": (11, T.CPF1, T.CPF2), "CNPJ": (14, T.CNPJ1, T.CNPJ2)}


def checked_sql(tipo: str, rows: str) -> str:
    """Rows of a type whose check digits are right, if it has such."""
    if tipo not in VALID:
        return rows
    size, first, second = VALID[tipo]
    one = f"CAST({digits_sql(f'substr(d, 1, {size - 2})', first)} AS VARCHAR)"
    two = f"CAST({digits_sql(f'(substr(d, 1, {size - 2}) || c1)', second)} AS VARCHAR)"
    return f"""SELECT * EXCLUDE (d, c1) FROM (SELECT *, {one} AS c1 FROM (SELECT *, regexp_replace(valor, '\\D', '', 'g') AS d FROM ({rows})) WHERE length(d) = {size})
 WHERE d <> repeat(substr(d, 1, 1), {size}) AND substr(d, 1, {size - 2}) || c1 || {two} = d"""


def every_rule_sql(compat: bool) -> str:
    rules = [(RG_COMPAT if compat else RG) if r.tipo == "RG" else r for r in R.rules(compat)]
    return " UNION ALL ".join(f"SELECT *, {k} AS rule_order FROM ({checked_sql(r.tipo, places_sql(r, 'SELECT doc_id, text FROM documents'))})" for k, r in enumerate(rules))


@query(f"SELECT *, 1.0::DOUBLE AS confianca, 'regex' AS fonte FROM ({every_rule_sql(False)})")
def rule_catalogue_all(spark, sf):
    return detect.find_all(table(spark, sf, "documents").select("doc_id", "text"))


@query(f"SELECT tipo, count(*) AS n FROM ({every_rule_sql(True)}) GROUP BY tipo")
def rule_catalogue_compat(spark, sf):
    return detect.find_all(table(spark, sf, "documents").select("doc_id", "text"), compat=True).groupBy("tipo").agg(F.count(F.lit(1)).alias("n"))


def sql_pattern(java: str) -> str:
    return java.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''")


# Places of a value as whole words, in any case: wherever it stands, and no letter, digit or underscore beside it.
def word_places_sql(rows: str) -> str:
    """(doc_id, valor, v_ini, v_fim) of rows (doc_id, text, valor)."""
    beside = lambda at: f"regexp_matches(substr(text, CAST({at} AS BIGINT), 1), '[\\p{{L}}\\p{{N}}_]')"
    return f"""SELECT doc_id, valor, CAST(i AS INTEGER) AS v_ini, CAST(i + length(valor) AS INTEGER) AS v_fim FROM (
  SELECT doc_id, text, valor, unnest(range(0, length(text) - length(valor) + 1)) AS i FROM ({rows}) WHERE contains(lower(text), lower(valor)))
 WHERE lower(substr(text, CAST(i + 1 AS BIGINT), length(valor))) = lower(valor) AND (i = 0 OR NOT {beside("i")}) AND NOT {beside("i + length(valor) + 1")}"""


def parties_sql(docs: str) -> str:
    return word_places_sql(f"""SELECT DISTINCT * FROM (SELECT doc_id, text, trim(string_split_regex(x, '[,;]|\\be\\b|\\bqualificad')[1]) AS valor FROM (
   SELECT doc_id, text, unnest(list_concat({", ".join(f"regexp_extract_all(substr(text, 1, 3000), '{sql_pattern(p)}', 1)" for p in R.HEADER)})) AS x FROM ({docs})))
  WHERE length(valor) > 3 AND upper(valor) NOT IN ('A', 'O', 'OS', 'AS')""")


PARTIES = parties_sql("SELECT doc_id, text FROM documents")


# All findings, and the merged places of a document; a place takes the type and value of its first finding.
PLACES = f"""s AS (SELECT doc_id, CASE tipo WHEN 'PESSOA_CONTEXTO' THEN 'PESSOA' ELSE tipo END AS tipo, valor AS v, v_ini AS ini, v_fim AS fim FROM ({every_rule_sql(False)}) UNION ALL SELECT doc_id, 'PESSOA', valor, v_ini, v_fim FROM ({PARTIES})),
 p AS (SELECT *, max(fim) OVER (PARTITION BY doc_id ORDER BY ini, fim ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM s),
 q AS (SELECT *, sum(CASE WHEN ahead >= ini THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ini, fim ROWS UNBOUNDED PRECEDING) AS grp FROM p),
 m AS (SELECT doc_id, min(ini) AS ini, max(fim) AS fim, first(tipo ORDER BY ini, fim, tipo) AS tipo, first(v ORDER BY ini, fim, tipo) AS v FROM q GROUP BY doc_id, grp)"""


def written_sql(put: str) -> str:
    """Documents with `put`, of a merged place's columns, in the place of each."""
    ahead = "coalesce(lag(fim) OVER (PARTITION BY m.doc_id ORDER BY ini), 0)"
    return f"""WITH {PLACES}, c AS (SELECT m.doc_id, ini, fim, substr(text, {ahead} + 1, ini - {ahead}) || {put} AS piece FROM m JOIN documents USING (doc_id)),
 t AS (SELECT doc_id, string_agg(piece, '' ORDER BY ini) AS head, max(fim) AS last FROM c GROUP BY doc_id)
 SELECT d.doc_id, CASE WHEN t.doc_id IS NULL THEN text ELSE head || substr(text, last + 1) END AS texto FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id"""


@query(written_sql(f"'{R.REDACTED}'"))
def anonymise_documents(spark, sf):
    """The header's parties and what any rule finds, redacted in every document."""
    return api.anonymise(table(spark, sf, "documents"))


def stand_in_sql(tipo: str, seed: str = "'j'") -> str:
    """SQL for the stand-in of a type, from the same stream of SHA-256."""
    stream = lambda i, n: stream_sql(i, n, seed=seed)
    pick = lambda words, i: f"{words_sql(words)}[{stream(i, len(words))} + 1]"
    number = lambda i, low, high: f"CAST({stream(i, high - low + 1)} + {low} AS VARCHAR)"
    digit = lambda i: f"CAST({stream(i, 10)} AS VARCHAR)"
    run = lambda n: "(" + " || ".join(digit(i) for i in range(n)) + ")"
    plain = lambda x: f"translate(lower({x}), 'áàãâéêíóõôúüç', 'aaaaeeiooouuc')"

    def checked(base: str, first: list[int], second: list[int]) -> str:
        one = f"({base} || CAST({digits_sql(base, first)} AS VARCHAR))"
        return f"({one} || CAST({digits_sql(one, second)} AS VARCHAR))"

    if tipo == "CPF":
        return f"regexp_replace({checked(run(9), T.CPF1, T.CPF2)}, '^(...)(...)(...)', '\\1.\\2.\\3-')"
    if tipo == "CNPJ":
        base = "(" + run(8) + " || '0001')"
        return f"regexp_replace({checked(base, T.CNPJ1, T.CNPJ2)}, '^(..)(...)(...)(....)', '\\1.\\2.\\3/\\4-')"
    if tipo in ("PESSOA", "PESSOA_CONTEXTO"):
        women = f"list_contains({words_sql(transform.WOMEN)}, {plain("string_split(v, ' ')[1]")})"
        return f"CASE WHEN {women} THEN {pick(transform.FEMALE, 0)} ELSE {pick(transform.MALE, 0)} END || ' ' || {pick(transform.SURNAMES, 1)} || ' ' || {pick(transform.SURNAMES, 2)}"
    if tipo == "EMAIL":
        return f"{plain(pick(transform.MALE + transform.FEMALE, 0))} || '.' || {plain(pick(transform.SURNAMES, 1))} || {number(2, 1, 999)} || '@' || {pick(transform.DOMAINS, 3)}"
    if tipo == "ENDERECO":
        return f"{pick(transform.STREETS, 0)} || ' ' || {pick(transform.STREET_NAMES, 1)} || ', ' || {number(2, 1, 9999)}"
    if tipo == "DATA_NASCIMENTO":
        day = f"(DATE '1950-01-01' + CAST({stream(0, 22280)} AS INTEGER))"
        return f"CASE WHEN contains(v, '-') THEN strftime({day}, '%Y-%m-%d') ELSE strftime({day}, '%d/%m/%Y') END"
    if tipo == "OAB":
        return f"'OAB/' || {pick(transform.STATES, 0)} || ' ' || {number(1, 10000, 999999)}"
    if tipo == "REGISTRO_PROFISSIONAL":
        council = "CASE " + " ".join(f"WHEN contains(upper(v), '{c}') THEN '{c}'" for c in transform.COUNCILS) + " ELSE 'CRM' END"
        return f"{council} || '/' || {pick(transform.STATES, 0)} || ' ' || {number(1, 10000, 999999)}"
    if tipo not in transform.SHAPES:
        return f"'[{tipo}_ANON]'"
    put = {"#": digit, "@": lambda i: f"substr('{transform.LETTERS}', {stream(i, len(transform.LETTERS))} + 1, 1)", "%": lambda i: f"substr('0123456789abcdef', {stream(i, 16)} + 1, 1)"}
    return " || ".join(put[c](i) if c in put else f"'{c}'" for i, c in enumerate(transform.SHAPES[tipo]))


# A value for each customer: a name of a man or a woman, a day, or a council's number.
VALUE = "CASE c_custkey % 4 WHEN 0 THEN 'Maria da Silva ' || c_custkey WHEN 1 THEN 'Pedro Sá ' || c_custkey WHEN 2 THEN '1980-01-' || c_custkey ELSE 'crea ' || c_custkey END"


@query("SELECT k, tipo, CASE tipo " + " ".join(f"WHEN '{t}' THEN {stand_in_sql(t)}" for t in R.ENTITY_TYPES) + f" END AS falso FROM (SELECT c_custkey AS k, {words_sql(R.ENTITY_TYPES)}[c_custkey % {len(R.ENTITY_TYPES)} + 1] AS tipo, {VALUE} AS v FROM customer)")
def pseudonym_all_types(spark, sf):
    """A stand-in of every type."""
    kinds = F.array(*[F.lit(t) for t in R.ENTITY_TYPES])
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.element_at(kinds, (F.col("c_custkey") % len(R.ENTITY_TYPES) + 1).cast("int")).alias("tipo"), F.expr(VALUE.replace("VARCHAR", "STRING")).alias("v"))
    return c.select("k", "tipo", transform.pseudonym(F.lit("j"), F.col("tipo"), F.col("v")).alias("falso"))


@query(written_sql("CASE tipo " + " ".join(f"WHEN '{t}' THEN {stand_in_sql(t, 'CAST(m.doc_id AS VARCHAR)')}" for t in R.ENTITY_TYPES) + " END"))
def pseudonymise_documents(spark, sf):
    """The same places, with stand-ins drawn from the document's id."""
    return api.anonymise(table(spark, sf, "documents"), "pseudonym")
