"""Golden cases of the rules, and match offsets against Python's re."""

import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigilo.functions import rules as R
from sigilo.functions import scan
from sigilo.functions import text as T
from sigilo.functions.automaton import Automaton
from sigilo.functions.rules import rule
from sigilo.operators import detect, spans, transform

CASES = [
    ("CPF", "O CPF do cliente é 123.456.789-09", ["123.456.789-09"]), ("CPF", "CPF: 12345678909", ["12345678909"]),
    ("CNPJ", "CNPJ: 12.345.678/0001-90", ["12.345.678/0001-90"]), ("CNPJ", "CNPJ 12345678000190", ["12345678000190"]),
    ("PROC_CNJ", "Processo nº 0000123-45.2024.8.13.0024", ["0000123-45.2024.8.13.0024"]),
    ("EMAIL", "Contato: joao.silva@tribunal.jus.br", ["joao.silva@tribunal.jus.br"]),
    ("OAB", "oab/mg 123456", ["oab/mg 123456"]), ("CEP", "CEP: 30123-456", ["30123-456"]), ("CEP", "CEP 30.123-456", ["30.123-456"]),
    ("RG", "RG: MG-12.345.678", ["MG-12.345.678"]), ("CPF", "CPF 1: 123.456.789-09, CPF 2: 987.654.321-00", ["123.456.789-09", "987.654.321-00"]),
    ("CPF", "", []), ("CPF", "Este é um texto sem dados sensíveis.", []),
]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("tipo,text,expected", CASES)
def test_goldens(spark, tipo, text, expected):
    got = detect.find_by_type(docs(spark, text), tipo, compat=True).orderBy("ini").collect()
    assert [r.valor for r in got] == expected
    assert all(text[r.v_ini : r.v_fim] == r.valor for r in got)


@pytest.mark.parametrize("text", ["(31) 99999-1234", "31 99999-1234", "+55 31 999991234"])
def test_phones(spark, text):
    assert detect.find_by_type(docs(spark, text), "TELEFONE").count() == 1


def test_known_slips_are_mended_and_kept_on_demand(spark):
    d = docs(spark, "OAB-MG 123.456", "Autor: João da Silva", "CRM/MG 12345", "anunciado por 2019")
    assert [r.valor for r in detect.find_by_type(d, "OAB", compat=True).collect()] == ["OAB-MG 123"]
    assert [r.valor for r in detect.find_by_type(d, "OAB").collect()] == ["OAB-MG 123.456"]
    assert [r.valor for r in detect.find_by_type(d, "PESSOA_CONTEXTO").collect()] == ["João da Silva"]
    assert detect.find_by_type(d, "PESSOA_CONTEXTO", compat=True).count() == 0
    assert [r.valor for r in detect.find_by_type(d, "REGISTRO_PROFISSIONAL").collect()] == ["CRM/MG 12345"]
    assert detect.find_by_type(d, "PLACA_VEICULO").count() == 0 and detect.find_by_type(d, "RG").count() == 0


def test_unknown_type_is_an_error(spark):
    with pytest.raises(ValueError):
        detect.find_by_type(docs(spark, "x"), "INVALIDO")


def test_check_digits(spark):
    values = ["529.982.247-25", "123.456.789-09", "111.111.111-11", "123.456.789-00", "", None, "abc"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(T.valid_cpf(F.col("v")).alias("ok"))
    assert [r.ok for r in df.collect()] == [True, True, False, False, False, False, False]
    df = spark.createDataFrame([("11.222.333/0001-81",), ("11.111.111/1111-11",), ("12.345.678/0001-90",)], "v string")
    assert [r.ok for r in df.select(T.valid_cnpj(F.col("v")).alias("ok")).collect()] == [True, False, False]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB1 .-@éç😀\n", max_size=60), min_size=1, max_size=8))
def test_spans_equal_re(spark, texts):
    for pattern, group in ((r"[a1]+", 0), (r"B\s*(\w)", 1)):
        got = docs(spark, *texts).select("doc_id", T.spans(F.col("text"), "(?U)" + pattern, group).alias("s")).collect()
        for r in got:
            assert [(s.ini, s.fim, s.valor, s.v_ini) for s in r.s] == [(m.start(), m.end(), m[group], m.start(group)) for m in re.finditer(pattern, texts[r.doc_id])]


def test_many_matches(spark):
    text = " ".join(f"w{i}" for i in range(1000))
    got = docs(spark, text).select(T.spans(F.col("text"), r"\S+").alias("s")).first().s
    assert [(s.ini, s.fim) for s in got] == [m.span() for m in re.finditer(r"\S+", text)]


def test_occurrences_overlap(spark):
    df = docs(spark, "anana banana", "", "xana", None)
    assert [r.o for r in df.orderBy("doc_id").select(T.occurrences(F.col("text"), "ana").alias("o")).collect()] == [[0, 2, 7, 9], [], [1], []]


def test_redaction_leaves_no_span(spark):
    d = docs(spark, "a@b.com e c@d.org", None, "nada", "é x@y.br 😀 z@w.io")
    out = {r.doc_id: r.texto for r in transform.redact(d, detect.find_by_type(d, "EMAIL")).collect()}
    assert out == {0: "[ANONIMIZADO] e [ANONIMIZADO]", 1: None, 2: "nada", 3: "é [ANONIMIZADO] 😀 [ANONIMIZADO]"}


def test_merge_and_anti(spark):
    s = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 8, 9), (1, 20, 30), (2, 0, 1)], "doc_id long, ini int, fim int")
    assert sorted((r.doc_id, r.ini, r.fim, r.n) for r in spans.merge(s).collect()) == [(1, 0, 9, 3), (1, 20, 30, 1), (2, 0, 1, 1)]
    o = spark.createDataFrame([(1, 4, 6)], "doc_id long, ini int, fim int")
    assert spans.overlap_anti(s, o).count() == 3


def test_pseudonyms_are_stable_and_valid(spark):
    df = spark.createDataFrame([("CPF", "1"), ("CNPJ", "2"), ("PESSOA", "Maria X"), ("PESSOA", "José Y"), ("QUE", "z")], "tipo string, valor string")
    make = df.select("tipo", "valor", transform.pseudonym(F.lit("s"), F.col("tipo"), F.col("valor")).alias("p"))
    a, b = make.collect(), make.collect()
    assert a == b
    checked = make.where("tipo in ('CPF', 'CNPJ')").select(F.when(F.col("tipo") == "CPF", T.valid_cpf(F.col("p"))).otherwise(T.valid_cnpj(F.col("p"))).alias("ok"))
    assert all(r.ok for r in checked.collect())
    names = {r.valor: r.p.split()[0] for r in a if r.tipo == "PESSOA"}
    assert names["Maria X"] in transform.FEMALE and names["José Y"] in transform.MALE
    assert next(r.p for r in a if r.tipo == "QUE") == "[QUE_ANON]"


def plain_places(rule, text):
    group, out = detect.group_of(rule), []
    for m in re.compile(rule.pattern, re.IGNORECASE if rule.ignore_case else 0).finditer(text):
        g = group if group and m[group] else 0
        out.append((m[g], m.start(), m.end(), m.start(g), m.end(g)))
    return out


BITS = ["Rua ", "das Flores", ", ", "n. ", "12", "@", "a.b", "x@y.com", ".com.br", "CEP: ", "30130-010", "R.G. ", "RG", "C.I.", "İ", "ſ", " SIAPE", "123456", "7654321", "OAB/MG ", "1.234", "Autor: ", "Ana Lima", " de ", "Sá"]
BITS += ["Conta ", "C/C ", "Ag. ", "PIS ", "\n", " ", "é", "K", "ABC1D23", "T.E.", "2222 3333 4444", "Sra. ", "BR-040 ", "Av", "Av. ", "+55 (31) 99999-8888", "%", "_", "-", "abcdef12-1234-1234-1234-abcdefabcdef"]


@pytest.mark.parametrize("compat", [False, True])
def test_routed_rules_tell_what_the_patterns_tell(compat):
    """The ways to a rule (beginnings, pivots, digits) lose none of its matches, on texts of what rules are made of."""
    draw, rules = random.Random(5), R.rules(compat)
    texts = ["".join(draw.choice(BITS) for _ in range(draw.randrange(60))) for _ in range(700)]
    got = {}
    for i, place in scan.Router([(k, detect._pattern(r)) for k, r in enumerate(rules)]).places(texts):
        got.setdefault((i, place[0]), []).append(place[1:])
    for i, text in enumerate(texts):
        for k, r in enumerate(rules):
            assert sorted(got.get((i, k), [])) == sorted(plain_places(r, text)), (r.tipo, text)


@pytest.mark.parametrize("text", ["Rua " * 250_000, "a." * 500_000 + "@", "a.a@" * 250_000, "Rua " * 200_000 + "! 5"])
def test_no_rule_is_slow_on_a_megabyte(text):
    router = scan.Router([(k, detect._pattern(r)) for k, r in enumerate(R.rules())])
    began = time.time()
    assert not list(router.places([text])) and time.time() - began < 20


def test_automaton_equals_brute_force():
    draw = random.Random(1)
    for _ in range(60):
        words = list({"".join(draw.choice("abcç😀") for _ in range(draw.randrange(1, 6))) for _ in range(draw.randrange(1, 12))})
        texts = ["".join(draw.choice("abcçd😀\0") for _ in range(draw.choice([0, 1, 5, 60, 1500]))) for _ in range(4)]
        text, word, start = Automaton(words).find(texts)
        want = sorted((i, k, at) for i, t in enumerate(texts) for k, w in enumerate(words) for at in range(len(t)) if t.startswith(w, at))
        assert sorted(zip(text.tolist(), word.tolist(), start.tolist())) == want


def test_topics_keep_their_places(spark):
    df = spark.createDataFrame([(1, "İİİ hiv HIV")], "doc_id long, text string")
    assert sorted(r.ini for r in detect.topic_keywords(df, ["hiv"]).collect()) == [4, 8]


def test_beginnings_of_patterns():
    assert scan.beginnings(r"(?:CEP|C\.E\.P\.?)\s*[:.]?\s*(\d+)") == ["C.E.P", "CEP"]
    assert scan.beginnings(r"\b(?:R\.?G|Id)[xy]\w*") == ["Idx", "Idy", "R.Gx", "R.Gy", "RGx", "RGy"]
    assert scan.beginnings(r"\d{3}") is None and scan.beginnings(r"(?:T\.?)?\s*x") is None and scan.beginnings(r"n\.?\s*b") is None
    parse = scan.re._parser.parse
    assert scan.needs_digit(parse(r"(?:a|b)\s*(\d{2})")) and scan.needs_digit(parse(r"(?:\d|x\d)")) and not scan.needs_digit(parse(r"[\w\d.]+\d?")) and not scan.needs_digit(parse(r"(?:\d|x)"))
