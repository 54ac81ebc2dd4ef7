"""The tagger against all readings of short lines, fitted twice, and on names that it has not seen; pieces of long texts; names wherever they stand."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigilo.operators import allowlist, api, detect, grams, tagger
from sigilo.sources import files


def test_viterbi_equals_all_readings():
    draw = np.random.default_rng(1)
    labels = tagger.label_set(["PESSOA", "LOCAL"])
    n, moves = len(labels), draw.normal(size=(6, 5)).round(1) + tagger.allowed(tagger.label_set(["PESSOA", "LOCAL"]))
    scores = [draw.normal(size=(k, n)).round(1) for k in (0, 1, 2, 3, 5, 4, 1)]
    for s, path in zip(scores, tagger.viterbi(scores, moves)):
        worth = lambda p: sum(s[i, x] for i, x in enumerate(p)) + (moves[n, p[0]] if p else 0) + sum(moves[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(map(worth, map(list, itertools.product(range(n), repeat=len(s)))), default=0)
        assert len(path) == len(s) and abs(worth(path.tolist()) - best) < 1e-9


def taught(spark, n=240, seed=3):
    draw, rows = random.Random(seed), []
    for k in range(n):
        first, last = draw.choice(["Ana", "Rui", "Eva", "Caio", "Lia"]), draw.choice(["Lima", "Costa", "Reis", "Melo"])
        said = draw.choice(["O autor {} {} disse que não .", "Ouvida a senhora {} {} hoje .", "Nada mais foi dito .", "A chuva caiu em todo o Brasil ."])
        words = said.format(first, last).split()
        labels = ["B-PESSOA" if w == first else "I-PESSOA" if w == last else "O" for w in words]
        rows.append((k, 0, words, labels))
    return spark.createDataFrame(rows, "doc_id long, linha int, palavras array<string>, labels array<string>")


def test_fitted_twice_alike_and_sees_new_names(spark):
    rows = taught(spark)
    model = tagger.fit(rows, ["PESSOA"], shards=4, epochs=4)
    again = tagger.fit(rows.repartition(7, "palavras"), ["PESSOA"], shards=4, epochs=4)
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.moves, again.moves)
    back = tagger.from_table(tagger.to_table(spark, model), ["PESSOA"])
    assert np.array_equal(back.weights, model.weights) and np.array_equal(back.moves, model.moves)
    docs = spark.createDataFrame([(1, "Nada mais .\nO autor Beto Prado disse que sim ."), (2, "A chuva caiu ."), (3, None), (4, "")], "doc_id long, text string")
    got = detect.entities_from(docs, tagger.recogniser(model)).collect()
    assert [(r.doc_id, r.tipo, r.valor, r.ini, r.fim) for r in got] == [(1, "PESSOA", "Beto Prado", 20, 30)] and got[0].score > 0.5


def test_lines_of_labelled_words(spark):
    text = spark.createDataFrame([(1, "a b\n\nc d"), (2, None)], "doc_id long, text string")
    words = spark.createDataFrame([(1, w, i, l) for w, i, l in (("a", 0, "O"), ("b", 2, "B-X"), ("c", 5, "O"), ("d", 7, "I-X"))], "doc_id long, palavra string, ini int, label string")
    assert sorted(map(tuple, tagger.lines(words, text).collect())) == [(1, 0, ["a", "b"], ["O", "B-X"]), (1, 2, ["c", "d"], ["O", "I-X"])]


@pytest.mark.parametrize("size, overlap", [(60, 40), (45, 44), (1000, 40)])
def test_pieces_tell_what_the_whole_text_tells(spark, size, overlap):
    def found(frames):
        import re

        for f in frames:
            rows = [(d, "PESSOA", m[0], m.start(), m.end(), 1.0) for d, t in zip(f["doc_id"], f["text"]) for m in re.finditer(r"[A-Z][a-z]+(?: [A-Z][a-z]+)*", t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "tipo", "valor", "ini", "fim", "score"])

    draw = random.Random(size)
    text = lambda: " ".join(draw.choice(["ana", "Ana Lima", "e", "Rui", "José", "de", "x" * 9]) + draw.choice([",", ".", " e", ""]) + " a" for _ in range(draw.randrange(80)))
    docs = spark.createDataFrame([(k, text()) for k in range(30)] + [(90, None), (91, "")], "doc_id long, text string")
    whole = sorted(tuple(r) for r in detect.entities_from(docs, found).collect())
    assert whole and sorted(tuple(r) for r in detect.recognised(docs, found, size, overlap, deal=5).collect()) == whole


def test_a_party_is_hidden_wherever_it_stands(spark):
    docs = spark.createDataFrame([(1, "Autor: Ana Lima e o resto.\nA Ana Lima mora aqui. ANA LIMA disse. Ana Limão não.")], "doc_id long, text string")
    assert api.anonymise(docs).first().texto == "Autor: [ANONIMIZADO] e o resto.\nA [ANONIMIZADO] mora aqui. [ANONIMIZADO] disse. Ana Limão não."


def test_a_rule_does_not_cut_a_recognised_name(spark):
    def more(frames):
        for f in frames:
            rows = [(d, "PESSOA", "Ana Lima SOUZA", t.index("Ana"), t.index("Ana") + 14, 0.9) for d, t in zip(f["doc_id"], f["text"])]
            yield pd.DataFrame(rows, columns=["doc_id", "tipo", "valor", "ini", "fim", "score"])

    api.register("more", more)
    docs = spark.createDataFrame([(1, "Hoje a Sra. Ana Lima SOUZA, testemunha, falou.")], "doc_id long, text string")
    assert api.anonymise(docs, ner="more").first().texto == "Hoje a Sra. [ANONIMIZADO], testemunha, falou."


def test_versions_of_a_list(spark, tmp_path):
    path = str(tmp_path / "list")
    entry = lambda *names: spark.createDataFrame([(n, "juiz", None, True) for n in names], files.ALLOWLIST)
    names = lambda version=None: sorted(r.nome for r in files.saved_allowlist(spark, path, version).collect())
    assert names() == [] and files.upsert_allowlist(spark, entry("Ana", " ana "), path) == 1
    assert len(names()) == 1
    assert files.upsert_allowlist(spark, entry("ANA", "Bia"), path) == 2 and [n.strip().lower() for n in names()] == ["ana", "bia"]
    assert files.save_allowlist(files.saved_allowlist(spark, path), path) == 3 and len(names()) == 2  # over its own source
    with pytest.raises(Exception, match="never"):
        files.save_allowlist(files.saved_allowlist(spark, path).withColumn("nome", F.raise_error(F.lit("never")).cast("string")), path)
    assert files.allowlist_versions(spark, path) == [1, 2, 3] and len(names()) == 2 and len(names(1)) == 1
    assert files.save_allowlist(files.saved_allowlist(spark, path).withColumn("tipo", F.lit("outro")), path) == 4 and names() == []
    assert allowlist.delete(files.saved_allowlist(spark, path, 3), "BIA").count() == 1


def test_contained_equals_brute_force(spark):
    draw = random.Random(11)
    text = lambda n: "".join(draw.choice("abç ") for _ in range(draw.randrange(n)))
    parts, wholes = [text(6) for _ in range(150)] + [None, "", "zz"], [text(14) for _ in range(80)] + [None, ""]
    got = grams.contained(spark.createDataFrame([(p,) for p in parts], "part string"), spark.createDataFrame([(w,) for w in wholes], "whole string"))
    assert sorted(map(tuple, got.collect())) == sorted({(p, w) for p in parts for w in wholes if p and w and p in w})

