"""The fold over steps: every word's merges, each step a few operations on bits, whatever a word's length."""

import random

import public_tokenizers
from pyspark.sql import functions as F

from sigilo.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def folded(spark, words, path=PATH):
    rows = [(w, (1 << len(w) + 1) - 1, told) for w, told in zip(words, bpe.steps(words, bpe.vocabulary(path)).to_pylist())]
    df = spark.createDataFrame([(bytearray(w), whole, [(s["span"], s["ends"]) for s in told]) for w, whole, told in rows], "word binary, whole bigint, steps array<struct<span:bigint,ends:bigint>>")
    return {bytes(r.word): r.cuts for r in df.select("word", bpe.merged(F.col("whole"), F.col("steps")).alias("cuts")).collect()}


def parts(word, cuts):
    at = [k for k in range(len(word) + 1) if cuts >> k & 1]
    return [word[i:j] for i, j in zip(at, at[1:])]


def test_cuts_are_the_heaps(spark):
    ranks = {t: i for i, t in enumerate(bpe.ranks_of(PATH))}
    draw = random.Random(11)
    words = {"".join(draw.choice("etaoin shrd") for _ in range(draw.randrange(1, 22))).encode() for _ in range(3000)} | {b"x" * bpe.LONG, "漢字かな".encode(), b"\xff\xfe", b"a"}
    got = folded(spark, sorted(words))
    assert set(got) == words
    told = {w: parts(w, c) for w, c in got.items() if c >= 0}
    assert len(told) > 0.97 * len(words)
    for word, cut in told.items():
        assert [ranks[t] for t in cut] == bpe.heap_merged(word, ranks), word


def test_words_out_of_order_are_told_and_encoded(spark, tmp_path):
    """Where `ab` has a lower rank than `a`'s own part, the pair is due at once, ahead of steps that the order of ranks would take first."""
    import base64

    tokens = [bytes([i]) for i in range(256)] + [b"xyz", b"xy", b"zw"]
    path = str(tmp_path / "ranks")
    with open(path, "wb") as f:
        f.writelines(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens))
    got = folded(spark, [b"xyzw", b"xyw", b"zw"], path)
    assert got[b"xyzw"] < 0 and parts(b"xyw", got[b"xyw"]) == [b"xy", b"w"] and parts(b"zw", got[b"zw"]) == [b"zw"]
    df = spark.createDataFrame([(0, "xyzw"), (1, "xyw zw")], "doc_id long, text string")
    ids = {r.doc_id: r.ids for r in bpe.encode(df, path, r"\S+|\s", ["doc_id"]).collect()}
    assert ids == {0: [256, ord("w")], 1: [257, ord("w"), ord(" "), 258]}
