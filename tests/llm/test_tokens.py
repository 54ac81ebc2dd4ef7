"""Byte-level BPE against the tokenizer library."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sigilo.llm import bpe
from sigilo.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    ranks = {t: i for i, t in enumerate(bpe.ranks_of(PATH))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=300):
    """Texts of all kinds of characters, contractions, runs of blanks, and long words."""
    draw = random.Random(7)
    kinds = ["abcst'", "ÄéßñøΩжש", "漢字かな", " \t\n\r\x0b\x1c\x85  　", "0123٣४²Ⅷ", "!?'\"-_€́‍", "😀🏽𝒜𝟘𐐀𠀀\U0003fc3d\U00011de0", "՘࢏౜힤\x00"]
    out = ["".join(draw.choice(draw.choice(kinds)) for _ in range(draw.randrange(40))) for _ in range(n)]
    return [*out, None, "", " ", "I'll we've 's 'S", "x" * 65, "=" * 200, "ab" * 500, "ü漢" * 90, " " * 3000, "<|endoftext|>", "﻿word"]


def encoded(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("_new", F.lit(1))
    return {r.doc_id: r for r in bpe.encode(df, PATH, public_tokenizers.PATTERN, ["doc_id", "ids"], name="ids", **more).withColumn("back", bpe.decode("ids_", PATH)).collect()}


@pytest.mark.parametrize("remembered", [bpe.REMEMBERED, 3])
def test_ids_are_the_librarys(spark, library, remembered):
    texts = odd_texts()
    got = encoded(spark, texts, remembered=remembered)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i].ids_ == library.encode_ordinary(text or ""), (i, text)
        assert bytes(got[i].back) == (text or "").encode() and got[i].ids == "clash"


def test_long_words_are_merged_alike(library):
    ranks = {t: i for i, t in enumerate(bpe.ranks_of(PATH))}
    draw = random.Random(3)
    for size in (1, 2, 3, 64, 65, 400, 5000):
        word = "".join(draw.choice("etaoin shrdlu"[:5]) for _ in range(size))
        assert bpe.heap_merged(word.encode(), ranks) == library.encode_ordinary(word)


def test_blanks_are_the_librarys():
    """Unicode's white space, which the platform's (0x1C to 0x1F besides) is not."""
    assert {c for a, b in bpe.class_ranges(r"\s") for c in range(a, b + 1)} == {c for c in range(0x110000) if chr(c).isspace() and not 0x1C <= c <= 0x1F}
    assert "".join(bpe.Splitter(public_tokenizers.PATTERN).compiled()("a 𐐀1!😀")) == "a 𐐀1!😀"


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df, PATH, public_tokenizers.PATTERN, ["doc_id"]).count() == 0


def test_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_byte_bpe"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
