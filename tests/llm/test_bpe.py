"""Ids against the tokenizers library, and the way back."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlink.llm.bpe import Encoder, Vocabulary, decode, decoded, encode, n_tokens
from cohortlink.llm.queries import bpe_round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", " \n\n  x\t", "don't  you'LL they've",
         "a" * 5000, "ab" * 3000, "\x1c\x1dx\x85y z ", "é" * 40, "漢字かな交じり文 と 絵文字👩‍👩‍👧", "1234 5678,90 €", "\x00\x01\x7f",
         "<|endoftext", "  leading and trailing  ", "ﬁn Ⅷ ²³ ́combining"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Vocabulary(PATH))


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@pytest.mark.parametrize("text", TEXTS)
def test_like_the_library(library, encoder, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(encoder.encode(text)) == want
    assert decoded(encoder.encode(text), encoder.vocabulary) == library.decode(want, skip_special_tokens=False)


def test_random_letters(library, encoder):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 0x500), rng.randrange(0x4E00, 0x9000), 10)))
                       for _ in range(rng.randrange(80)))
        assert ids(encoder.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_part_of_a_letter_decodes_like_the_library(library, encoder):
    some = ids(encoder.encode("漢"))[:1]
    assert decoded(np.array(some, "<u4").tobytes(), encoder.vocabulary) == library.decode(some, skip_special_tokens=False)


def test_columns(spark, make_docs):
    docs = make_docs([(1, "Hello there"), (1, "Hello there"), (2, None), (3, "")]).withColumn("ids", F.lit("mine"))
    got = docs.select("doc_id", encode(spark, PATH)(F.col("text")).alias("packed"))
    rows = got.select("doc_id", n_tokens(F.col("packed")), decode(spark, PATH)(F.col("packed"))).collect()
    assert sorted(map(tuple, rows)) == [(1, 2, "Hello there"), (1, 2, "Hello there"), (2, 0, ""), (3, 0, "")]
    assert docs.limit(0).select(encode(spark, PATH)(F.col("text"))).count() == 0


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = bpe_round_trip(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        back = library.decode(want, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
