"""Ids and decoded texts against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm.byte_bpe import ByteBpe, decode_ids, encode_texts, loaded, op11_byte_bpe
from cairn.llm.tokens import public_tokenizer_path

PATH = public_tokenizer_path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "é", "日", "😀", "1", "'s", "the", "ing", ".", "!!", "<|endoftext|>", "ß", "\x1f", "　", "don't", "x" * 70, "ab" * 50]


def library(texts):
    return [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(), st.lists(st.sampled_from(PARTS), max_size=30).map("".join)), min_size=1, max_size=8))
def test_encode_is_the_librarys(texts):
    assert loaded(PATH).encode(texts) == library(texts)


def test_long_words_and_texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(n)) for n in (1, 2, 3, 4, 7, 8, 15, 16, 31, 32, 62, 63, 64, 65, 127, 128, 500, 3000)]
    texts = [*words, "a" * 5000, "日本語" * 900, " ".join(words * 400) + "<|endoftext|>" * 3 + "end " * 250_000]
    assert loaded(PATH).encode(texts) == library(texts)


def test_both_trees_merge_alike():
    bpe, rng = ByteBpe(PATH), random.Random(5)
    words = ["".join(rng.choice("aabcdeilnrst'") for _ in range(rng.randint(1, 63))).encode() for _ in range(300)]
    assert bpe.merge(words) == [bpe.merge_long(w) for w in words]


def test_decode_is_the_librarys():
    rng, tokenizer = random.Random(7), Tokenizer.from_file(PATH)
    for _ in range(200):  # most are no whole UTF-8
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 40))]
        assert loaded(PATH).decode(np.array(ids, "<u4").tobytes()) == tokenizer.decode(ids, skip_special_tokens=False)
    assert loaded(PATH).decode(np.array([1, 60_000, 2], "<u4").tobytes()) == tokenizer.decode([1, 60_000, 2], skip_special_tokens=False)


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        ByteBpe(public_tokenizer_path("word_bpe_49k.json"))


def test_table(spark, docs, empty):
    rows = decode_ids(encode_texts(docs)).collect()
    assert len(rows) == docs.count() and set(docs.columns) < set(rows[0].asDict())
    texts = [r.text or "" for r in rows]
    assert [bytes(r.ids) for r in rows] == library(texts)
    assert [r.decoded for r in rows] == texts and all(4 * r.n_tokens == len(r.ids) for r in rows)
    assert decode_ids(encode_texts(empty)).count() == 0
    assert decode_ids(spark.createDataFrame([(None,)], "ids binary")).first().decoded is None
    with pytest.raises(ValueError, match="IDS"):
        encode_texts(docs.withColumn("IDS", F.lit(1)))


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op11_byte_bpe(spark, d).collect()
    assert len(rows) == len(texts)
    for r, ids in zip(rows, library([texts[r.doc_id] for r in rows]), strict=True):
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
