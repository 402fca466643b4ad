"""Encoding against the tiktoken library, decoding as a round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF001
from vigil.llm import bpe
from vigil.llm.catalog import QUERIES

with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
    RANKS = bpe.read_ranks(f.read())
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENC = bpe.Encoder(RANKS, P.PATTERN)
DEC = bpe.Decoder(RANKS)


def encode(text, enc=ENC):
    return np.frombuffer(enc.encode(text), "<i4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_encodes_as_the_library(text):
    assert encode(text) == TIK.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZ0 \t\n\r\x0b\x0c\'sdl.,!|~\u00e9\u00df\u00d7\u00b5\u00a0\x85\x1c", max_size=60))
def test_latin_texts_split_as_the_library(text):
    assert encode(text) == TIK.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 20_000, "ab" * 9000, "=" * 13_001, " " * 9000, "é" * 9000,
                                  "aAbB" * 5000, "\U0001F600" * 3000, "don't we'll I'VE"])
def test_long_pieces_and_corner_cases(text):
    assert encode(text) == TIK.encode_ordinary(text)


def test_dropping_the_caches_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 40)
    monkeypatch.setattr(bpe, "MAX_PIECES", 10)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 50)
    monkeypatch.setattr(bpe, "PORTION", 7)
    small = bpe.Encoder(RANKS, P.PATTERN)
    rnd = random.Random(3)
    for _ in range(200):
        text = "".join(rnd.choice(["the", "ing", " ", "é", "zzz", "0", "\n", "Xy"]) for _ in range(40))
        assert encode(text, small) == TIK.encode_ordinary(text)


def test_other_vocabulary():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    tik = tiktoken.Encoding("multi", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc = bpe.Encoder(ranks, P.PATTERN)
    for text in ("Éauouon größer niños", "中文 текст हिन्दी", "a b  c\n\nd"):
        assert encode(text, enc) == tik.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.lists(st.integers(1, 5), max_size=30))
def test_streamed_utf8_is_the_whole_decoded(data, cuts):
    stream, out, at = bpe.Utf8Stream(), "", 0
    for c in cuts:
        out += stream.feed(data[at:at + c])
        assert len(stream.held) <= 3
        at += c
    assert out + stream.feed(data[at:]) + stream.close() == data.decode("utf-8", "replace")


def test_query_against_the_library(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = QUERIES["op8_byte_bpe"](spark, SF001).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = TIK.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_operator_keeps_columns_and_handles_nulls(spark):
    docs = spark.createDataFrame(
        [(1, None, "x", 1), (2, "", "x", 2), (3, "a  b", None, 3), (3, "a  b", None, 3)],
        "doc_id long, text string, __bpe string, decoded int")
    tok = bpe.default_tokenizer(spark)
    rows = bpe.round_trip(docs, tok).collect()
    assert rows[0].asDict() == {"doc_id": 1, "text": None, "__bpe": "x", "token_ids": [], "decoded": b""}
    assert [bytes(r.decoded) for r in rows] == [b"", b"", b"a  b", b"a  b"]
    chained = bpe.decode(bpe.encode(docs, tok), tok).withColumn("t", tok.decode_text_udf()("token_ids")).collect()
    assert [(bytes(r.decoded), r.t) for r in chained] == [(b"", ""), (b"", ""), (b"a  b", "a  b"), (b"a  b", "a  b")]
    assert bpe.round_trip(docs.limit(0), tok).count() == 0


def test_checked_keeps_columns_and_compares_in_the_worker(spark):
    texts = ["some text", None, "", "Ünïcode \U0001F600 x", "w " * 50_000]
    docs = spark.createDataFrame([(k, t, "e", False) for k, t in enumerate(texts)],
                                 "doc_id long, text string, extra string, round_trip boolean")
    out = bpe.checked(docs, bpe.default_tokenizer(spark))
    assert out.columns == ["doc_id", "extra", "token_ids", "round_trip"]
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[k].token_ids == TIK.encode_ordinary(t or "") and got[k].round_trip for k, t in enumerate(texts))
    assert bpe.checked(docs.limit(0), bpe.default_tokenizer(spark)).count() == 0
