"""The pipeline against a brute-force version, and its stages' corner cases."""

import re

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as C
from test_dedup import brute, corpus
from vigil.llm import bpe

with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
    TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    return [(i, t, ("en", "de")[i % 2], "s", len(t or "")) for i, t in corpus(9)]


def holds(text, item):
    """Six windows of eight words of the item, each as far from its place in the item."""
    w, b = text.split(), item.split()
    for shift in range(-len(b), len(w)):
        same = sum(w[shift + k:shift + k + 8] == b[k:k + 8] for k in range(len(b) - 7) if shift + k >= 0)
        if same >= 6:
            return True
    return False


def expected(docs, bench):
    """The rows that stay, stage by stage; every text with a letter is identified."""
    left = [r for r in docs if r[1] and re.search("[a-zA-Z]", r[1])]
    first = {}
    for r in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    left = list(first.values())
    groups = brute([(r[0], r[1]) for r in left], C.SHINGLE_WORDS)
    left = [r for r in left if groups[r[0]][1] == r[0]]
    return {r[0]: TIK.encode_ordinary(r[1]) for r in left if not any(holds(r[1], b) for b in bench)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs = rows()
    long = [r for r in docs if r[1] and len(r[1].split()) > 40]
    bench = [(0, " ".join(long[0][1].split()[5:30])), (1, "nothing like this is in there at all anywhere"), (2, None)]
    spark.createDataFrame(docs, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, [bench[0][1]]


def test_run_against_brute_force(spark, folder):
    path, docs, bench = folder
    got = {r.doc_id: r for r in C.run(spark, path).collect()}
    expect = expected(docs, bench)
    assert {i: r.token_ids for i, r in got.items()} == expect
    assert all(r.n_tokens == len(r.token_ids) and r.round_trip for r in got.values())
    assert len(expect) < len(docs) - 100


def test_stages_keep_columns_and_take_odd_rows(spark, folder):
    path = folder[0]
    odd = [(1, None, None, None, None), (None, "some text here", "en", "s", 1), (2, "", "en", "s", 0),
           (3, "some text here", "en", "s", 1), (3, "some text here", "en", "s", 1), (4, "w " * 60_000, "en", "s", 9)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in odd],
                                 SCHEMA + ", fp string, __score int, token_ids int")
    for data in (docs, docs.limit(0)):
        step = data
        for name, stage in C.STAGES:
            out = stage(spark, step, path)
            if name != C.STAGES[-1][0]:
                assert out.columns == docs.columns
                step = out
        kept = {r.doc_id for r in out.collect()}
        assert kept == ({3, 4} if data is docs else set())


def test_texts_stay_where_no_language_can_be_learnt(spark):
    texts = [(1, "some text here"), (2, "été"), (3, "12 - 3"), (4, ""), (5, None), (None, "more text")]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in texts], SCHEMA)
    kept = C.keep_identified(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, None}


def test_stage_list():
    assert [n for n, _ in C.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "byte_bpe"]
    assert C.ORACLE_SQL is None
