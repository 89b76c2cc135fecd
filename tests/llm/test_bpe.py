import hashlib

import public_tokenizers
import pytest
import tiktoken

from seqloom.llm.bpe import bpe, read_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "\n\n\t x", "Hello world, it's 2024!", "naïve Éclair ßtraße 日本語 🙂🙂", "a" * 700, "ab" * 300 + "  " * 50,
    "<|endoftext|> plain", "xyzzy\x00\x0b\x0c", "thandble " * 200, "é‍",
]


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_equals_the_library(spark, oracle):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, "", "y"), (1, "", "y"), (None, "null id", "z")]
    got = bpe(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH, public_tokenizers.PATTERN, full=True).collect()
    assert len(got) == len(rows)
    text_of = {i: t for i, t, _ in rows}
    for r in got:
        ids = oracle.encode_ordinary(text_of[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded == (text_of[r.doc_id] or "")
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(oracle.decode_bytes(ids)).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe(df, PATH, public_tokenizers.PATTERN).count() == 0


def test_sample_documents(spark, oracle):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: hashlib.sha256(" ".join(map(str, oracle.encode_ordinary(r.text or ""))).encode()).hexdigest() for r in docs.collect()}
    assert {r.doc_id: r.ids_sha256 for r in bpe(docs, PATH, public_tokenizers.PATTERN).collect()} == want
