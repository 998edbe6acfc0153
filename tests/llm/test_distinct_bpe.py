import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import distinct_bpe, queries, word_chunks

PATH = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
ODD = ["", None, " ", "\n\n  a", "it's I'll  '  x", "日本語　テスト Ωμέγα", "a\x1c\x1d b\x85c\xa0d", "<|endoftext|>", "12½² Ⅷ ٣", "x" * 5000, "word " * 3000, "\x00", "👩‍👩‍👧 é", "  em", "word " * 10]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=distinct_bpe.ranks(PATH), special_tokens={})


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_equals_library(spark, sf_dir, library):
    odd = spark.createDataFrame([(i % 9, t, "x", 3) for i, t in enumerate(ODD)] + [(None, "a b", None, None)] * 3, "doc_id long, text string, codes string, chunk long")
    for docs in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet"), odd.limit(0)):
        got = sorted((tuple(r) for r in distinct_bpe.encoded_digests(docs, PATH, public_tokenizers.PATTERN).collect()), key=str)
        assert got == sorted(((d, *digests(library, t)) for d, t in docs.select("doc_id", "text").collect()), key=str)


def test_round_trip(spark, library):
    docs = spark.createDataFrame([(i, t or "") for i, t in enumerate(ODD)], "doc_id long, text string")
    back = {r["doc_id"]: bytes(r["data"]) for r in distinct_bpe.decoded(distinct_bpe.encoded(docs, PATH, public_tokenizers.PATTERN), PATH).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(ODD)}


def test_decoding_joins_the_token_table(spark):
    rows = [(1, [0, 1, 2]), (1, [5]), (2, None), (3, []), (None, [7, 7])]
    docs = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    table = {r["id"]: bytes(r["token"]) for r in distinct_bpe.token_table(spark, PATH).collect()}
    got = distinct_bpe.decoded(docs, PATH)
    assert sorted(((r["doc_id"], bytes(r["data"])) for r in got.collect()), key=str) == sorted(((d, b"".join(table[i] for i in ids or [])) for d, ids in rows), key=str)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="without a token"):
        distinct_bpe.decoded(spark.createDataFrame([(1, [1 << 29])], "doc_id long, ids array<int>"), PATH).collect()


def test_no_table_is_left(spark):
    before = spark.catalog.listTables()
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert distinct_bpe.encoded_digests(docs, PATH, public_tokenizers.PATTERN).count() == 1
    assert spark.catalog.listTables() == before


def test_small_chunks(spark, library):
    docs = spark.createDataFrame([(i, f"some words {i} and some more {i % 5}") for i in range(200)], "doc_id long, text string")
    chunks = word_chunks.chunked(docs, distinct_bpe.PreTokens(public_tokenizers.PATTERN), chunk_bytes=300)
    assert chunks.count() > 20


def test_each_distinct_word_is_asked_once(spark, tmp_path):
    """However many chunks hold a word."""
    docs = spark.createDataFrame([(i, f"some words {i % 40} and some more {i % 5}") for i in range(200)], "doc_id long, text string")
    chunks = word_chunks.chunked(docs, lambda t: t.split(), chunk_bytes=300)
    calls = spark.sparkContext.accumulator(0)

    def ask(words):
        calls.add(len(words))
        return words

    word_chunks.answered(chunks, ask).collect()
    assert calls.value == len({w for r in docs.collect() for w in r["text"].split()})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_split(text):
    split = distinct_bpe.PreTokens(public_tokenizers.PATTERN)
    assert "".join(split(text.encode())) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, (1 << 21) - 1), max_size=50))
def test_codes(codes):
    assert word_chunks.unpack_codes(word_chunks.pack_codes(np.array(codes, np.int64))).tolist() == codes


def test_codes_of_any_size():
    """A chunk of one very long text may have more than 2^21 distinct words."""
    codes = np.array([0, 127, 128, 2**14 - 1, 2**14, 2**21 - 1, 2**21, 2**21 + 300_001, 2**28 - 1, 2**28, 2**31 - 1, 5], np.int64)
    assert word_chunks.unpack_codes(word_chunks.pack_codes(codes)).tolist() == codes.tolist()
    assert word_chunks.unpack_codes(word_chunks.pack_codes(codes[:0])).tolist() == []
