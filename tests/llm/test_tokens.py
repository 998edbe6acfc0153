import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from quillspark.llm import byte_bpe, packing, queries, token_files, workspace
from quillspark.llm.elias_fano import EliasFano

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start", T.StringType()), T.StructField("rank", T.LongType())])
ODD = ["", " ", "\n\n  a", "it's I'll we've '  x", "é ü ß ñ 日本語 Ωμέγα", "a\x1c b\x85c\xa0d", "<|endoftext|> x<|endoftext|>", "12½² 3rd €5 “q” ‘s’ —", "x" * 5000, "word " * 3000, "\x00 nul", "👩‍👩‍👧 é"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))


def test_byte_bpe_equals_library_on_odd_texts(library):
    bpe = byte_bpe.ByteBpe(queries.vocabulary("byte_bpe_50k.json"), known=3)
    for text in ODD:
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2100, exclude_categories=["Cs"]), max_size=40))
def test_byte_bpe_equals_library(text):
    bpe = byte_bpe.loaded(queries.vocabulary("byte_bpe_50k.json"))
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == bpe.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano(gaps):
    values = np.cumsum(gaps).astype(np.int64)
    code = EliasFano.from_bytes(EliasFano.encode(values).to_bytes())
    assert code.values().tolist() == values.tolist()
    assert [code.select(i) for i in range(len(values))] == values.tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(100, 1000, 10_000))
    assert len(EliasFano.encode(values).to_bytes()) < 2 * 10_000


def small(spark):
    rows = [(i * 7 % 23, t, "clash", i) for i, t in enumerate(ODD)] + [(5, "same", None, 1), (5, "same", None, 1), (None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def test_token_files_round_trip(spark, sf_dir, library):
    for docs in (small(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        path = workspace.stage_path(spark, "t")
        token_files.write_tokens(docs, path, queries.vocabulary("byte_bpe_50k.json"), end_id=2, partitions=5)
        got = sorted(token_files.read_index(spark, path).collect(), key=lambda r: r["start"])
        texts = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -1 if r[0] is None else r[0])
        assert [r["doc_id"] for r in got] == [r[0] for r in texts]
        at = 0
        want = {}
        for doc, text in texts:
            ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            want.setdefault(doc, []).append((len(ids), zlib.crc32(ids.tobytes())))
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]
            want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        ids = token_files.read_ids(spark, path).where("doc_id = 0").collect()
        text = docs.where("doc_id = 0").first()["text"]
        assert ids[0]["ids"] == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_empty_table(spark):
    none = small(spark).limit(0)
    assert token_files.document_offsets(none, queries.vocabulary("byte_bpe_50k.json")).count() == 0
    assert packing.pack_documents(none, queries.vocabulary("byte_bpe_50k.json")).count() == 0


def one_by_one(lengths, capacity):
    """Brute-force best-fit decreasing: number of sequences and their sorted fills."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            i = rooms.index(min(fits))
            rooms[i] -= x
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120), st.integers(30, 64))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    counts = {x: lengths.count(x) for x in set(lengths)}
    fill, placed = {}, {}
    for length, rank, pieces, first, each, offset in packing.best_fit_plan(counts, capacity):
        for j in range(pieces):
            s, o = first + j // each, offset + j % each * length
            fill.setdefault(s, []).append((o, length))
            placed.setdefault(length, []).append(rank + j)
    assert {x: sorted(r) for x, r in placed.items()} == {x: list(range(n)) for x, n in counts.items()}
    for parts in fill.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(x for _, x in p) for p in fill.values()) == one_by_one(lengths, capacity)


def test_packing(spark, sf_dir, library):
    for docs in (small(spark), spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)):
        rows = packing.pack_documents(docs, queries.vocabulary("byte_bpe_50k.json")).collect()
        lengths, got = [], {}
        for r in rows:
            got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        for doc, text in docs.select("doc_id", "text").collect():
            ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            cuts = [0, *range(len(ids) % 1024 or min(len(ids), 1024), len(ids) + 1, 1024)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                got[doc].remove((i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                lengths.append(b - a)
        assert not any(got.values())
        fill = {}
        for r in rows:
            fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in fill.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 1024
        assert len(fill) == len(one_by_one(lengths, 1024))


def test_documents_by_select(spark, library):
    """Single documents come out of the files by their boundaries alone."""
    docs = small(spark)
    path = workspace.stage_path(spark, "t")
    token_files.write_tokens(docs, path, queries.vocabulary("byte_bpe_50k.json"), end_id=2, partitions=3)
    wanted = spark.createDataFrame([(5, "x"), (5, "y"), (0, ""), (7, ""), (None, ""), (99_999, "")], "doc_id long, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in token_files.read_documents(spark, path, wanted).collect())
    want = sorted((d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in docs.select("doc_id", "text").collect() if d in (5, 0, 7))
    assert got == want and len(got) >= 5
    assert token_files.read_documents(spark, path, wanted.limit(0)).count() == 0
