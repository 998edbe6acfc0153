import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import prefix_tokens, queries

PATH = queries.vocabulary("piece_bpe_32k.model")
ODD = ["", " ", "   ", "\n", "a\n\n b", "  lead", "trail  ", "a  b   c", "▁a▁▁b", "<s> x </s><unk>", "日本語　テスト", "naïve façade", "tab\tcr\r\n", "aaaaaaaaaaaaa", "\x00", "👩‍👩‍👧x", "<0x0A>", "supercalifragilistic 1234567"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("text", ODD)
def test_every_prefix(library, text):
    counter = prefix_tokens.loaded(PATH)
    want = [len(library.encode(text[:k])) for k in range(len(text) + 1)]
    assert counter.at_prefixes(text) == want
    stored = prefix_tokens.Prefixes(*counter.tables(text))
    assert [stored.count(k) for k in range(len(text) + 1)] == want
    assert counter.count(text) == want[-1] == (counter.at_units(text) or [0])[-1]
    for budget in range(4):
        cut = counter.truncate(text, budget)
        assert len(cut) == max(k for k, n in enumerate(want) if n <= budget)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet="ab ▁\n", max_size=30), st.text(max_size=30)))
def test_random(text):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert prefix_tokens.loaded(PATH).at_prefixes(text) == [len(library.encode(text[:k])) for k in range(len(text) + 1)]


def test_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(spark.sql("SELECT 7L doc_id, CAST(NULL AS STRING) text, '' lang, '' source, 0L n_chars"))
    got = sorted(tuple(r)[:4] for r in prefix_tokens.token_counts(docs, PATH).collect())
    want = sorted((d, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for d, t in docs.select("doc_id", "text").collect())
    assert got == want
    assert prefix_tokens.token_counts(docs.limit(0), PATH).count() == 0
    cut = prefix_tokens.truncated(docs, PATH, 10).collect()
    assert all(r["n_tokens"] <= 10 for r in cut)


def test_budgets_from_stored_tables(spark, library, tmp_path):
    """Truncation is answered from a written table, without texts or the model; columns may clash."""
    texts = ["", None, "a b c", "▁a▁▁b  c " * 40, "日本語　テスト", "aaaaaaaaaaaaaaaaaa " * 9]
    docs = spark.createDataFrame([(i, t, 1, "x", True) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, n_bytes string, over_limit boolean")
    prefix_tokens.prefix_counts(docs, PATH).write.parquet(f"{tmp_path}/prefixes")
    stored = spark.read.parquet(f"{tmp_path}/prefixes")
    for budget in (0, 1, 3, 10, 10_000):
        want = {i: max(k for k in range(len(t or "") + 1) if len(library.encode((t or "")[:k])) <= budget) for i, t in enumerate(texts)}
        assert {r["doc_id"]: r["kept_chars"] for r in prefix_tokens.kept_within(stored, budget).collect()} == want
        assert {r["doc_id"]: r["kept_chars"] for r in prefix_tokens.token_counts(docs, PATH, limit=budget).collect()} == want
