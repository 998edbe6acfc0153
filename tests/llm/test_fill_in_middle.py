import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from quillspark.llm import fill_in_middle as fim

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("form", T.StringType()), T.StructField("output", T.LongType())])
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc, text):
    """The contract by lists of tokens."""
    text = text or ""
    tokens = TOKEN.findall(text)
    h = [int(sha(f"42:{'' if doc is None else doc}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    spm = h[3] % 100 < 80
    return doc, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x85\xa0ab<PSM>é日𝒳 \x00", max_size=60), st.integers(0, 400))
def test_one_text(text, doc):
    got = fim.rearranged(text.encode(), fim.draws(42, str(doc)))
    assert (doc, *got[:-1], got[-1].decode()) == brute(doc, text)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**90))
def test_select(mask):
    width = 91
    bits = [i for i in range(width) if mask >> (width - 1 - i) & 1]
    assert mask.bit_count() == len(bits)
    assert [fim.select(mask, width, k) for k in range(len(bits) + 1)] == [0, *(i + 1 for i in bits)]


def test_rows(spark):
    rows = [(i, t) for i in range(40) for t in ("a b  c d", "x", " \n", "<P a <P< S> b>", "é 日 𝒳\x85y z", "ab <M> c")]
    rows += [(1, None), (2, ""), (None, "one two three"), (3, "a b c"), (3, "a b c"), (7, "wörd " * 200_000 + "end")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(5)
    made = fim.transform(docs)
    want = sorted((brute(*r) for r in rows), key=str)
    assert sorted((tuple(r) for r in made.collect()), key=str) == want
    back = made.select("doc_id", fim.restored(made.output, made.form).alias("text")).collect()
    assert sorted(((r[0], r[1]) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    digests = sorted((tuple(r) for r in fim.digests(docs).collect()), key=str)
    assert sorted((d[0], d[2], d[5]) for d in digests if d[0]) == sorted((w[0], w[2], sha(w[5])) for w in want if w[0])
    assert {d[6] for d in digests} == {sha(t or "") for _, t in rows}
    assert {d[2] for d in digests} == {"plain", "spm", "psm"}


def test_empty(spark):
    empty = fim.digests(spark.createDataFrame([], DOCS))
    assert empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert empty.count() == 0
