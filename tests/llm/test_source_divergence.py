import random
import re
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import source_divergence as sd

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("term", T.StringType()), ("n", T.StringType()))])
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows, min_docs, top=50):
    docs = [(lang or "", source or "", TERM.findall(lower(text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t in df if df[t] >= min_docs]
        groups = {s: Counter() for _, s, _ in mine}
        for _, s, terms in mine:
            groups[s].update(t for t in terms if df[t] >= min_docs)
        whole = sum(groups.values(), Counter())

        def p(counts, t, kept=kept):
            return 1 + 10**9 * (counts[t] + 5) // (sum(counts.values()) + 5 * len(kept))

        for s, counts in groups.items():
            pairs = [(sum(abs(p(counts, t) - p(groups[o], t)) for t in kept), o) for o in groups if o != s]
            terms = [(p(counts, t) - p(whole, t), t) for t in kept if counts[t] and p(counts, t) > p(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def sample(seed, n=160):
    rng = random.Random(seed)
    words = ["the", "Of", "übung", "ÜBUNG", "a", "b", "ab", "日本", "x" * 400, "İ", "\x85", "\xa0", "zeta", "Zeta", "don't", "A1B", "e\x00f"]
    seps = [" ", "  ", "\n", "-", ". ", "_", "\x7f"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words[: rng.randint(2, len(words))]) + rng.choice(seps) for _ in range(rng.randint(0, 25)))
        rows.append((i, text if i % 11 else None, ["en", "de", "", None, "fr"][i % 5], [f"s{i % 7}", None, "", "S"][i % 13 % 4]))
    return [*rows, (1, "the the", "en", "s1"), (1, "the the", "en", "s1"), (2, "", "xx", "one"), (3, "1 2", "yy", "a"), (4, None, "yy", "b")]


def test_equals_brute_force(spark):
    for seed, min_docs in ((1, 3), (2, 12), (3, 1), (4, 10_000)):
        rows = sample(seed)
        docs = spark.createDataFrame([(*r, "t", "n") for r in rows], DOCS).repartition(4)
        got = sorted(tuple(r) for r in sd.audit(docs, min_docs=min_docs, top=4).collect())
        assert got == brute(rows, min_docs, top=4)


def test_chunks_may_be_small(spark):
    """Document frequencies and counts do not depend on where chunks end; matrices may be handed on at any time."""
    rows = sample(5)
    docs = spark.createDataFrame([(*r, "t", "n") for r in rows], DOCS).repartition(3)
    counts = []
    for size in (40, 10_000_000):
        chunks = sd.chunked(docs, chunk_bytes=size)
        counts.append(sorted(tuple(r) for r in sd.occurrences(chunks, sd.kept_terms(chunks, 5)).collect()))
    assert counts[0] == counts[1] and counts[0]
    entry = "array<struct<source string, p long, base long>>"
    postings = spark.createDataFrame([("en", [(f"s{i * k % 7}", i * k, 1 + i) for i in range(k)]) for k in range(1, 7)] * 3 + [("de", [("a", 5, 1), ("b", 9, 2)])], f"lang string, entries {entry}").coalesce(1)
    sums = [sd._shared_terms(postings, b, h).groupBy("lang", "source", "item").agg(F.sum("value")).where("`sum(value)` <> 0") for b, h in ((256, 256), (2, 1), (1, 2))]
    assert len({tuple(sorted(map(tuple, s.collect()))) for s in sums}) == 1


def test_large_counts_stay_exact(spark):
    cases = [(0, 0, 1), (10**13, 3 * 10**14, 10**9), (10**15 - 1, 10**15, 7), (3, 7, 2)]
    df = spark.createDataFrame(cases, "n long, total long, terms long")
    got = [r[0] for r in df.select(sd.smoothed(F.col("n"), F.col("total"), F.col("terms"))).collect()]
    assert got == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in cases]


def test_empty(spark):
    got = sd.audit(spark.createDataFrame([], DOCS))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and got.count() == 0
