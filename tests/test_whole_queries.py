"""Queries on a small fixture against brute force, with rows past every bound that a part of a table would have."""

import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.plans import corpus, registry

WORDS = [f"w{i}x" for i in range(900)]
DOCS = [(1, " ".join(WORDS[:600])), (5000, " ".join(WORDS[:605])), (5001, "one two three four five six"), (5002, "one two three four five six"), (5003, "élan vital river mill river mill"), (5004, "the river mill 日本 café river")]
ITEMS = [(7, " ".join(WORDS[100:140])), (8, "nothing of this is anywhere")]
LINES = [(k, n, p, s) for k, n, p, s in [(1, 1, 101, 3), (1, 2, 139, 3), (6001, 1, 102, 40), (6001, 2, 139, 5), (6002, 1, 104, 5), (6003, 1, 103, 4), (6003, 2, 139, 4), (700001, 1, 104, 3)]]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    # null n_chars too: no length decides whether a document is read
    rows = [(i, t, "en", "s", None if i == 5001 else len(t)) for i, t in DOCS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    lines = spark.createDataFrame(LINES, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    lines.select("*", F.col("l_linenumber").cast("double").alias("l_quantity"), F.lit(0.05).alias("l_discount"), F.to_timestamp(F.lit("1995-01-02")).alias("l_shipdate")).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(100, "a"), (101, "b")], "c_custkey long, c_name string").write.parquet(f"{d}/customer.parquet")
    spark.sql("SELECT id AS o_orderkey, id % 2 AS o_custkey, to_timestamp(concat(1992 + 2 * (id % 3), '-01-01')) AS o_orderdate FROM range(49, 55)").write.parquet(f"{d}/orders.parquet")
    spark.sql("SELECT id AS event_id, 98 + id % 4 AS user_id, 'click' AS event_type, CAST(id AS double) AS value FROM range(12)").write.parquet(f"{d}/events.parquet")
    return d


def rows(spark, d, name):
    return [tuple(r) for r in registry.queries()[name](spark, d).collect()]


def test_similar_shingles(spark, small):
    def items(t):
        w = t.split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    s = {i: items(t) for i, t in DOCS if i <= 5002}
    want = {(a, b, round(len(s[a] & s[b]) / len(s[a] | s[b]), 6)) for a, b in itertools.combinations(sorted(s), 2) if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])}
    assert set(rows(spark, small, "similar_shingles")) == want and len(want) == 2


def test_window_matches(spark, small):
    want = set()
    for i, t in DOCS:
        w = re.findall(r"\w+", t.lower())
        for s in range(0, len(w), 25):
            win = set(w[s : s + 50])
            for item, text in ITEMS:
                it = set(text.split())
                shared = len(win & it)
                if len(w[s : s + 50]) >= 5 and shared >= 5 and round(shared / len(win | it), 6) >= 0.3:
                    want.add((i, s // 25, item, shared, round(shared / len(win | it), 6)))
    assert set(rows(spark, small, "window_matches")) == want and {i for i, *_ in want} == {1, 5000}


def test_topics(spark, small):
    n = Counter()
    for _, t in DOCS:
        w = re.findall(r"\b[a-z]{3,}\b", t.lower())
        for k in (1, 2, 3):
            n.update(" ".join(g) for g in zip(*(w[j:] for j in range(k)), strict=False) if not set(g) & set(corpus.TOPIC_STOP))
    n = {t: c for t, c in n.items() if len(t) >= 4}
    total = sum(n.values())
    want = sorted(((t, c, round(c / total, 9)) for t, c in n.items() if c >= 2), key=lambda r: (-r[1], r[0]))[:10]
    assert rows(spark, small, "topic_ngrams") == want and "river mill" in {t for t, *_ in want}


def test_graphs(spark, small):
    edges = {(s, p % 100 + 1) for _, _, p, s in LINES}
    nodes = {x for e in edges for x in e}
    assert set(rows(spark, small, "graph_degrees")) == {(v, sum(b == v for _, b in edges), sum(a == v for a, _ in edges)) for v in nodes}
    assert rows(spark, small, "graph_statistics")[0][:2] == (len(nodes), len(edges))
    assert {r[0] for r in rows(spark, small, "graph_neighbors")} == ({b for a, b in edges if a == 5} | {a for a, b in edges if b == 5}) - {5}
    ball = {5} | {b for a, b in edges if a == 5} | {a for a, b in edges if b == 5}
    assert set(rows(spark, small, "graph_ego")) == {(a, b) for a, b in edges if a in ball and b in ball}
    want = {(3, *mid, 40) for k in range(3) for mid in itertools.permutations(nodes - {3, 40}, k) if all(e in edges for e in itertools.pairwise((3, *mid, 40)))}
    assert {tuple(r[0]) for r in rows(spark, small, "graph_paths")} == want
    loops = {c for k in (2, 3) for c in itertools.permutations(nodes, k) if c[0] == min(c) and all(e in edges for e in itertools.pairwise((*c, c[0])))}
    assert {tuple(r[0]) for r in rows(spark, small, "graph_cycles")} == loops
    assert {r[0] for r in rows(spark, small, "graph_pagerank")} == {r[0] for r in rows(spark, small, "graph_hits")} == nodes
    assert {r[0] for r in rows(spark, small, "graph_components")} >= {1, 6001, 6002, 6003, 700001}


def test_records(spark, small):
    m = {(k, p % 50) for k, _, p, _ in LINES}
    pairs = Counter((a, b) for k in {k for k, _ in m} for a, b in itertools.combinations(sorted(str(e) for c, e in m if c == k), 2))
    assert set(rows(spark, small, "entity_cooccurrence")) == {(a, b, n) for (a, b), n in pairs.items()}
    profile = {r["entity"]: (r["mentions"], r["documents"]) for r in registry.queries()["entity_profiles"](spark, small).collect()}
    assert profile == {str(e): (sum(p % 50 == e for _, _, p, _ in LINES), len({k for k, _, p, _ in LINES if p % 50 == e})) for e in {p % 50 for _, _, p, _ in LINES}}
    assert {r["page"] for r in registry.queries()["nearest_captions"](spark, small).collect()} == {k for k, *_ in LINES}
    assert {r["file"] for r in registry.queries()["gedcom_records"](spark, small).collect()} == {100, 101}
    assert len(rows(spark, small, "hash_chain")) == len(rows(spark, small, "smoothed_curve")) == 12
    year = {i: 1992 + 2 * (i % 3) for i in range(49, 55)}
    assert set(rows(spark, small, "links_by_time")) == {(a, b) for a, b in itertools.combinations(sorted(year), 2) if a % 2 == b % 2 and abs(year[a] - year[b]) <= 1}
