import hashlib
import re

from pyspark.sql import types as T

from quillspark.llm import exact_dedup

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("run", T.LongType())])


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (m[0], -1 if m[1] is None else m[1]))[1]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for _, i in members]
    return sorted(out, key=str)


def test_groups(spark):
    rows = [(1, "a b", "x", 1), (2, "ab", "x", 1), (3, "a  b", "x", 1), (4, "\ta\x0bb\n", "x", 1), (5, None, "x", 1), (6, "", "x", 1), (7, " \r", "x", 1), (8, "a\xa0b", "x", 1), (9, "é" * 10_000, "x", 1), (9, "é" * 10_000, "x", 1), (None, "A b", None, None), (10, "𝒳 y", "x", 1)]
    rows += [(100 + i, "copy" + " " * (i % 3), "x", i) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    for runs, fan_in in ((20, 16), (40, 2), (9, 3), (1, 2)):
        got = sorted((tuple(r) for r in exact_dedup.exact_groups(docs.repartition(runs), fan_in=fan_in).collect()), key=str)
        assert got == brute(rows)
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r[0] for r in left.collect() if r[0] is not None) == [4, 7, 8, 9, 10, 102]


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.drop_exact_copies(docs).count() == 0


def test_repeated_and_null_ids(spark):
    """A repeated row costs no other document: ids may be null or carry several texts; the longest text stays."""
    rows = [(1, "A"), (1, "A"), (1, "B"), (None, "x"), (None, "x"), (None, "y"), (None, "z"), (2, "pq"), (2, "p q"), (2, "p\tq"), (3, "p q"), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], DOCS)
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted((tuple(r[:2]) for r in left.collect()), key=str) == sorted([(1, "A"), (1, "B"), (None, "x"), (None, "y"), (None, "z"), (2, "p\tq"), (4, "")], key=str)


def test_no_copy_is_lost_beside_repeated_rows(spark):
    """A repeated row elsewhere doesn't cost a document that has no copy; equal rows leave one."""
    rows = [(1, "alpha"), (1, "beta"), (2, "gamma"), (2, "gamma"), (3, "a b"), (3, "ab "), (3, "ab ")]
    docs = spark.createDataFrame([(i, t, "k", 5) for i, t in rows], DOCS).repartition(5)
    left = sorted(tuple(r[:2]) for r in exact_dedup.drop_exact_copies(docs).collect())
    assert left == [(1, "alpha"), (1, "beta"), (2, "gamma"), (3, "a b")]


def test_runs_are_merged_without_python_or_windows(spark):
    docs = spark.createDataFrame([(i, f"t{i % 7}", "x", 1) for i in range(100)], DOCS).repartition(7)
    plan = exact_dedup.exact_groups(docs, fan_in=2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan
    rows = exact_dedup.digests(docs)
    merged = exact_dedup.merge_runs(rows, fan_in=2)
    assert merged.count() == 7 and merged.agg({"group_size": "sum"}).first()[0] == 100
