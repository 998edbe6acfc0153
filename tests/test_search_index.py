"""The keyword index against the scan, on odd chunks."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import search, search_index


@pytest.mark.parametrize("files", [None, 5])
def test_equals_the_scan(spark, tmp_path, files):
    texts = ["red fox and red hen", "the red hen", None, "", "Fox FOX fox", "été à la plage", "x y z", "of the and", "red " * 500 + "fox", "hen"]
    rows = [(i, t, "lib" + str(i % 2), "clash") for i, t in enumerate(texts)]
    rows += [(0, texts[0], "lib0", "clash"), (0, "red", "lib1", "clash"), (None, "fox", "lib1", "clash")]  # ids may repeat or be null
    chunks = spark.createDataFrame(rows, "doc_id long, content string, library string, term string")
    search_index.build(chunks, f"{tmp_path}/index", {"library": F.col("library")}, files=files)
    index = search_index.load(spark, f"{tmp_path}/index")
    for q in ("red fox", "fox fox hen", "été", "the of", "missing", "", "x red"):
        for predicate in (None, F.col("library") == "lib1"):
            assert search_index.bm25(index, q, 5, predicate).collect() == search.bm25(chunks, q, 5, predicate).collect(), q
            assert search_index.tfidf(index, q, 5, predicate).collect() == search.tfidf(chunks, q, 5, predicate).collect(), q


def test_reads_only_the_terms(spark, tmp_path):
    chunks = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id")).alias("content"))
    search_index.build(chunks, f"{tmp_path}/index")
    plan = search_index.bm25(search_index.load(spark, f"{tmp_path}/index"), "word7")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:80]
    assert "PushedFilters" in plan and "word7" in plan


def test_empty(spark, tmp_path):
    empty = spark.createDataFrame([(1, None)], "doc_id long, content string")
    search_index.build(empty.limit(0), f"{tmp_path}/index")
    search_index.build(empty, f"{tmp_path}/wordless")
    assert spark.read.parquet(f"{tmp_path}/index/totals").first()["n"] == 0
    assert spark.read.parquet(f"{tmp_path}/wordless/totals").first()["n"] == 1


def test_files_follow_the_text(spark, tmp_path, monkeypatch):
    """The number of files grows with the texts, in a bounded number of folders, and a frequent term lies over several."""
    monkeypatch.setattr(search_index, "FILE_BYTES", 500)
    monkeypatch.setattr(search_index, "MOST_FOLDERS", 6)
    chunks = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("every"), F.concat(F.lit("word"), F.col("id"))).alias("content"))
    search_index.build(chunks, f"{tmp_path}/index")
    index = search_index.load(spark, f"{tmp_path}/index")
    assert index.postings.select("bucket").distinct().count() == 6 and len(index.postings.inputFiles()) > 6
    every = index.terms.where("term = 'every'").first()
    assert every["df"] == 400 and every["last"] > every["first"]
    for q in ("every", "word7 every", "word399"):
        assert search_index.bm25(index, q, 9).collect() == search.bm25(chunks, q, 9).collect()
