"""From raw documents to packed training sequences: toxicity, exact dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Between stages
the rows are written as Parquet and read again, so a lost executor never reaches back past one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import exact_dedup, minhash_dedup, packing, queries, toxicity, workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold=0.7)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without blanks, the longest original stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity 0.8 or more), one document stays."""
    return minhash_dedup.drop_near_copies(docs, size=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit decreasing into sequences of 1024 tokens."""
    return packing.pack_documents(docs, queries.vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("minhash_dedup", drop_near_copies), ("packing", pack)]

#: Classification, 64-bit shingles and best-fit packing have no DuckDB form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = workspace.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
