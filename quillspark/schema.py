"""The chunk table and how the test tables play its role."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_s, _i, _a = T.StringType(), T.IntegerType(), T.ArrayType(T.StringType())
CHUNK = T.StructType(
    [T.StructField(n, _s) for n in ("chunk_id", "document_id", "content", "section_title", "chunk_type", "source_file")]
    + [T.StructField(n, _i) for n in ("word_count", "char_count", "chunk_index", "total_chunks", "page_start", "page_end")]
    + [T.StructField(n, _a) for n in ("section_hierarchy", "tags", "entities", "concepts")]
    + [T.StructField(n, _s) for n in ("library", "author_id", "author_name", "element_type")]
    + [
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("is_read", T.BooleanType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("metadata", T.MapType(_s, _s)),
    ]
)
DEFAULTS = {"library": "default", "chunk_type": "content", "element_type": "NarrativeText", "is_read": False}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_chunks(df: DataFrame) -> DataFrame:
    """df with every chunk column: missing ones are null or have their default, others go."""
    have = dict(df.dtypes)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in CHUNK.fields])


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in the role of chunks: text is content, lang is library, source is source_file."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id"), F.col("text").alias("content"), F.col("lang").alias("library"), F.col("source").alias("source_file"), F.col("n_chars").alias("char_count"))
