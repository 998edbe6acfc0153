"""Copies of a table into another store, batch by batch, that take up where they stopped, and their verification.

A batch is the documents with one hash of their key. It is written whole, over whatever an interrupted run left of it,
and only then entered in the commit log; what the log names is never written again. So no document is lost or repeated,
wherever a run ends. Every batch reads the source once: few and large batches suit large tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "batch int, rows long, documents long, digest decimal(38,0)"


def _digest(df: DataFrame) -> Column:
    """A sum over rows, whatever their order, that changes with any value; columns by name, so their order is free."""
    return F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per committed batch: batch, rows, documents, digest."""
    names = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    there = names.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(names)
    return spark.read.schema(LOG).parquet(f"{path}/log") if there else spark.createDataFrame([], LOG)


def migrate(source: DataFrame, path: str, batches: int = 8, key: str = "document_id", before_commit: Callable[[int], None] | None = None) -> DataFrame:
    """Copy source to path/data in batches; returns the commit log. The number of batches of a copy must stay as it was.

    before_commit is called with each batch after it is written and before it is entered; if it raises, the batch is
    not committed. Null keys are a document of their own. Nothing is copied twice when called again.
    """
    spark = source.sparkSession
    of = F.pmod(F.xxhash64(key), F.lit(batches)).cast("int")
    done = {r["batch"] for r in commit_log(spark, path).select("batch").collect()}
    if any(b >= batches for b in done):
        raise ValueError("the copy was begun with more batches")
    for batch in [b for b in range(batches) if b not in done]:
        rows = source.where(of == batch)
        target = f"{path}/data/{batch:05d}"
        rows.write.mode("overwrite").parquet(target)
        if before_commit:
            before_commit(batch)
        written = spark.read.schema(source.schema).parquet(target)
        counts = written.agg(F.count(F.lit(1)).alias("rows"), (F.count_distinct(key) + F.max(F.when(F.col(key).isNull(), 1).otherwise(0))).alias("documents"), _digest(written).alias("digest"))
        line = counts.select(F.lit(batch).alias("batch"), "rows", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"), F.col("digest").cast("decimal(38,0)").alias("digest"))
        line.coalesce(1).write.mode("append").parquet(f"{path}/log")
    return commit_log(spark, path)


def migrated(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The committed part of a copy, with the columns of `like`."""
    done = sorted(r["batch"] for r in commit_log(spark, path).select("batch").distinct().collect())
    return spark.read.schema(like.schema).parquet(*[f"{path}/data/{b:05d}" for b in done]) if done else like.limit(0)


def verify_documents(source: DataFrame, target: DataFrame, key: str = "document_id") -> DataFrame:
    """Per document of either side: key, source_n, target_n, status: ok, missing, extra, count (different numbers of rows)
    or content (as many, but not the same rows). Both sides meet as one row a document."""
    side = lambda df, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(f"{n}_n"), _digest(df).alias(f"{n}_digest"))
    a, b = side(source, "source").alias("a"), side(target, "target").alias("b")
    both = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full_outer")
    status = (
        F.when(F.col("target_n").isNull(), "missing")
        .when(F.col("source_n").isNull(), "extra")
        .when(F.col("source_n") != F.col("target_n"), "count")
        .when(F.col("source_digest") != F.col("target_digest"), "content")
        .otherwise("ok")
    )
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.coalesce("source_n", F.lit(0)).alias("source_n"), F.coalesce("target_n", F.lit(0)).alias("target_n"), status.alias("status"))


def verify(source: DataFrame, target: DataFrame) -> bool:
    """Whether both sides have as many rows and the same digest."""
    sums = [tuple(df.agg(F.count(F.lit(1)), _digest(df)).first()) for df in (source, target)]
    return sums[0] == sums[1]
