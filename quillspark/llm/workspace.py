"""Tables written between stages of one operator, in the folder that all executors share.

Writing a table cuts the lineage (a lost executor costs a read, not a recomputation) and makes
row identities such as (part, idx) final: only the committed attempt of a task is ever read.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None


def root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and the session is local."""
    global _own_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return _own_root


def _own(spark: SparkSession) -> str:
    return f"{root(spark)}/quillspark/{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder, in a folder for each value of `by` if given, and read it back
    with its own schema."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_all(spark: SparkSession) -> None:
    """Delete every table that the operators of this application wrote; call it when results are consumed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
