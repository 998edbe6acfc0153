"""Pipelines of named stages: registry, validation, runs with saved stages, incremental runs.

A stage is a DataFrame -> DataFrame function with the columns it needs and gives. Registration is
explicit; nothing is imported from folders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.tables import changed_files, upsert


@dataclass(frozen=True)
class Stage:
    name: str
    apply: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ()
    gives: tuple[str, ...] = ()
    priority: int = 100


REGISTRY: dict[str, Stage] = {}


def register(name: str, needs: tuple[str, ...] = (), gives: tuple[str, ...] = (), priority: int = 100):
    """Decorator: make a function known as a stage."""

    def keep(apply: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        REGISTRY[name] = Stage(name, apply, tuple(needs), tuple(gives), priority)
        return apply

    return keep


def from_blueprint(blueprint: dict) -> list[Stage]:
    """The stages that a declaration names, in its order, or by priority where it has no order."""
    names = blueprint.get("stages", [])
    unknown = [n for n in names if n not in REGISTRY]
    if unknown:
        raise KeyError(f"unknown stages: {unknown}")
    stages = [REGISTRY[n] for n in names]
    return stages if blueprint.get("ordered", True) else sorted(stages, key=lambda s: (s.priority, s.name))


def problems(stages: list[Stage], columns: list[str]) -> list[str]:
    """What a run would lack, without running it."""
    have, out = set(columns), []
    for s in stages:
        out += [f"{s.name}: needs {c}" for c in s.needs if c not in have]
        have |= set(s.gives)
    return out


def run(df: DataFrame, stages: list[Stage], after: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
    if found := problems(stages, df.columns):
        raise ValueError("; ".join(found))
    for s in stages:
        df = s.apply(df)
        if after:
            after(s.name, df)
    return df


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def run_saved(df: DataFrame, stages: list[Stage], folder: str) -> DataFrame:
    """Each stage's rows are written below the folder; a later call takes up behind the last stage that was completed."""
    spark = df.sparkSession
    paths = [f"{folder.rstrip('/')}/{i:02d}-{s.name}" for i, s in enumerate(stages)]
    done = [i for i, p in enumerate(paths) if _exists(spark, f"{p}/_SUCCESS")]
    start = max(done) + 1 if done else 0
    if done:
        df = spark.read.parquet(paths[start - 1])
    for s, path in zip(stages[start:], paths[start:], strict=True):
        s.apply(df).write.mode("overwrite").parquet(path)
        df = spark.read.parquet(path)
    return df


def first_that_works(expressions: list[str], default: str = "NULL"):
    """A column of the first expression that isn't null; errors of casts count as null where they are try_ forms."""
    return F.expr(f"coalesce({', '.join(expressions)}, {default})")


def incremental(files: DataFrame, manifest: DataFrame, process: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(results of new and modified files, the manifest afterwards); files and manifest: path, hash."""
    states = changed_files(files, manifest)
    todo = files.join(states.where("state IN ('new', 'modified')").select("path"), "path", "left_semi")
    return process(todo), upsert(manifest.select("path", "hash"), todo.select("path", "hash"), "path")
