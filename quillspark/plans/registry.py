"""All queries of the engine by name, with the DuckDB SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import context, corpus, curation, discovery, documents, enrichment, language, records, retrieval
from .base import ORACLES, QUERIES

MODULES = (context, corpus, curation, discovery, documents, enrichment, language, records, retrieval)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["search_bm25"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
