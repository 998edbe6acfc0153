"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def attached(rows: DataFrame, values: DataFrame, key: str | list[str], spread: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """rows with the columns of values, which has at most one row for each key; how: inner or left.

    Rows are salted by `spread`; each value goes once to every salt that its key has, folded on the map side,
    so no task of the wide join sees more than a salt's share of a hot key.
    """
    keys = [key] if isinstance(key, str) else key
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    per_salt = salted.select(*keys, "__salt").distinct().join(values, keys)
    return salted.join(per_salt, [*keys, "__salt"], how).drop("__salt")
