"""Every registered query of the engine against its DuckDB form on the small tables."""

import datetime
import math
import os

import duckdb
import numpy as np
import pytest

from quillspark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None:
        return "N"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, datetime.datetime):
        return str(x.replace(tzinfo=None))
    return str(x)


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_duckdb(spark, sf_dir, oracle, name):
    got = registry.queries()[name](spark, sf_dir)
    names = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    want = oracle.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf_dir, name):
    """Queries without SQL run in full; what they give is tested against brute force in their operators' tests."""
    got = registry.queries()[name](spark, sf_dir)
    rows = got.collect()
    assert got.columns and all(len(r) == len(got.columns) for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).collect()) == 10
