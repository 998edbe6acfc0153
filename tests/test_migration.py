import pytest
from pyspark.sql import functions as F

from quillspark.sources import migration

ROWS = [(f"d{i % 23}" if i % 17 else None, i, f"text {i}", "x") for i in range(200)]
SCHEMA = "document_id string, n int, content string, batch string"


def test_an_interrupted_run_is_taken_up(spark, tmp_path):
    source, path = spark.createDataFrame(ROWS, SCHEMA).repartition(3), f"{tmp_path}/copy"
    written = []

    def stop_at(most):
        def hook(batch):
            written.append(batch)
            if len(written) == most:
                raise RuntimeError("stopped")

        return hook

    with pytest.raises(RuntimeError):
        migration.migrate(source, path, 6, before_commit=stop_at(3))
    assert written == [0, 1, 2] and sorted(r.batch for r in migration.commit_log(spark, path).collect()) == [0, 1]
    part = migration.migrated(spark, path, source)
    assert not migration.verify(source, part)
    found = {r.document_id: r.status for r in migration.verify_documents(source, part).collect()}
    assert set(found.values()) == {"ok", "missing"}
    log = migration.migrate(source, path, 6, before_commit=stop_at(-1))
    assert written == [0, 1, 2, 2, 3, 4, 5]  # the third was written again, the first two were not
    assert sorted(r.batch for r in log.collect()) == list(range(6)) and sum(r.rows for r in log.collect()) == 200
    assert sum(r.documents for r in log.collect()) == len({r[0] for r in ROWS})
    whole = migration.migrated(spark, path, source)
    assert sorted(map(str, whole.collect())) == sorted(map(str, source.collect())) and migration.verify(source, whole)
    migration.migrate(source, path, 6, before_commit=stop_at(-1))
    assert len(written) == 7
    with pytest.raises(ValueError, match="batches"):
        migration.migrate(source, path, 3)


def test_what_differs_is_named(spark):
    source = spark.createDataFrame(ROWS, SCHEMA)
    target = source.where("n <> 5 AND coalesce(document_id, '') <> 'd7'").withColumn("content", F.when(F.col("n") == 9, "other").otherwise(F.col("content")))
    target = target.unionByName(spark.createDataFrame([("new", 1, "t", "x")], SCHEMA)).select("content", "n", "batch", "document_id")
    found = {r.document_id: r.status for r in migration.verify_documents(source, target).collect()}
    assert {k: v for k, v in found.items() if v != "ok"} == {"d5": "count", "d7": "missing", "d9": "content", "new": "extra"}
    assert None in found and len(found) == 25 and not migration.verify(source, target)
    assert migration.verify(source, source.select("batch", "content", "n", "document_id").repartition(7))


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert migration.migrated(spark, f"{tmp_path}/none", none).count() == 0
    migration.migrate(none, f"{tmp_path}/e", 2)
    assert migration.migrated(spark, f"{tmp_path}/e", none).count() == 0 and migration.verify_documents(none, none).count() == 0
