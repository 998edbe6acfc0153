"""Content hashes with expiry over several batches, with a restart from the checkpoint before each."""

from datetime import datetime, timedelta

import pytest

from quillspark.streaming import ingest

START = datetime(2024, 1, 1)


def run(spark, tmp_path, batches, **kw):
    """Contents that each batch gives; a batch is a file that comes after the query has stopped."""
    schema, given = "content string, ts timestamp", []
    for no, rows in enumerate(batches):
        timed = [(c, None if m is None else START + timedelta(minutes=m)) for c, m in rows]
        spark.createDataFrame(timed, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.stream_table(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        ingest.run_once(stream, lambda s: ingest.new_contents(s, **kw).select("content", "ts"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        seen = sorted(((r["content"] or "") for r in spark.read.parquet(str(tmp_path / "out")).collect()))
        before = [c for g in given for c in g]
        for c in before:
            seen.remove(c)
        given.append(seen)
    return given


BATCHES = [[("a", 0), ("a", 1), ("b", 50), (None, 50), (None, 51)], [("a", 40), ("c", 200)], [("a", 210), ("c", 215), ("b", 220), ("late", 100)], [("a", 215), ("d", 216)]]


def test_expired_hashes_are_met_again(spark, tmp_path):
    """Within an hour a content is known. After the second batch the watermark is at 140 minutes: a and b are forgotten."""
    assert run(spark, tmp_path, BATCHES, time="ts", forget="1 hour") == [["", "a", "b"], ["c"], ["a", "b"], ["d"]]


def test_hashes_stay_without_expiry(spark, tmp_path):
    assert run(spark, tmp_path, BATCHES) == [["", "a", "b"], ["c"], ["late"], ["d"]]


def test_rows_without_a_time(spark, tmp_path):
    assert run(spark, tmp_path, [[("a", None), ("a", None), ("b", 100)], [("a", None), ("b", 101)]], time="ts", forget="1 hour") == [["a", "b"], ["a"]]


def test_time_and_forget_go_together(spark):
    with pytest.raises(ValueError):
        ingest.new_contents(spark.createDataFrame([("a",)], "content string"), forget="1 hour")
