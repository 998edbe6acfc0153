import hashlib

from pyspark.sql import functions as F

from quillspark.operators import audit

ROWS = [(log, i, op, f"m{i}" if i % 4 else None, "x") for log in ("a", "b", None) for i, op in enumerate(["add", "drop", "add", "read", "add", "drop"])]
SCHEMA = "log string, no int, op string, message string, previous string"


def chained(spark):
    return audit.hash_chain(spark.createDataFrame(ROWS, SCHEMA).repartition(4), "log", ["no"], ["no", "op", "message"], ["previous"])


def by_hand():
    out, last = {}, {}
    for log, no, op, message, more in ROWS:
        before = last.get(log, "0" * 64)
        last[log] = hashlib.sha256(f"{no}|{op}|{message or ''}|{before}|{more}".encode()).hexdigest()
        out[log, no] = (before, last[log])
    return out


def test_chain(spark):
    got = chained(spark)
    assert got.columns == ["log", "no", "op", "message", "previous", "previous_hash", "entry_hash"]
    assert {(r.log, r.no): (r.previous_hash, r.entry_hash) for r in got.collect()} == by_hand()
    assert audit.hash_chain(spark.createDataFrame([], SCHEMA), "log", ["no"], ["no"]).count() == 0


def test_a_change_shows(spark):
    """What is changed, taken out, put in or hashed anew is found, and the first broken entry is named."""
    good = chained(spark)
    check = lambda df: sorted((str(r.log), r.no, r.fault) for r in audit.broken_entries(df, "log", ["no"], ["no", "op", "message"], ["previous"]).collect())
    assert check(good) == []
    here = (F.col("log") == "a") & (F.col("no") == 2)
    changed = good.withColumn("op", F.when(here, "drop").otherwise(F.col("op")))
    assert check(changed) == [("a", 2, "content")]
    assert check(good.where(~F.coalesce(here, F.lit(False)))) == [("a", 3, "link")]
    assert check(good.withColumn("entry_hash", F.when(here, F.lit(None)).otherwise(F.col("entry_hash")))) == [("a", 2, "content"), ("a", 3, "link")]
    # a hash made anew for a changed entry breaks the next one
    forged = changed.withColumn("entry_hash", F.when(here, audit._entry_hash(["no", "op", "message"], F.col("previous_hash"), ["previous"])).otherwise(F.col("entry_hash")))
    assert check(forged) == [("a", 3, "link")]
    first = audit.first_broken(changed.where("coalesce(log, '') <> 'b' OR no <> 0"), "log", ["no"], ["no", "op", "message"], ["previous"])
    assert sorted((r.log, r.no, r.fault) for r in first.collect()) == [("a", 2, "content"), ("b", 1, "link")]


def test_later_links_depend_on_earlier_entries(spark):
    rows = [(log, no, "add" if (log, no) == ("a", 1) else op, m, p) for log, no, op, m, p in ROWS]
    other = audit.hash_chain(spark.createDataFrame(rows, SCHEMA), "log", ["no"], ["no", "op", "message"], ["previous"])
    want = by_hand()
    same = {(r.log, r.no) for r in other.collect() if want[r.log, r.no][1] == r.entry_hash}
    assert same == {k for k in want if k[0] != "a" or k[1] < 1}
