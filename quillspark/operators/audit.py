"""Audit logs as hash chains: each entry's hash covers the hash of the one before, so a change breaks all that follow."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what stands before the first entry.
GENESIS = "0" * 64


def _entry_hash(before: Sequence[str], previous: Column, after: Sequence[str]) -> Column:
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in before] + [previous] + [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in after]
    return F.sha2(F.concat_ws("|", *cells), 256)


def hash_chain(log: DataFrame, by: str, order: Sequence[str], before: Sequence[str], after: Sequence[str] = ()) -> DataFrame:
    """log with `previous_hash` and `entry_hash`, each log (by) a chain in the given order.

    entry_hash is the sha256 (hex) of the columns `before`, the previous hash and the columns `after`, as text with | between
    them; nulls count as empty. order should tell the entries of a log apart. A chain is sequential by its nature, so
    a log is one sorted stream in one task, of which only the last hash is held; logs go to different tasks.
    """
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*before, *after)]
    rows = log.withColumn("__by", F.col(by).cast("string")).withColumn("__cells", F.array(*cells))
    rows = rows.repartition("__by").sortWithinPartitions("__by", *order)
    cut = len(before)

    names = log.columns

    def chain(batches):
        log_now, last, begun = None, GENESIS, False
        for batch in batches:
            previous, own = [], []
            for log_id, parts in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__by", "__cells")), strict=True):
                if not begun or log_id != log_now:
                    log_now, last, begun = log_id, GENESIS, True
                previous.append(last)
                last = hashlib.sha256("|".join([*parts[:cut], last, *parts[cut:]]).encode()).hexdigest()
                own.append(last)
            out = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names], names=names)
            yield out.append_column("previous_hash", pa.array(previous, pa.string())).append_column("entry_hash", pa.array(own, pa.string()))

    fields = ", ".join(f"`{c}` {t}" for c, t in log.dtypes)
    return rows.mapInArrow(chain, f"{fields}, previous_hash string, entry_hash string")


def broken_entries(log: DataFrame, by: str, order: Sequence[str], before: Sequence[str], after: Sequence[str] = ()) -> DataFrame:
    """Entries of stored chains that do not hold, with `fault`: link (the previous hash is not that of the entry before)
    or content (the entry's hash is not that of its columns). Entries check by themselves and their predecessor alone, so
    one shuffle does for all of them; null hashes never hold."""
    expected = F.coalesce(F.lag("entry_hash").over(Window.partitionBy(by).orderBy(*order)), F.lit(GENESIS))
    rows = log.withColumn("__expected", expected)
    own = _entry_hash(before, F.coalesce("previous_hash", F.lit("")), after)
    fault = F.when(~F.col("previous_hash").eqNullSafe(F.col("__expected")), "link").when(~F.col("entry_hash").eqNullSafe(own), "content")
    return rows.withColumn("fault", fault).where("fault IS NOT NULL").drop("__expected")


def first_broken(log: DataFrame, by: str, order: Sequence[str], before: Sequence[str], after: Sequence[str] = ()) -> DataFrame:
    """Per log whose chain is broken its first broken entry, with `fault`."""
    rows = broken_entries(log, by, order, before, after)
    return rows.groupBy(by).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")
