"""Exact dedup by a tree merge of sorted digest runs, in DataFrame operations only.

Every partition of the input makes one run: its digests in sorted order, equal digests folded to one
entry (best row, row count) by the map side of the first round. Partitions then exchange runs in
binomial rounds: with a fan-in of f, round k sends run r to the run with digit k of r (base f) set to
zero, where the sorted runs are merged and each digest keeps its smallest entry. After log_f(runs) rounds
run 0 holds one entry for each digest; a run lies across tasks by ranges of hashed digests, so no task
ever holds a whole one. An entry is an ordered struct, for which Spark sorts and merges. A hot digest has
at most f entries in any merge, however many rows carry it. The winners go back by (digest, run), so the
join that labels the rows spreads a hot digest over the runs.

Entries are verified: two texts only merge when SHA-256, length and a second 64-bit hash all agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import workspace

#: The characters that normalisation deletes: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, sha, n_norm, check, run) of each row; run: the partition that read it. Null text counts as empty."""
    norm = normalised(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
        norm.alias("norm"),
    ).select(
        "doc_id",
        "n_chars",
        F.unhex(F.sha2("norm", 256)).alias("sha"),
        F.length("norm").cast("long").alias("n_norm"),
        F.xxhash64("norm").alias("check"),
        F.spark_partition_id().alias("run"),
    )


def merge_runs(rows: DataFrame, fan_in: int = 16) -> DataFrame:
    """(sha, n_norm, check, best, group_size): best is the struct (-n_chars, doc_id) of the row that stays.

    rows: as of digests, with run >= 0. Rounds: as many as the largest run number has digits base fan_in, one
    at least. Order of ties: more code points first, then the smaller doc_id (nulls first, as Spark orders them).
    """
    keys = ["sha", "n_norm", "check"]
    last = rows.agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]
    entry = F.struct((-F.col("n_chars")).alias("neg"), F.col("doc_id").alias("doc_id"))
    level, stride = rows.select(*keys, "run", entry.alias("best"), F.lit(1).cast("long").alias("group_size")), 1
    while stride == 1 or stride <= last:
        stride *= fan_in
        owner = F.col("run") - F.col("run") % F.lit(stride)
        level = level.withColumn("run", owner).groupBy(*keys, "run").agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
    return level.drop("run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Defined cases: null text = empty text; an empty table gives no rows; rows that repeat a doc_id
    are counted in group_size, and all rows with the id that stays are kept = true; a null doc_id
    sorts before others. Extra input columns are not read.
    """
    rows = workspace.staged(digests(docs, id_col, text_col), "exact-digests")
    keys = ["sha", "n_norm", "check"]
    best = merge_runs(rows, fan_in).select(*keys, F.col("best.doc_id").alias("keep_id"), "group_size")
    # down the tree: the winner goes to each run that holds its digest, then to the rows of that run
    per_run = rows.select(*keys, "run").distinct().join(best, keys)
    return rows.join(per_run, [*keys, "run"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without its exact copies, one row for each normalised text, columns unchanged.

    The row with the most code points stays, then the smaller doc_id (nulls first). Ids may be null or
    repeated: rows with the same id and different texts are different documents. Rows that tie in id,
    digest and length are folded on the map side, before the texts move, to the one with the least text.
    """
    best = merge_runs(workspace.staged(digests(docs, id_col, text_col), "exact-digests"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    winners = best.select(name(F.col("best.doc_id")).alias("id"), (-F.col("best.neg")).alias("n"), "sha")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(name(F.col(id_col)).alias("id"), F.length(text).cast("long").alias("n"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("sha"), F.struct(*docs.columns).alias("row"), F.struct(text.alias("text"), F.col(text_col).isNull().alias("none")).alias("order"))
    # the join is on the keys of the groups, so the texts cross one exchange
    one = keyed.groupBy("id", "n", "sha").agg(F.min_by("row", "order").alias("row"))
    return one.join(winners, ["id", "n", "sha"], "left_semi").select("row.*")
