"""Operators on chunk and record tables: filters, tags, merges, splits, sync, orphans, validation, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Time stamp forms that are tried in order.
TIME_FORMS = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd"]


def parse_time(value: Column) -> Column:
    """The first form that fits; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in TIME_FORMS])


def all_of(*predicates: Column | None) -> Column:
    """Conjunction of those given; null counts as false."""
    given = [F.coalesce(p, F.lit(False)) for p in predicates if p is not None]
    return reduce(lambda a, b: a & b, given, F.lit(True))


def topic_share(content: Column, topic: str) -> Column:
    """Share of the topic's words that the content contains."""
    words = topic.lower().split()
    return reduce(lambda a, b: a + b, [F.contains(F.lower(content), F.lit(w)).cast("int") for w in words]) / len(words)


def upsert(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows replace the target's rows of equal key, whole; others stay."""
    return target.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def push_delta(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Local rows whose key the remote side lacks."""
    return local.join(remote.select(key).distinct(), key, "left_anti")


def sync_counts(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """One row: keys on each side, on both, and missing from the other."""
    both = local.select(key).distinct().withColumn("l", F.lit(1)).join(remote.select(key).distinct().withColumn("r", F.lit(1)), key, "full_outer")
    return both.agg(F.count("l").alias("local"), F.count("r").alias("remote"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count_if(F.col("r").isNull()).alias("to_push"), F.count_if(F.col("l").isNull()).alias("to_pull"))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose key is given and has no parent."""
    return children.where(F.col(child_key).isNotNull()).join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def link_orphans(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links (src, dst) with an unknown end and the first reason; none while nothing is known."""
    k = known.select("node").distinct()
    a = links.join(k.select(F.col("node").alias("src"), F.lit(True).alias("has_src")), "src", "left")
    b = a.join(k.select(F.col("node").alias("dst"), F.lit(True).alias("has_dst")), "dst", "left")
    some = k.agg((F.count(F.lit(1)) > 0).alias("some"))
    reason = F.when(F.col("has_src").isNull(), "unknown source").when(F.col("has_dst").isNull(), "unknown target")
    return b.crossJoin(F.broadcast(some)).where("some").select("src", "dst", reason.alias("reason")).where("reason IS NOT NULL")


def split_by_size(rows: DataFrame, order: str, size: int, by: str) -> DataFrame:
    """Consecutive groups of `size` rows within each `by`, numbered from 0."""
    return rows.withColumn("split", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size))


def split_by_topic(rows: DataFrame, topic: Column, least: int = 10) -> DataFrame:
    """The topic of each row; topics of fewer than `least` rows become 'other'."""
    named = rows.withColumn("topic", F.coalesce(topic, F.lit("general")))
    counts = named.groupBy("topic").agg(F.count(F.lit(1)).alias("__n"))
    return named.join(counts, "topic").withColumn("topic", F.when(F.col("__n") >= least, F.col("topic")).otherwise("other")).drop("__n")


def concat_by_parent(rows: DataFrame, parent: str, order: str, content: str, gap: str = "\n\n") -> DataFrame:
    """One row for each parent: contents in order, and their number."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(content))))
    return rows.groupBy(parent).agg(F.array_join(F.transform(pairs, lambda p: p[content]), gap).alias(content), F.count(F.lit(1)).alias("parts"))


def merge_records(rows: DataFrame, key: str, order: str, strategies: dict[str, str]) -> DataFrame:
    """One record for each key. first, last: of non-null values in order; accumulate: all, in order; unique: distinct, in order of first sight."""
    made = []
    for name, how in strategies.items():
        value, seen = F.col(name), F.col(name).isNotNull()
        listed = F.transform(F.array_sort(F.collect_list(F.when(seen, F.struct(F.col(order).alias("o"), value.alias("v"))))), lambda p: p["v"])
        made.append(
            {
                "first": F.min_by(F.when(seen, value), F.when(seen, F.col(order))),
                "last": F.max_by(F.when(seen, value), F.when(seen, F.col(order))),
                "accumulate": listed,
                "unique": F.array_distinct(listed),
            }[how].alias(name)
        )
    return rows.groupBy(key).agg(*made)


def validation_errors(rules: dict[str, dict]) -> Column:
    """Array of messages: a missing required value, else a bad range or length."""
    found = []
    for name, rule in rules.items():
        c = F.col(name)
        if rule.get("required"):
            found.append(F.when(c.isNull(), F.lit(f"{name}: required")))
        if "low" in rule:
            found.append(F.when(c < rule["low"], F.lit(f"{name}: below {rule['low']}")))
        if "high" in rule:
            found.append(F.when(c > rule["high"], F.lit(f"{name}: above {rule['high']}")))
        if "length" in rule:
            found.append(F.when(F.length(c) > rule["length"], F.lit(f"{name}: longer than {rule['length']}")))
    return F.array_compact(F.array(*found))


def cast_errors(columns: dict[str, str]) -> Column:
    """Names of columns whose text isn't a value of the wanted type."""
    return F.array_compact(F.array(*[F.when(F.col(n).isNotNull() & F.col(n).try_cast(t).isNull(), F.lit(n)) for n, t in columns.items()]))


def sort_table(rows: DataFrame, column: str, descending: bool = False, unique: str = "id") -> DataFrame:
    """Nulls last upwards and first downwards; strings without regard to case; ties by the unique column."""
    key = F.lower(column) if dict(rows.dtypes)[column] == "string" else F.col(column)
    return rows.orderBy(key.desc_nulls_first() if descending else key.asc_nulls_last(), unique)


def adjacent_islands(rows: DataFrame, by: str, number: str) -> DataFrame:
    """Runs of consecutive numbers within each `by`: by, first, last, parts."""
    n = F.col(number) - F.row_number().over(Window.partitionBy(by).orderBy(number))
    return rows.withColumn("__i", n).groupBy(by, "__i").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("parts")).drop("__i")


def changed_files(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """now (path, hash) against manifest (path, hash): new, modified, unchanged or error (no hash)."""
    known = manifest.select("path", F.col("hash").alias("__old"))
    state = F.when(F.col("hash").isNull(), "error").when(F.col("__old").isNull(), "new").when(F.lower("hash") != F.lower("__old"), "modified").otherwise("unchanged")
    return now.join(known, "path", "left").select("path", "hash", state.alias("state"))
