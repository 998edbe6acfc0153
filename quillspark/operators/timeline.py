"""Events in time: log records, timelines, correlation, study schedules, budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_format(body: Column) -> Column:
    """cloudtrail, ecs, syslog or generic, by the keys of the JSON text."""
    has = lambda *paths: F.greatest(*[F.get_json_object(body, p).isNotNull() for p in paths], F.lit(False))
    return F.when(has("$.eventName") & has("$.eventTime"), "cloudtrail").when(has("$.ecs"), "ecs").when(has("$.PROGRAM", "$.HOST"), "syslog").otherwise("generic")


def flatten_log(body: Column) -> list[Column]:
    """One flat record from the three forms of a log: timestamp, src_ip, event_id, user, host, message."""
    first = lambda *paths: F.coalesce(*[F.get_json_object(body, p) for p in paths])
    return [
        first("$.eventTime", "$['@timestamp']", "$.ISODATE", "$.timestamp").alias("timestamp"),
        first("$.sourceIPAddress", "$.source.ip", "$.SOURCEIP", "$.src_ip").alias("src_ip"),
        first("$.eventName", "$.event.action", "$.PROGRAM", "$.event_id").alias("event_id"),
        first("$.userIdentity.userName", "$.user.name", "$.USER", "$.user").alias("user"),
        first("$.host.name", "$.HOST", "$.host").alias("host"),
        first("$.message", "$.MSG").alias("message"),
        log_format(body).alias("log_format"),
    ]


def mask_ip(ip: Column, allowed: list[str] = ()) -> Column:
    masked = F.regexp_replace(ip, r"^([0-9]+\.[0-9]+)\.[0-9]+\.[0-9]+$", "$1.xxx.xxx")
    return F.when(ip.isin(list(allowed)), ip).otherwise(masked) if allowed else masked


def between(events: DataFrame, start, end, time: str = "ts", unique: str = "event_id") -> DataFrame:
    return events.where(F.col(time).between(start, end)).orderBy(time, unique)


def actor_groups(events: DataFrame, actor: str) -> DataFrame:
    """Groups of two events or more by actor; confidence grows with their number up to 0.9."""
    n = F.count(F.lit(1))
    return events.groupBy(actor).agg(n.alias("events"), F.round(F.least(F.lit(0.9), 0.5 + 0.1 * n), 6).alias("confidence"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).where("events > 1")


def anchored_groups(events: DataFrame, by: str, seconds: int = 300, time: str = "ts", unique: str = "event_id") -> DataFrame:
    """Groups that begin with an event and hold all events up to `seconds` after that first one, within each `by`.

    Not a session window: the gap counts from the group's first event. The fold runs over the times of
    one key at a time, in batches sorted by key, so a key's rows are read as a stream.
    """
    span = seconds * 1_000_000

    def fold(batches):
        key = start = None
        group = 0
        for pdf in batches:
            numbers = []
            for k, t in zip(pdf["by"], pdf["us"], strict=True):
                if k != key:
                    key, start, group = k, t, 0
                elif t - start > span:
                    start, group = t, group + 1
                numbers.append(group)
            yield pd.DataFrame({"id": pdf["id"], "by": pdf["by"], "group_no": numbers})

    kinds = dict(events.dtypes)
    rows = events.select(F.col(unique).alias("id"), F.col(by).alias("by"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"))
    placed = rows.repartition("by").sortWithinPartitions("by", "us", "id")
    return placed.mapInPandas(fold, f"id {kinds[unique]}, by {kinds[by]}, group_no long").withColumnsRenamed({"id": unique, "by": by})


def next_interval(quality: Column, previous: Column, ease: Column) -> list[Column]:
    """Spaced repetition: next interval (days) and ease; a quality below 3 starts anew. Ease never falls below 1.3."""
    miss = 5 - quality
    new_ease = F.greatest(F.lit(1.3), ease + 0.1 - miss * (0.08 + miss * 0.02))
    days = F.when(quality < 3, 1).when(previous == 0, 1).when(previous == 1, 6).otherwise(F.floor(previous * new_ease).cast("int"))
    return [days.alias("interval_days"), F.round(new_ease, 6).alias("ease")]


def streak(reviews: DataFrame, day: str, by: str) -> DataFrame:
    """Days of the latest run of consecutive days of each `by`."""
    days = reviews.select(by, F.col(day).cast("date").alias("d")).distinct()
    island = F.date_sub(F.col("d"), F.row_number().over(Window.partitionBy(by).orderBy("d")))
    runs = days.withColumn("i", island).groupBy(by, "i").agg(F.count(F.lit(1)).alias("days"), F.max("d").alias("last_day"))
    return runs.groupBy(by).agg(F.max_by("days", "last_day").alias("days"), F.max("last_day").alias("last_day"))


def budget(rows: DataFrame, by: str, order: list, cost: str, most: int, unique: str) -> DataFrame:
    """Greedy choice within each `by`: rows in order are taken while they fit; one that doesn't is skipped, later ones may fit.

    The rows of a `by` (a conversation, a query) are folded in one JVM expression.
    """
    items = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(unique).alias("id"), F.col(cost).cast("long").alias("cost"))))
    start = F.struct(F.lit(most).cast("long").alias("left"), F.array().cast(f"array<{dict(rows.dtypes)[unique]}>").alias("ids"))
    step = lambda s, x: F.when(x["cost"] <= s["left"], F.struct((s["left"] - x["cost"]).alias("left"), F.array_append(s["ids"], x["id"]).alias("ids"))).otherwise(s)
    taken = rows.groupBy(by).agg(F.aggregate(items, start, step).alias("t"))
    return taken.select(by, F.explode("t.ids").alias(unique), (most - F.col("t.left")).alias("used"))


def smooth(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Centred mean over three rows, shorter at the ends, three digits."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-1, 1)
    return rows.withColumn("smoothed", F.round(F.avg(value).over(w), 3))
