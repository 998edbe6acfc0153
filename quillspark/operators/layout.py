"""Elements of pages by place: overlaps of intervals and boxes, elements of a text range, boxes linked to entities.

Overlaps are found by a grid: an interval or box goes to each cell that it touches, cells meet in an equi-join, and a
pair counts only in the first cell that both touch, so each pair comes once and without a distinct. A cell of a page holds
no more than lies there, however many elements the page has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a task holds before it hands them on.
ROWS_AT_ONCE = 100_000


def _cells(low: Column, high: Column, cell: int) -> Column:
    """Cells that [low, high) touches; none of an empty one."""
    first, last = F.floor(low / cell).cast("long"), F.floor((high - 1) / cell).cast("long")
    return F.when(high > low, F.sequence(first, last))


def overlapping(a: DataFrame, b: DataFrame, key: str, cell: int = 512) -> DataFrame:
    """All pairs of an interval of a and one of b that share a place, of one key: key, a, b, low, high (what they share).

    a and b: key, id, low, high (whole numbers, high not included). Empty and null intervals overlap nothing.
    """
    put = lambda df, n: df.select(key, F.col("id").alias(n), F.col("low").alias(f"low_{n}"), F.col("high").alias(f"high_{n}"), F.explode(_cells(F.col("low"), F.col("high"), cell)).alias("cell"))
    low, high = F.greatest("low_a", "low_b"), F.least("high_a", "high_b")
    met = put(a, "a").join(put(b, "b"), [key, "cell"])
    return met.where((low < high) & (F.col("cell") == F.floor(low / cell))).select(key, "a", "b", low.alias("low"), high.alias("high"))


def overlapping_boxes(a: DataFrame, b: DataFrame, page: str = "page", cell: int = 128) -> DataFrame:
    """All pairs of a box of a and one of b on one page that share an area: page, a, b, x1, y1, x2, y2 (what they share).

    a and b: page, id, x1, y1, x2, y2 (whole numbers). Boxes without area and boxes with nulls overlap nothing.
    """

    def put(df: DataFrame, n: str) -> DataFrame:
        rows = df.select(page, F.col("id").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("x1", "y1", "x2", "y2")], F.explode(_cells(F.col("x1"), F.col("x2"), cell)).alias("across"))
        return rows.select("*", F.explode(_cells(F.col(f"y1_{n}"), F.col(f"y2_{n}"), cell)).alias("down"))

    x1, y1 = F.greatest("x1_a", "x1_b"), F.greatest("y1_a", "y1_b")
    x2, y2 = F.least("x2_a", "x2_b"), F.least("y2_a", "y2_b")
    met = put(a, "a").join(put(b, "b"), [page, "across", "down"])
    first = (F.col("across") == F.floor(x1 / cell)) & (F.col("down") == F.floor(y1 / cell))
    return met.where((x1 < x2) & (y1 < y2) & first).select(page, "a", "b", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def _starts(text: str, elements: list[str]) -> Iterator[tuple[int, int]]:
    """(number, start) of the elements that are found, one after the other."""
    at = 0
    for i, e in enumerate(elements):
        start = text.find(e, at) if e else -1
        if start >= 0:
            yield i, start
            at = start + 1


def _sorted_lists(elements: DataFrame, key: str) -> DataFrame:
    return elements.where("length(text) > 0").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("no", "id", "text"))).alias("elements"))


def in_ranges(lists: DataFrame, key: str) -> DataFrame:
    """(key, range, element) of all elements that share a character with a range of their text.

    lists: key, text, elements (array of no, id, text in order), ranges (array of id, low, high). Elements are looked for in
    their order, each from one character behind the place of the one before; empty ones and those not found from there
    are left out and move nothing. Ranges that are empty or have a null end hold nothing. Rows of a document stay in its
    task; documents are taken one by one, not a batch of them at once.
    """
    kind = lists.schema
    inner = lambda c: kind[c].dataType.elementType["id"].dataType.simpleString()

    def look(batches):
        for batch in batches:
            texts, lists, ranges = (batch.column(c) for c in ("text", "elements", "ranges"))
            element_ids, words = lists.values.field("id"), lists.values.field("text")
            range_ids, lows, highs = (ranges.values.field(c) for c in ("id", "low", "high"))
            found: list[tuple[np.ndarray, ...]] = []
            rows = 0

            def made():
                row, r, e = (pa.array(np.concatenate(c)) for c in zip(*found, strict=True))  # noqa: B023
                return pa.RecordBatch.from_arrays([batch.column(key).take(row), range_ids.take(r), element_ids.take(e)], names=[key, "range", "element"])  # noqa: B023

            for i in range(batch.num_rows):
                if not (texts[i].is_valid and lists[i].is_valid and ranges[i].is_valid):
                    continue
                first, last = lists.offsets[i].as_py(), lists.offsets[i + 1].as_py()
                mine = words.slice(first, last - first).to_pylist()
                places = np.array([*_starts(texts[i].as_py(), mine)], dtype="int64").reshape(-1, 2)
                starts, long = places[:, 1], np.array([len(mine[n]) for n in places[:, 0]], dtype="int64")
                longest = long.max(initial=0)
                for r in range(ranges.offsets[i].as_py(), ranges.offsets[i + 1].as_py()):
                    low, high = lows[r].as_py(), highs[r].as_py()
                    if low is None or high is None or low >= high:
                        continue
                    a, b = np.searchsorted(starts, [low - longest + 1, high])
                    hits = np.flatnonzero(starts[a:b] + long[a:b] > low) + a
                    if len(hits):
                        found.append((np.full(len(hits), i), np.full(len(hits), r), places[hits, 0] + first))
                        rows += len(hits)
                        if rows >= ROWS_AT_ONCE:
                            yield made()
                            found, rows = [], 0
            if found:
                yield made()

    few = lists.select(key, "text", "elements", "ranges")
    return few.mapInArrow(look, f"`{key}` {kind[key].dataType.simpleString()}, range {inner('ranges')}, element {inner('elements')}")


def elements_in_ranges(elements: DataFrame, texts: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """(key, range, element) by in_ranges, of elements (key, id, no, text), texts (key, text) and ranges (key, id, low, high).

    Elements and ranges belong to one text, so their lists are no larger than a document.
    """
    of = ranges.where("low < high").groupBy(key).agg(F.collect_list(F.struct("id", "low", "high")).alias("ranges"))
    return in_ranges(texts.where("text IS NOT NULL").select(key, "text").join(_sorted_lists(elements, key), key).join(of, key), key)


def enclosing_boxes(elements: DataFrame, by: list[str]) -> DataFrame:
    """Per group the box around all its boxes; boxes with a null edge do not count, groups without one are left out."""
    whole = elements.where(" AND ".join(f"{c} IS NOT NULL" for c in ("x1", "y1", "x2", "y2")))
    return whole.groupBy(*by).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("n"))


def linked_boxes(boxes: DataFrame, entities: DataFrame) -> DataFrame:
    """boxes with `entity`: the first entity (by place) whose label, or a variation of it, is the box's label without
    regard to case. entities: entity, place, label, variations. Boxes without a label or an entity are left out."""
    names = F.concat(F.array("label"), F.coalesce("variations", F.array().cast("array<string>")))
    known = entities.select("entity", "place", F.explode(names).alias("name")).where("name <> ''")
    first = known.groupBy(F.lower("name").alias("__name")).agg(F.min_by("entity", "place").alias("entity"))
    return boxes.withColumn("__name", F.lower("label")).join(first, "__name").drop("__name")
