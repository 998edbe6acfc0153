"""Reading order and tables of scanned pages, from the boxes of their elements.

A page is one group: as large as what can be printed on it, never as large as the table of pages.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The least gap between columns; how far edges of one row or column may lie apart; the least table.
COLUMN_GAP, ALIGNMENT, LEAST_CELLS = 50, 15, 4
#: Larger boxes are paragraphs, not cells.
WIDEST_CELL, HIGHEST_CELL = 500, 100
ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
LAYOUTS = {0: "single_column", 1: "single_column", 2: "two_column", 3: "three_column"}


def columns_of(spans: list[tuple[int, int]], width: int, gap: int = COLUMN_GAP) -> list[tuple[int, int]]:
    """Columns (from, to) of a page with boxes over these spans: a sweep that opens a column behind each gap. A narrow
    left margin belongs to the first column; the last column goes on to the right edge."""
    found: list[list[int]] = []
    for a, b in sorted(spans):
        if found and a <= found[-1][1] + gap:
            found[-1][1] = max(found[-1][1], b)
        else:
            found.append([a, b])
    if not found:
        return [(0, width)]
    if found[0][0] <= gap:
        found[0][0] = 0
    columns = [(a, b) for a, b in found[:-1] if b > a]
    return [*columns, (found[-1][0], width)] if found[-1][0] < width else columns


def page_order(boxes: list[tuple[int, int, int, int]], width: int, gap: int = COLUMN_GAP) -> tuple[list[tuple[int, int]], int]:
    """(no, column) of boxes (no, x1, y1, x2) in reading order, and the number of columns."""
    columns = columns_of([(x1, x2) for _, x1, _, x2 in boxes], width, gap)
    places = []
    for no, x1, y1, x2 in boxes:
        middle = (x1 + x2) // 2
        at = next((k for k, (a, b) in enumerate(columns) if a <= middle <= b), None)
        if at is None and columns:
            at = min(range(len(columns)), key=lambda k: abs((columns[k][0] + columns[k][1]) // 2 - middle))
        if at is not None:
            places.append((at, y1, no))
    return [(no, k) for k, _, no in sorted(places)], len(columns)


def _by_page(elements: DataFrame, keys: list[str], fields: list[str], make: Callable[[list[tuple]], list[tuple]], columns: str) -> DataFrame:
    """Rows (keys and columns) that `make` gives for the elements of each page, in the order of their fields.

    Pages come together as arrays, many in a batch: most are small, and none is a batch of its own.
    """
    kinds = dict(elements.dtypes)
    pages = elements.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("elements"))
    names = [*keys, *(c.split()[0] for c in columns.split(", "))]
    kind = [ARROW.get(c.split()[1]) for c in columns.split(", ")]

    def run(batches):
        for batch in batches:
            lists = batch.column("elements")
            cuts = lists.offsets.to_pylist()
            every = [*zip(*(lists.values.field(f).slice(cuts[0], cuts[-1] - cuts[0]).to_pylist() for f in fields), strict=True)]
            rows, page = [], []
            for i in range(batch.num_rows):
                made = make(every[cuts[i] - cuts[0] : cuts[i + 1] - cuts[0]])
                rows += made
                page += [i] * len(made)
            out = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kind), kind, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(page, pa.int64())) for k in keys), *out], names=names)

    return pages.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + columns)


def reading_order(elements: DataFrame, keys: list[str], gap: int = COLUMN_GAP) -> DataFrame:
    """Per page (keys) its elements in reading order: keys, no, place, column, layout.

    elements: keys, no, width (of the page), x1, y1, x2, y2. Columns go from left to right, each from top to bottom; ties
    by no. Elements with a null edge are left out.
    """

    def order(page: list[tuple]) -> list[tuple]:
        found, many = page_order([e[:4] for e in page], page[0][4], gap)
        return [(no, place, column, LAYOUTS.get(many, "multi_column")) for place, (no, column) in enumerate(found)]

    whole = elements.dropna(subset=["x1", "y1", "x2", "y2", "width"])
    return _by_page(whole, keys, ["no", "x1", "y1", "x2", "width"], order, f"no {dict(elements.dtypes)['no']}, place int, column int, layout string")


def grid_of(cells: list[tuple[int, int, int, int, int, str]], alignment: int = ALIGNMENT) -> tuple[list[list[str]], bool]:
    """Texts by row and column of boxes (no, x1, y1, x2, y2, text), and whether the first row is a header.

    Islands of upper edges make rows, each measured from its first box; left edges make columns, each measured from the
    first box that opened it. A place takes the leftmost box of its row near its column. Nothing comes back of what
    has fewer than two rows or columns.
    """
    cells = [c for c in cells if not (c[3] - c[1] > WIDEST_CELL and c[4] - c[2] > HIGHEST_CELL)]
    if len(cells) < LEAST_CELLS:
        return [], False
    rows: list[list] = []
    for c in sorted(cells, key=lambda c: (c[2], c[0])):
        if rows and abs(c[2] - rows[-1][0][2]) <= alignment:
            rows[-1].append(c)
        else:
            rows.append([c])
    lefts: list[int] = []
    for c in sorted(cells):
        if all(abs(c[1] - x) > alignment for x in lefts):
            lefts.append(c[1])
    lefts.sort()
    if len(rows) < 2 or len(lefts) < 2:
        return [], False
    grid = []
    for row in rows:
        row.sort(key=lambda c: c[1])
        grid.append([next((c[5] or "" for c in row if abs(c[1] - x) <= alignment), "") for x in lefts])
    height = [max(c[4] for c in row) - min(c[2] for c in row) for row in rows[:2]]
    empty = [sum(not t.strip() for t in line) for line in grid[:2]]
    return grid, (not empty[0] and empty[1] > 0) or height[0] < height[1] * 0.9


def grid_tables(elements: DataFrame, keys: list[str], alignment: int = ALIGNMENT) -> DataFrame:
    """Per page that has one its table: keys, row, col, text, is_header. elements: keys, no, x1, y1, x2, y2, text."""

    def build(page: list[tuple]) -> list[tuple]:
        grid, is_head = grid_of(page, alignment)
        return [(y, x, text, is_head and y == 0) for y, line in enumerate(grid) for x, text in enumerate(line)]

    whole = elements.dropna(subset=["x1", "y1", "x2", "y2"])
    return _by_page(whole, keys, ["no", "x1", "y1", "x2", "y2", "text"], build, "row int, col int, text string, is_header boolean")
