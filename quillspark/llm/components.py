"""Connected components by alternating large-star and small-star steps, on edge tables.

Each step is a groupBy with a map-side minimum and one join; no node's neighbours are gathered, and
nothing but two sums per round goes to the driver. Each round is written, so a lost executor costs a
read. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the least node it knows."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node (u > v in each edge) sends its smaller neighbours and itself to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, component) for every node that has an edge and isn't its component's least node.

    edges: u, v of any orderable type; loops and repeated edges may occur.
    """
    now = workspace.staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        now = workspace.staged(_small_star(_large_star(now)), "stars")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select("u", F.col("v").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
