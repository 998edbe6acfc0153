"""Graphs on edge tables (src, dst): degrees, ranks, components, paths, cycles.

Iterations are driver loops of joins; every few rounds the state is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.scratch import saved


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    return out.join(into, "node", "full_outer").select("node", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def neighbors(edges: DataFrame, node) -> DataFrame:
    """Distinct nodes one step away, in both directions."""
    return edges.where(F.col("src") == node).select(F.col("dst").alias("node")).union(edges.where(F.col("dst") == node).select("src")).where(F.col("node") != node).distinct()


def connected(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Weakly connected components: (node, component = least node), by minima with pointer jumping."""
    both = saved(edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = saved(both.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    for _ in range(most_rounds):
        low = both.join(labels.withColumnsRenamed({"node": "dst"}), "dst").groupBy("src").agg(F.min("component").alias("low"))
        hooked = labels.join(low, labels["node"] == low["src"], "left").select("node", F.least("component", F.coalesce("low", "component")).alias("component"))
        # jump: take the label of the label
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("above"))
        after = saved(hooked.join(up, "component", "left").select("node", F.least("component", F.coalesce("above", "component")).alias("component")), "labels")
        changed = after.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").limit(1).count()
        labels = after
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def statistics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, average and largest degree."""
    d = degrees(edges)
    n, total = F.count(F.lit(1)), F.sum("out_degree")
    return d.agg(n.alias("nodes"), total.alias("edges"), F.round(F.when(n > 1, total / (n * (n - 1))).otherwise(0.0), 9).alias("density"), F.round(F.avg(F.col("in_degree") + F.col("out_degree")), 6).alias("average_degree"), F.max(F.col("in_degree") + F.col("out_degree")).alias("largest_degree"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank); the mass of nodes without links is dropped; repeated edges count by out-degree."""
    every = saved(nodes(edges), "nodes")
    n = every.count()
    out = saved(edges.join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("links")), "src").select("src", "dst", "links"), "links")
    ranks = every.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(rounds):
        given = out.join(ranks.withColumnRenamed("node", "src"), "src").groupBy("dst").agg(F.sum(F.col("rank") / F.col("links")).alias("given"))
        after = every.join(given, every["node"] == given["dst"], "left").select("node", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("given", F.lit(0.0))).alias("rank"))
        after = saved(after, "ranks")
        moved = after.join(ranks.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = after
        if (moved or 0) < tolerance:
            break
    return ranks


def hits(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, hub, authority), each summing to 1; hubs use the new authorities."""
    every = saved(nodes(edges), "nodes")
    n = max(every.count(), 1)
    now = every.withColumn("hub", F.lit(1.0 / n)).withColumn("authority", F.lit(1.0 / n))
    for _ in range(rounds):
        a = edges.join(now.select(F.col("node").alias("src"), "hub"), "src").groupBy("dst").agg(F.sum("hub").alias("a"))
        a = _to_one(every.join(a, every["node"] == a["dst"], "left").select("node", F.coalesce("a", F.lit(0.0)).alias("authority")), "authority")
        h = edges.join(a.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.sum("authority").alias("h"))
        h = _to_one(every.join(h, every["node"] == h["src"], "left").select("node", F.coalesce("h", F.lit(0.0)).alias("hub")), "hub")
        now = saved(h.join(a, "node"), "hits")
    return now


def _to_one(df: DataFrame, name: str) -> DataFrame:
    total = df.agg(F.sum(name).alias("__total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.when(F.col("__total") > 0, F.col(name) / F.col("__total")).otherwise(F.col(name))).drop("__total")


def role(hub, authority, in_degree, out_degree, hub_least: float = 0.7, authority_least: float = 0.7):
    return F.when(hub >= hub_least, "HUB").when(authority >= authority_least, "AUTHORITY").when((in_degree > 0) | (out_degree > 0), "CONNECTOR").otherwise("ISOLATED")


def paths(edges: DataFrame, source, target, most_hops: int = 3) -> DataFrame:
    """All simple directed paths from source to target of up to most_hops edges: path (array), hops."""
    step = edges.where("src <> dst").select("src", "dst").distinct()
    front = step.where(F.col("src") == source).select(F.array("src", "dst").alias("path"), F.col("dst").alias("last"))
    found = front.where(F.col("last") == target)
    for _ in range(most_hops - 1):
        front = front.where(F.col("last") != target).join(step, F.col("last") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("last"))
        found = found.unionByName(front.where(F.col("last") == target))
    return found.select("path", (F.size("path") - 1).alias("hops"))


def cycles(edges: DataFrame, most: int = 4) -> DataFrame:
    """Cycles of up to `most` edges, each once: its rotation that begins with the least node."""
    step = edges.where("src <> dst").select("src", "dst").distinct()
    front = step.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("src").alias("first"), F.col("dst").alias("last"))
    found = None
    for _ in range(most - 1):
        closed = front.join(step, (F.col("last") == F.col("src")) & (F.col("first") == F.col("dst")), "left_semi").select("path")
        found = closed if found is None else found.unionByName(closed)
        front = front.join(step, F.col("last") == F.col("src")).where((F.col("dst") > F.col("first")) & ~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path"), "first", F.col("dst").alias("last"))
    return found


def ego(edges: DataFrame, node, depth: int = 2) -> DataFrame:
    """Edges among the nodes at most `depth` undirected steps from node."""
    near = edges.sparkSession.createDataFrame([(node,)], "node long")
    for _ in range(depth):
        out = edges.join(near, edges["src"] == near["node"], "left_semi").select(F.col("dst").alias("node"))
        into = edges.join(near, edges["dst"] == near["node"], "left_semi").select(F.col("src").alias("node"))
        near = near.union(out).union(into).distinct()
    return edges.join(near, edges["src"] == near["node"], "left_semi").join(near, edges["dst"] == near["node"], "left_semi")
