"""Near-duplicate vectors by cross-polytope hashing.

Equal vectors of a label are first folded to one with a count. A hash is the nearest vertex of the
cross-polytope after three rounds of random signs and a fast Hadamard transform; a table's code joins
two hashes. With multiprobe, each vector enters the likeliest few codes of each table. A bucket (label,
table, code) of any size is cut into blocks of bounded size, and every two blocks meet in a task of
their own, where cosines are verified by matrix products. A pair that shares several buckets counts in
the first only. Tasks return numbers of links for each vector and edges of a spanning forest, never
all pairs.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components, hot_keys, workspace

BLOCK = 2048


class CrossPolytope:
    """codes(x)[i, t, p]: probe p of table t for vector i."""

    def __init__(self, dim: int, tables: int, probes: int, hashes: int = 2, seed: int = 7):
        self.dim, self.tables, self.probes, self.hashes = dim, tables, probes, hashes
        self.width = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, hashes, 3, self.width)).astype(np.float32)

    @staticmethod
    def _hadamard(x: np.ndarray) -> np.ndarray:
        n, width = x.shape
        step = 1
        while step < width:
            x = x.reshape(n, width // (2 * step), 2, step)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
            step *= 2
        return x / np.float32(np.sqrt(width))

    def codes(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        base = np.zeros((n, self.width), np.float32)
        base[:, : self.dim] = x
        out = np.empty((n, self.tables, self.probes), np.int32)
        near = min(4, 2 * self.width)
        for t in range(self.tables):
            vertices, losses = [], []
            for h in range(self.hashes):
                y = base
                for r in range(3):
                    y = self._hadamard(y * self.signs[t, h, r])
                both = np.concatenate([y, -y], axis=1)
                top = np.argsort(-both, axis=1, kind="stable")[:, :near]
                value = np.take_along_axis(both, top, axis=1)
                vertices.append(top)
                losses.append(value[:, :1] - value)
            code, loss = vertices[0].astype(np.int64), losses[0]
            for h in range(1, self.hashes):
                code = (code[:, :, None] * (2 * self.width) + vertices[h][:, None, :]).reshape(n, -1)
                loss = (loss[:, :, None] + losses[h][:, None, :]).reshape(n, -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, : self.probes]
            out[:, t] = np.take_along_axis(code, best, axis=1)
        return out


def _valid(vector: Column, label: Column) -> Column:
    """Vectors that can have links: no null or non-finite components, not zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & label.isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False)) & F.exists(vector, lambda x: x != 0)


CODED = "group long, rep long, many long, data binary, key string, codes binary, buckets array<long>"


def _coded(reps: DataFrame, tables: int, probes: int, hashes: int, seed: int) -> DataFrame:
    """reps with their codes and the buckets (table and code) that each enters."""

    def run(batches):
        made: dict[int, CrossPolytope] = {}
        for batch in batches:
            data = batch.column(3).to_pylist()
            size = np.fromiter(map(len, data), np.int64, len(data))
            for width in np.unique(size).tolist():
                at = np.flatnonzero(size == width)
                x = np.frombuffer(b"".join(data[i] for i in at.tolist()), "<f8").reshape(len(at), -1)
                x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps the squares finite
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                if width not in made:
                    made[width] = CrossPolytope(x.shape[1], tables, probes, hashes, seed)
                codes = made[width].codes(x)
                n, t, p = codes.shape
                buckets = np.repeat(np.arange(t, dtype=np.int64), p) << 32 | codes.reshape(n, -1)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.astype("<i4").tobytes() for c in codes], pa.binary()), pa.array(list(buckets), pa.list_(pa.int64()))], names=["group", "rep", "many", "data", "key", "codes", "buckets"])

    return reps.select("group", "rep", "many", "data", "key").mapInArrow(run, CODED)


def _block_links(batches, threshold: float, tables: int, probes: int):
    """Links within sorted runs of (group, bucket, bi, bj); a run is held whole, of at most two blocks."""

    def links(run: pa.Table):
        bucket, bi, bj = (run.column(c)[0].as_py() for c in ("bucket", "bi", "bj"))
        rep, many, block = (run.column(c).to_numpy() for c in ("rep", "many", "block"))
        x = np.frombuffer(b"".join(run.column("data").to_pylist()), "<f8").reshape(len(rep), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        close = x[left] @ x[right].T >= threshold
        if bi == bj:
            close &= np.tri(len(left), k=-1, dtype=bool)
        a, b = np.nonzero(close)
        if not len(a):
            return None
        a, b = left[a], right[b]
        codes = np.frombuffer(b"".join(run.column("codes").to_pylist()), "<i4").reshape(-1, tables, probes)
        first = np.ones(len(a), bool)
        table, code = bucket >> 32, bucket & 0xFFFFFFFF
        for t in range(table + 1):
            for p in range(probes):
                for q in range(probes):
                    same = codes[a, t, p] == codes[b, t, q]
                    first &= ~(same & (codes[a, t, p] < code) if t == table else same)
        a, b = a[first], b[first]
        if not len(a):
            return None
        count = np.bincount(a, many[b], len(rep)) + np.bincount(b, many[a], len(rep))
        # spanning forest of the run: every vector to the least one reached
        low = np.arange(len(rep))
        while True:
            m = low.copy()
            np.minimum.at(m, a, low[b])
            np.minimum.at(m, b, low[a])
            m = m[m]
            if (m == low).all():
                break
            low = m
        seen = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(rep[seen]), pa.array(rep[low[seen]]), pa.array(count[seen].astype(np.int64))], names=["u", "v", "n"])

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        keys = np.stack([table.column(c).to_numpy() for c in ("group", "bucket", "bi", "bj")])
        cuts = [0, *(np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if (found := links(table.slice(a, b - a))) is not None:
                yield found
        held = table.slice(cuts[-1]).combine_chunks()
    if held is not None and held.num_rows and (found := links(held)) is not None:
        yield found


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tables: int = 8, probes: int = 4, hashes: int = 2, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Links: equal non-null labels, equal dimension, cosine in double precision >= threshold. Null, zero
    and non-finite vectors, and null labels, have no links and are components of their own. Rows that
    repeat a vec_id are rows of their own, each with its vector's links; they share a component if they link.

    Eight tables: at cosine 0.93 in 64 dimensions one table joins about 0.85 of the pairs, so all but 3e-7 meet.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    rows = rows.withColumn("good", _valid(F.col("vector"), F.col("label")) & F.col("vec_id").isNotNull())
    good = rows.where("good").select("vec_id", F.xxhash64(F.col("label").cast("string"), F.size("vector")).alias("group"), "vector")
    # equal vectors fold to the least id; the digest stands for the vector in shuffles
    keyed = workspace.staged(good.select("vec_id", "group", "vector", F.sha2(F.concat(F.col("group").cast("string"), F.lit(":"), F.array_join(F.col("vector").cast("array<string>"), ",")), 256).alias("key")), "vectors")
    folded = keyed.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"))
    pack = F.pandas_udf(_pack, "binary")
    one = keyed.join(folded.withColumnRenamed("rep", "vec_id"), ["key", "vec_id"]).dropDuplicates(["key"])
    reps = one.select("group", F.col("vec_id").alias("rep"), "many", pack("vector").alias("data"), "key")
    # every class has a number of its own, fixed by writing it: an id may carry several vectors
    reps = workspace.staged(_coded(reps, tables, probes, hashes, seed).withColumn("node", F.monotonically_increasing_id()), "vector-reps")
    buckets = reps.select("group", "node", F.explode("buckets").alias("bucket"))
    sizes = buckets.groupBy("group", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    member = hot_keys.attached(buckets, sizes, ["group", "bucket"], F.col("node")).select("group", "bucket", "node", blocks.alias("blocks"))
    member = member.withColumn("block", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("blocks")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = member.select("group", "bucket", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node")
    full = meets.join(reps.select("node", F.col("node").alias("rep"), "many", "data", "codes"), "node")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = full.repartition(n, "group", "bucket", "bi", "bj").sortWithinPartitions("group", "bucket", "bi", "bj")
    found = ordered.mapInArrow(lambda batches: _block_links(batches, threshold, tables, probes), "u long, v long, n long")
    found = workspace.staged(found, "vector-links")
    linked = found.groupBy("u").agg(F.sum("n").alias("n"))
    comp = components.components(found.select("u", "v"))
    placed = (
        reps.select("key", "rep", "many", "node")
        .join(linked, reps["node"] == linked["u"], "left")
        .drop("u")
        .join(comp, F.col("node") == comp["u"], "left")
        .select("key", "rep", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    # the component's name: the least vec_id of its classes
    named = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    answers = workspace.staged(hot_keys.attached(placed, named, "component", F.col("key")).select("key", "n_links", "component_id"), "vector-answers")
    out = hot_keys.attached(keyed.select("vec_id", "key"), answers, "key", F.col("vec_id")).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _pack(vectors):
    return vectors.map(lambda v: np.asarray(v, "<f8").tobytes())
