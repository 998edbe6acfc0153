"""Near-duplicate documents: MinHash banding, sequential Bayesian pruning, exact verification.

1. One pass makes a document's set of word shingles (as 64-bit hashes), its size, a digest of the set,
   band keys and a sketch of one byte for each minhash. Documents with equal sets fold to one class.
2. Star round: in each band bucket, every class is a candidate with the bucket's least class.
3. Candidates compare their sketches batch by batch; a pair is dropped when the posterior probability
   that its similarity reaches the threshold falls below the chosen miss probability.
4. Survivors are verified on their full sets, made again from their whole texts; verified links give components.
5. Completing round: in buckets that still hold several components, classes of different components
   compare sketches block against block within tasks, so a large bucket spreads over many tasks; survivors
   are verified there, a pair in the first bucket that it shares only, and nothing but links leaves the
   task. Every candidate pair is then either linked, connected by verified links, or tested: no link that
   banding finds is lost.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, hot_keys, worker_cache, workspace

HASHES, BATCH, BLOCK = 320, 32, 512
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_word_hashes = _WordHashes()


def enter() -> None:
    """Called in a task that makes shingles: other operators' tables go, and the word hashes go when another enters."""
    worker_cache.enter("minhash")
    worker_cache.hold("minhash", _word_hashes.clear)


def shingles(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles. Words: runs of bytes other than space and
    \\x09 to \\x0D, A-Z lower-cased. Fewer words than `size`: the whole sequence as one; none: empty."""
    words = text.lower().split()
    h = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    if not n:
        return h
    with np.errstate(over="ignore"):
        s = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            s = (s ^ (s >> np.uint64(31))) * MIX[1] + h[k : len(h) - n + 1 + k] * MIX[k % len(MIX)]
        s ^= s >> np.uint64(29)
        s *= MIX[1]
        s ^= s >> np.uint64(32)
    return np.unique(s)


@lru_cache
def _permutations(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def minhashes(hashes: np.ndarray) -> np.ndarray:
    a, b = _permutations()
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 256):
            np.minimum(best, (x[i : i + 256, None] * a + b).min(axis=0), out=best)
    return best


def bands_for(percent: int, miss: float = 1e-5) -> tuple[int, int]:
    """(rows, bands): the longest bands for which a pair at the threshold is missed at most so often."""
    for rows in range(16, 0, -1):
        if (1 - (percent / 100) ** rows) ** (HASHES // rows) <= miss:
            return rows, HASHES // rows
    raise ValueError("the threshold is too low for banding")


@lru_cache
def least_matches(percent: int, miss: float = 1e-6) -> np.ndarray:
    """After 32, 64, ... hashes: the least number of equal sketch bytes at which P(similarity >= threshold | matches)
    is still above `miss`, for a uniform prior and sketches of one byte."""
    s = (np.arange(20_000) + 0.5) / 20_000
    log_q, log_p = np.log(s + (1 - s) / 256), np.log((1 - s) * 255 / 256)
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        low = n
        for m in range(n, -1, -1):
            density = m * log_q + (n - m) * log_p
            density = np.exp(density - density.max())
            if density[s >= percent / 100].sum() / density.sum() < miss:
                break
            low = m
        out.append(low)
    return np.array(out)


def bayes_survivors(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Places k of the pairs (left[a[k]], right[b[k]]) that survive all batches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for i, least in enumerate(least_matches(percent)):
        cut = slice(i * BATCH, (i + 1) * BATCH)
        matches[alive] += (left[a[alive], cut] == right[b[alive], cut]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
        if not len(alive):
            break
    return alive


SIGNED = "doc_id long, raw long, n_shingles long, digest binary, bands array<long>, sketch binary"


def signed(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    rows, bands = bands_for(percent)
    arrow = pa.schema([("doc_id", pa.int64()), ("raw", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches):
        import xxhash

        enter()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = {name: [] for name in arrow.names}
                for doc, raw, text in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                    found = shingles(text, size)
                    out["doc_id"].append(doc)
                    out["raw"].append(raw)
                    out["n_shingles"].append(len(found))
                    if not len(found):
                        for name in ("digest", "bands", "sketch"):
                            out[name].append(None)
                        continue
                    low = minhashes(found)
                    out["digest"].append(xxhash.xxh128_digest(found.tobytes()))
                    out["bands"].append([xxhash.xxh3_64_intdigest(low[k * rows : (k + 1) * rows].tobytes(), seed=k) - (1 << 63) for k in range(bands)])
                    out["sketch"].append((low >> np.uint32(3)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_pydict(out, arrow)

    return _source(docs, id_col, text_col).mapInArrow(run, SIGNED)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, raw (a hash that tells the texts of a repeated id apart) and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("raw"), text.cast("binary").alias("text"))


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _star_survivors(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose sizes and sketches allow a link."""
    right = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    left = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    near = hot_keys.attached(pairs.join(right, "b"), left, "a", F.col("b")).where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches):
        for batch in batches:
            at = np.arange(batch.num_rows)
            keep = bayes_survivors(_sketches(batch.column(2)), _sketches(batch.column(3)), at, at, percent)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], names=["a", "b"])

    return near.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _reach(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _cross_links(batches, percent: int):
    """Links between different components within sorted runs of (bucket, bi, bj), of at most two blocks each."""

    def meet(run: pa.Table):
        bucket, bi, bj = (run.column(c)[0].as_py() for c in ("bucket", "bi", "bj"))
        rep, comp, n, block = (run.column(c).to_numpy() for c in ("rep", "comp", "n", "block"))
        left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        a, b = np.nonzero((comp[left][:, None] != comp[right]) & (100 * np.minimum(n[left][:, None], n[right]) >= percent * np.maximum(n[left][:, None], n[right])) & ((bi != bj) | (rep[left][:, None] < rep[right])))
        if not len(a):
            return None
        a, b = left[a], right[b]
        sketch = _sketches(run.column("sketch"))
        keep = bayes_survivors(sketch, sketch, a, b, percent)
        a, b = a[keep], b[keep]
        if not len(a):
            return None
        bands = np.frombuffer(b"".join(run.column("keys").to_pylist()), "<i8").reshape(len(rep), -1)
        earlier = int(np.flatnonzero(bands[0] == bucket)[0])
        first = ~(bands[a, :earlier] == bands[b, :earlier]).any(axis=1)
        sets, links = run.column("hashes"), []
        known: dict[int, np.ndarray] = {}
        for i, j in zip(a[first].tolist(), b[first].tolist(), strict=True):
            for k in (i, j):
                if k not in known:
                    known[k] = np.frombuffer(sets[k].as_py(), np.uint64)
            if _reach(known[i], known[j], percent):
                links.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], names=["u", "v"]) if links else None

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        keys = np.stack([table.column(c).to_numpy() for c in ("bucket", "bi", "bj")])
        cuts = [0, *(np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1).tolist()]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if (found := meet(table.slice(x, y - x))) is not None:
                yield found
        held = table.slice(cuts[-1]).combine_chunks()
    if held is not None and held.num_rows and (found := meet(held)) is not None:
        yield found


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """rep and its full set: the sorted 64-bit hashes of its shingles."""

    def run(batches):
        enter()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py(), size).tobytes() for t in part.column(1)], pa.binary())], names=["rep", "hashes"])

    return texts.mapInArrow(run, "rep long, hashes binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches):
        for batch in batches:
            good = pa.array([_reach(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["u", "v"])

    right = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb"))
    left = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("ha"))
    return hot_keys.attached(pairs.join(right, "b"), left, "a", F.col("b"), salts=8).select("a", "b", "ha", "hb").mapInArrow(run, "u long, v long")


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least doc_id reachable), kept.

    Links: 100 * intersection >= percent * union of the shingle sets. Null and blank texts have empty
    sets and link with nothing. Rows that repeat a doc_id are rows of their own, each with its text's
    links; equal sets are one class with a number of its own, whatever ids its rows have. A row
    with a null doc_id links with nothing, its component is null and it is kept.
    """
    return _grouped(docs, size, percent, id_col, text_col).drop("raw")


def _grouped(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """near_groups with raw, the hash that tells the texts of a repeated id apart."""
    spark = docs.sparkSession
    rows = workspace.staged(signed(docs, size, percent, id_col, text_col), "signatures")
    full = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = full.groupBy("digest").agg(F.min(F.struct("doc_id", "raw")).alias("least"))
    classes = workspace.staged(classes.select("digest", F.col("least.doc_id").alias("doc_id"), F.col("least.raw").alias("raw")), "classes")
    reps = full.join(classes, ["digest", "doc_id", "raw"]).dropDuplicates(["digest"])
    # the number is fixed by writing it
    reps = workspace.staged(reps.select(F.monotonically_increasing_id().alias("rep"), "digest", "doc_id", "raw", F.col("n_shingles").alias("n"), "sketch", "bands"), "class-sketches")
    keys = reps.select("rep", F.explode("bands").alias("bucket"))
    leaders = keys.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("many")).where("many > 1")
    buckets = workspace.staged(hot_keys.attached(keys, leaders, "bucket", F.col("rep")).select("bucket", "rep", "leader", "many"), "buckets")
    star = buckets.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    star = workspace.staged(_star_survivors(star, reps, percent), "star-pairs")
    needed = buckets.select("rep").distinct().join(reps.select("rep", "doc_id", "raw"), "rep")
    source = _source(docs, id_col, text_col).join(needed, ["doc_id", "raw"]).dropDuplicates(["doc_id", "raw"])
    sets = workspace.staged(_sets(source.select("rep", "text"), size), "full-sets")
    links = workspace.staged(_verified(star, sets, percent), "star-links")
    comps = workspace.staged(components.components(links), "star-components")

    placed = buckets.join(comps, buckets["rep"] == comps["u"], "left").select("bucket", "rep", "many", F.coalesce("component", "rep").alias("comp"))
    open_buckets = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket")
    member = hot_keys.attached(placed, open_buckets, "bucket", F.col("rep")).withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("int"))
    member = member.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = member.select("bucket", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "rep", "comp")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pack = F.pandas_udf(_pack, "binary")
    full = meets.join(reps.select("rep", "n", "sketch", pack("bands").alias("keys")), "rep").join(sets, "rep")
    ordered = full.repartition(n, "bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    more = workspace.staged(ordered.mapInArrow(lambda batches: _cross_links(batches, percent), "u long, v long").distinct(), "cross-links")
    final = components.components(links.unionAll(more))

    # the component's name: the least doc_id of its classes
    part = reps.select("rep", "digest", "doc_id").join(final, F.col("rep") == final["u"], "left").select("digest", "doc_id", F.coalesce("component", "rep").alias("component"))
    named = part.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    per_class = workspace.staged(hot_keys.attached(part.select("digest", "component"), named, "component", F.col("digest")).select("digest", "component_id"), "class-components")
    linked = hot_keys.attached(rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "raw", "n_shingles", "digest"), per_class, "digest", F.col("doc_id"))
    alone = rows.where("digest IS NULL OR doc_id IS NULL").select("doc_id", "raw", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked.select("doc_id", "raw", "n_shingles", "component_id").unionAll(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the rows of the least doc_id of each group; columns unchanged. Rows that link with nothing stay;
    of an id with several texts, only the texts that are copies of a smaller id's go."""
    gone = _grouped(docs, size, percent, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("__gone"), "raw").distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.join(gone, (F.col(id_col).cast("long") == F.col("__gone")) & (F.xxhash64(text) == gone["raw"]), "left_anti")


def _pack(bands):
    return bands.map(lambda x: np.asarray(x, "<i8").tobytes())
