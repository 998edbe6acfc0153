"""Documents in shards along a Hilbert curve through their metadata, so that files can be skipped by any dimension.

1. Each dimension is quantised to 2^bits levels that hold equal shares of the rows (counted over all rows). Only the
   first value of each level leaves the executors: dimensions x 2^bits values at most, whatever the input.
2. A row's levels are a cell of a grid; its place on the Hilbert curve through the grid is worked out with numpy.
   Neighbours on the curve are neighbours in every dimension, so a run of the curve covers few values of each.
3. Rows are sorted by place, by one range shuffle of narrow rows, and the order is cut into runs: by the law `rows` into
   runs whose counts differ by one at most, by `bytes` into runs of nearly equal size.

A row's number in the order is its number in its partition plus the rows of the partitions before: one number for
each partition goes through the driver.

Equal texts can be kept together: all rows of a group then take the metadata of its first row, so they lie side by
side on the curve, and only the cut that the law asks for can part them. Groups meet their first row by a salted join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hot_keys, workspace

LAWS = ("rows", "bytes")
#: What every stored document costs beside its text.
OVERHEAD = 8


def curve_index(levels: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells: levels is [rows, dimensions], each in 0 .. 2^bits - 1.

    The transposed form of the index by exclusive ors and exchanges of low bits (Skilling 2004), on whole columns.
    """
    x = levels.astype(np.int64).T.copy()
    dims = len(x)
    if dims * bits > 62:
        raise ValueError("a place must fit 62 bits")
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[-1] & q, q - 1, 0)
    x ^= turn
    out = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b & 1)
    return out


def _numbered(rows: DataFrame, order: list[str], weight: str) -> DataFrame:
    """rows, written in the given order, with `before`: the sum of weight over all rows before a row, and `at`: their number."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def count(batches):
        part, at, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            size = batch.column(batch.schema.get_field_index(weight)).to_numpy()
            ends = np.cumsum(size)
            out = batch.append_column("part", pa.array(np.full(len(size), part, np.int32)))
            out = out.append_column("at", pa.array(np.arange(at, at + len(size)))).append_column("before", pa.array(before + ends - size))
            yield out
            at, before = at + len(size), before + int(ends[-1]) if len(ends) else before

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    sorted_rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    written = workspace.staged(sorted_rows.mapInArrow(count, f"{fields}, part int, at long, before long"), "shard-order")
    starts, rows_before, weight_before = [], 0, 0
    for part, many, total in sorted(written.groupBy("part").agg(F.count(F.lit(1)), F.sum(weight)).collect()):
        starts.append((part, rows_before, weight_before))
        rows_before, weight_before = rows_before + many, weight_before + total
    # as many rows as the order has partitions
    shift = F.broadcast(spark.createDataFrame(starts, "part int, rows_before long, weight_before long"))
    return written.join(shift, "part").select(*rows.columns, (F.col("at") + F.col("rows_before")).alias("at"), (F.col("before") + F.col("weight_before")).alias("before"))


def _sortable(df: DataFrame, name: str) -> Column:
    """A dimension as (number, string), one of them null: both sort as the value does, nulls first."""
    kind = dict(df.dtypes)[name]
    if kind == "string":
        return F.struct(F.lit(None).cast("double").alias("number"), F.col(name).alias("word"))
    if kind.startswith(("array", "map", "struct", "binary")):
        raise TypeError(f"{name} is no dimension: {kind}")
    number = F.col(name).cast("double")
    return F.struct(F.when(F.isnan(number), F.lit(None)).otherwise(number).alias("number"), F.lit(None).cast("string").alias("word"))


def level_starts(rows: DataFrame, dims: list[str], bits: int) -> list[tuple[list[int], list]]:
    """For each dimension the levels that occur and the first value of each, of levels that hold equal shares of the rows.

    Equal values share a level: that of the first of their rows. Nulls sort before all values.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), _sortable(rows, name).alias("value")) for i, name in enumerate(dims)]))
    values = rows.select(each.alias("d")).groupBy("d.dim", "d.value").agg(F.count(F.lit(1)).alias("many"))
    numbered = _numbered(values.select("dim", "value.number", "value.word", "many"), ["dim", "number", "word"], "many")
    total = rows.count()
    level = F.expr(f"(before - dim * {total}L) * {1 << bits}L div {max(total, 1)}L").cast("int")
    first = numbered.withColumn("level", level).groupBy("dim", "level").agg(F.min(F.struct("number", "word")).alias("value"))
    found: list[tuple[list[int], list]] = [([], []) for _ in dims]
    for dim, at, (number, word) in sorted(first.collect(), key=lambda r: r[:2]):
        found[dim][0].append(at)
        found[dim][1].append(word if number is None else number)
    return found


def placed_on_curve(rows: DataFrame, dims: list[str], bits: int, levels: list[tuple[list[int], list]] | None = None) -> DataFrame:
    """rows with `place`, where their dims lie on the curve through the given levels (those of rows itself if not given)."""
    starts = rows.sparkSession.sparkContext.broadcast(levels or level_starts(rows, dims, bits))
    keyed = rows.select("*", *[_sortable(rows, name).alias(f"__{i}") for i, name in enumerate(dims)])
    kept = rows.columns

    def level(column: pa.StructArray, known: tuple[list[int], list]) -> np.ndarray:
        at, values = known
        nulls = sum(v is None for v in values)  # 0 or 1: the level that nulls begin
        number, word = column.field("number"), column.field("word")
        if any(isinstance(v, str) for v in values):
            first = np.array([v.encode() for v in values[nulls:]], object)
            given = np.array(word.cast(pa.binary()).to_pylist(), object)
        else:
            first, given = np.array(values[nulls:], float), np.array(number.to_pylist(), object)
        out = np.zeros(len(given), np.int64)
        there = np.array([v is not None for v in given], bool)
        if there.any() and len(first):
            out[there] = np.searchsorted(first, given[there].astype(first.dtype), side="right") - 1 + nulls
        return np.array(at, np.int64)[np.maximum(out, 0)] if at else out

    def locate(batches):
        for batch in batches:
            cells = [level(batch.column(batch.schema.get_field_index(f"__{i}")), known) for i, known in enumerate(starts.value)]
            out = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept], names=kept)
            yield out.append_column("place", pa.array(curve_index(np.stack(cells, axis=1), bits)))

    return keyed.mapInArrow(locate, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", place long")


def _keys(docs: DataFrame, dims: list[str], id_col: str, text_col: str, carry: Column | None = None) -> DataFrame:
    """id, size, crc, hash of the text, row (position in the input), the dimensions and what goes with them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = {"size": (F.octet_length(text) + OVERHEAD).cast("long")}
    fields = [F.col(id_col).cast("long").alias("id"), made["size"].alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row")]
    return docs.select(*fields, *[(made.get(d) if d in made else F.col(d)).alias(f"dim{i}") for i, d in enumerate(dims)], *([carry.alias("carry")] if carry is not None else []))


def _cut(numbered: DataFrame, shards: int, law: str) -> DataFrame:
    """numbered rows with `shard` and `slot`."""
    total = numbered.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    if law == "rows":
        out = numbered.withColumn("shard", F.expr(f"at * {shards}L div {max(total['rows'], 1)}L").cast("int"))
        return out.withColumn("slot", F.col("at") - F.expr(f"(shard * {total['rows']}L + {shards - 1}L) div {shards}L"))
    middle = f"(CAST(2 * before + size AS decimal(20,0)) * {shards}) div (2L * {max(total['bytes'], 1)}L)"
    out = numbered.withColumn("shard", F.expr(middle).cast("int"))
    begins = F.broadcast(out.groupBy("shard").agg(F.min("at").alias("begin")))  # a row for each shard
    return out.join(begins, "shard").withColumn("slot", F.col("at") - F.col("begin"))


def assign(docs: DataFrame, shards: int = 24, law: str = "rows", dims: tuple[str, ...] = ("lang", "source", "size"), bits: int = 8, together: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size (UTF-8 bytes of the text and 8), text_crc32, law, shard, slot (from 0 in a
    shard, along the curve), grown_shard (null: only a law by key could tell).

    dims: columns of docs, strings or numbers, or `size`. law `rows`: shard s takes the rows from ceil(s * N / shards)
    on; `bytes`: a row goes to the shard in which the middle of its bytes falls, so a shard is off its share by no more
    than the largest document. together: equal texts lie side by side.

    Null text counts as empty; null dimensions sort first; rows that repeat an id and a text follow each other in input
    order. With fewer rows than shards some shards stay empty. An empty table gives no rows.
    """
    if law not in LAWS or shards < 1:
        raise ValueError(f"law is one of {LAWS}, shards at least 1")
    names = [f"dim{i}" for i in range(len(dims))]
    rows = workspace.staged(_keys(docs, list(dims), id_col, text_col), "shard-keys")
    if together:
        group = ["hash", "size", "crc"]
        first = rows.groupBy(*group).agg(F.min_by(F.struct(*names), F.struct("id", "row")).alias("first"))
        rows = hot_keys.attached(rows.drop(*names), first, group, F.col("row")).select("id", "size", "crc", "hash", "row", *[F.col(f"first.{n}").alias(n) for n in names])
        rows = workspace.staged(rows, "shard-groups")
    order = ["place", "hash", "crc", "size", "id", "row"]
    numbered = _numbered(placed_on_curve(rows, names, bits).select(*order), order, "size")
    out = _cut(numbered, shards, law)
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _free(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def write_shards(docs: DataFrame, path: str, shards: int = 24, law: str = "rows", dims: tuple[str, ...] = ("lang", "source"), bits: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """docs with all their columns in folders path/docs/shard=0 .., in the order of the curve, and path/manifest.

    The cuts are those of assign without groups. Only the first key of each shard is kept from its narrow pass; the
    texts cross one range shuffle. Rows that repeat both id and text stay in one shard. The manifest has a row for each
    shard: its rows, and least and greatest value of each dimension. A column of docs named `shard` stays; the folders
    are then named `shard_`.
    """
    spark, names = docs.sparkSession, [f"dim{i}" for i in range(len(dims))]
    column, key = _free("shard", docs.columns), ["place", "hash", "crc", "size", "id"]
    narrow = workspace.staged(_keys(docs, list(dims), id_col, text_col), "shard-keys")
    starts = level_starts(narrow, names, bits)
    numbered = _numbered(placed_on_curve(narrow, names, bits, starts).select(*key, "row"), [*key, "row"], "size")
    cuts = _cut(numbered, shards, law).where("slot = 0").select("shard", *key).orderBy("shard").collect()
    full = placed_on_curve(_keys(docs, list(dims), id_col, text_col, F.struct(*docs.columns)), names, bits, starts)
    types = dict(full.dtypes)
    here = F.struct(*key)
    shard = F.lit(int(cuts[0][0]) if cuts else 0)
    for cut in cuts[1:]:
        shard = F.when(here >= F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(key, cut[1:], strict=True)]), F.lit(int(cut[0]))).otherwise(shard)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = full.withColumn("cut", shard).repartitionByRange(n, "cut", *key, "row").sortWithinPartitions("cut", *key, "row")
    ordered.select("carry.*", F.col("cut").alias(column)).write.partitionBy(column).option("compression", "zstd").parquet(f"{path}/docs")
    # the schema is stated: an empty table has no files to tell it
    written = spark.read.schema(docs.withColumn(column, F.lit(0)).schema).parquet(f"{path}/docs")
    known = [d for d in dims if d in docs.columns]
    bounds = [f(d).alias(f"{f.__name__}_{d}") for d in known for f in (F.min, F.max)]
    written.groupBy(column).agg(F.count(F.lit(1)).alias("rows"), *bounds).coalesce(1).write.parquet(f"{path}/manifest")


def read_where(spark: SparkSession, path: str, ranges: dict[str, tuple]) -> DataFrame:
    """The documents with every dimension of `ranges` from its low to its high value (None: open), from only those
    folders whose least and greatest values allow it. Null dimensions are in no range."""
    manifest = spark.read.parquet(f"{path}/manifest")
    column = manifest.columns[0]
    possible, wanted = F.lit(True), F.lit(True)
    for dim, (low, high) in ranges.items():
        wanted = wanted & F.col(dim).isNotNull()
        for bound, side in ((low, "max"), (high, "min")):
            if bound is not None:
                possible = possible & (F.col(f"{side}_{dim}") >= bound if side == "max" else F.col(f"{side}_{dim}") <= bound)
                wanted = wanted & (F.col(dim) >= bound if side == "max" else F.col(dim) <= bound)
    folders = [r[0] for r in manifest.where(possible).select(column).collect()]
    found = spark.read.parquet(f"{path}/docs") if manifest.count() else manifest
    return found.where(F.col(column).isin(folders)).where(wanted)
