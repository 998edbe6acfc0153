"""Token ids in binary files: concatenated ids in ascending doc_id order, boundaries in Elias-Fano code.

File format: a folder of Parquet containers, one shard for each range of doc_id. A row is a block of
whole documents:

    shard, block     int     place in the order of the corpus
    shard_start      long    ids of the shard before this block
    n_docs, n_ids    long
    doc_ids          array<long>, in order
    width            int     bytes of one id: 2 if all fit, else 4
    ids              binary  the ids of all documents, little-endian, without gaps
    ends             binary  Elias-Fano code of the documents' ends within the block

Parquet as container gives atomic task commits in any store that Spark writes to; no executor touches
a local path. Start offsets in the corpus need one number for each shard, summed on the driver: as
many as the writing stage has partitions, whatever the input.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, workspace
from .elias_fano import EliasFano

BLOCKS = "shard int, block int, shard_start long, n_docs long, n_ids long, doc_ids array<long>, width int, ids binary, ends binary"
BLOCK_IDS = 1 << 18


def _block(shard: int, block: int, start: int, docs: list, parts: list[bytes]) -> dict:
    ids = np.frombuffer(b"".join(parts), "<u4")
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    ends = np.cumsum([len(p) // 4 for p in parts])
    return {"shard": shard, "block": block, "shard_start": start, "n_docs": len(docs), "n_ids": len(ids), "doc_ids": docs, "width": width, "ids": ids.astype(f"<u{width}").tobytes(), "ends": EliasFano.encode(ends).to_bytes()}


def encode_blocks(docs: DataFrame, tokenizer: str, end_id: int | None = 2, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of docs in the order of doc_id (nulls first; rows that repeat an id in input order).

    Null text counts as empty. The texts cross one range shuffle; the position in the input is the
    second sort key, so an id that many rows repeat spreads over partitions.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("shard_start", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("width", pa.int32()), ("ids", pa.binary()), ("ends", pa.binary())])
    tail = b"" if end_id is None else end_id.to_bytes(4, "little")

    def encode(batches):
        bpe, shard = byte_bpe.loaded(tokenizer), TaskContext.get().partitionId()
        block = start = size = 0
        ids, parts = [], []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                parts.append(bpe.encode(text.as_py() or "") + tail)
                size += len(parts[-1]) // 4
                if size >= BLOCK_IDS:
                    yield pa.RecordBatch.from_pylist([_block(shard, block, start, ids, parts)], schema)
                    block, start, size, ids, parts = block + 1, start + size, 0, [], []
        if ids:
            yield pa.RecordBatch.from_pylist([_block(shard, block, start, ids, parts)], schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    placed = rows.repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    return placed.select("doc_id", "text").mapInArrow(encode, BLOCKS)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, **kw) -> None:
    encode_blocks(docs, tokenizer, end_id, **kw).write.option("compression", "zstd").parquet(path)


def _starts(blocks: DataFrame) -> dict[int, int]:
    """Ids of the corpus before each shard."""
    out, total = {}, 0
    for shard, n in sorted(blocks.groupBy("shard").agg(F.sum("n_ids")).collect()):
        out[shard], total = total, total + n
    return out


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of 32-bit little-endian ids)."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    starts = spark.sparkContext.broadcast(_starts(blocks))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def index(batches):
        for batch in batches:
            for shard, before, docs, width, ids, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cuts = np.concatenate([[0], EliasFano.from_bytes(ends).values()])
                ids32 = memoryview(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())
                crc = [zlib.crc32(ids32[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(cuts[:-1] + (starts.value[shard] + before)), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())], names=names)

    return blocks.select("shard", "shard_start", "doc_ids", "width", "ids", "ends").mapInArrow(index, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of each document, from the files."""
    blocks = spark.read.schema(BLOCKS).parquet(path)

    def ids(batches):
        for batch in batches:
            for docs, width, data, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cuts = np.concatenate([[0], EliasFano.from_bytes(ends).values()]).astype("<i4")
                all_ids = pa.array(np.frombuffer(data, f"<u{width}").astype("<i4"))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), all_ids)], names=["doc_id", "ids"])

    return blocks.select("doc_ids", "width", "ids", "ends").mapInArrow(ids, "doc_id long, ids array<int>")


def read_documents(spark: SparkSession, path: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id and ids (array<int>) of the documents with the wanted ids, one row for each document of the files.

    Only blocks that hold one are read; select finds its two boundaries, no other is decoded. Repeated and null
    wanted ids count once and not at all.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    ids = wanted.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    places = blocks.select("shard", "block", F.posexplode("doc_ids").alias("place", "doc_id")).join(ids, "doc_id")
    places = places.groupBy("shard", "block").agg(F.collect_list("place").alias("places"))  # at most a block's documents

    def cut(batches):
        for batch in batches:
            found, parts = [], []
            for docs, width, data, ends, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                code = EliasFano.from_bytes(ends)
                for i in sorted(places):
                    a, b = code.select(i - 1) if i else 0, code.select(i)
                    found.append(docs[i])
                    parts.append(np.frombuffer(data, f"<u{width}", b - a, width * a).astype("<i4"))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(parts, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return blocks.join(places, ["shard", "block"]).select("doc_ids", "width", "ids", "ends", "places").mapInArrow(cut, "doc_id long, ids array<int>")


def document_offsets(docs: DataFrame, tokenizer: str, end_id: int | None = 2) -> DataFrame:
    """Write docs to files in the shared folder and return the index read back from them.

    An empty table gives no rows; an empty or null text has its end id alone.
    """
    path = workspace.stage_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer, end_id)
    return read_index(docs.sparkSession, path)
