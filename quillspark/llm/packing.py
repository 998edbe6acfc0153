"""Best-fit decreasing packing of documents into sequences of fixed length.

Best-fit decreasing depends only on how many pieces there are of each length, and there are at most
`capacity` lengths. So the pieces are tokenised and counted on the executors, the plan is made on the
driver from at most `capacity` counts, and the plan (a bounded list of runs) goes back to place every
piece by its rank among the pieces of its length. A segment tree over remaining capacities finds the
tightest open sequences in logarithmic time; equal pieces are placed together, exactly as one by one.

The rank of a piece: its number within its length in the task that cut it, plus the number of such
pieces in the tasks before. Tasks and numbers are stored with the pieces when they are written.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import byte_bpe, workspace


class CapacityTree:
    """Segment tree over remaining capacities: the least capacity >= x that an open sequence has."""

    def __init__(self, most: int):
        self.size = 1
        while self.size <= most:
            self.size *= 2
        self.any = [0] * (2 * self.size)

    def put(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.size
        self.any[i] = int(is_open)
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, x: int) -> int | None:
        i = x + self.size
        if self.any[i]:
            return x
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, rank, pieces, sequence, per_sequence, offset): the pieces of that length with ranks
    from `rank` on go to consecutive sequences, per_sequence of them to each, from `offset` on.

    Pieces of equal length fill the tightest sequences one after the other, so one step serves a whole
    group of sequences with equal room.
    """
    tree, groups = CapacityTree(capacity), {}  # remaining capacity -> [(first sequence, how many)]
    runs, fresh = [], 0

    def keep(room: int, first: int, many: int) -> None:
        if many and room:
            groups.setdefault(room, []).append((first, many))
            tree.put(room, True)

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                each = room // length
                first, many = fresh, -(-left // each)
                fresh += many
            else:
                first, many = groups[room].pop()
                if not groups[room]:
                    tree.put(room, False)
                each = room // length
            full = min(many, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - room))
                keep(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < many and left:
                runs.append((length, rank, left, first + full, left, capacity - room))
                keep(room - left * length, first + full, 1)
                full, left = full + 1, 0
            keep(room, first + full, many - full)
    return runs


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, idx long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document: only those over capacity are cut, and their first piece is the short one."""
    tail = b"" if end_id is None else end_id.to_bytes(4, "little")
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def cut(batches):
        bpe, part = byte_bpe.loaded(tokenizer), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(bpe.encode(text.as_py() or "") + tail)
                n = len(ids) // 4
                a, b, piece = 0, n % capacity or min(n, capacity), 0
                while a < n:
                    idx = seen.get(b - a, 0)
                    seen[b - a] = idx + 1
                    rows.append((doc, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), part, idx))
                    a, b, piece = b, b + capacity, piece + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def place(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """sequence_id and offset of every row of a written table with length, part and idx (idx counts from 0
    within length and part)."""
    spark = pieces.sparkSession
    per_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = per_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(x > capacity for x in counts):
        raise ValueError("a piece is longer than a sequence")
    runs = np.array(best_fit_plan(counts, capacity), dtype=np.int64).reshape(-1, 6)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shared = spark.sparkContext.broadcast(runs)
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("idx")).drop("before", "part", "idx")
    kept = [c for c in ranked.columns if c != "rank"]

    def to_sequences(batches):
        lengths, ranks, _, first, each, offset = shared.value.T
        wide = np.int64(1) << 44  # ranks of one length stay below
        keys = lengths * wide + ranks
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            run = np.searchsorted(keys, length * wide + rank, side="right") - 1
            j = rank - ranks[run]
            out = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept], names=kept)
            yield out.append_column("sequence_id", pa.array(first[run] + j // each[run])).append_column("offset", pa.array(offset[run] + j % each[run] * length))

    fields = ", ".join(f"{c} {t}" for c, t in ranked.select(*kept).dtypes)
    return ranked.mapInArrow(to_sequences, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int | None = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty (its end id is packed); rows that repeat a doc_id are packed each; an
    empty table gives no rows.
    """
    pieces = workspace.staged(cut_pieces(docs, tokenizer, capacity, end_id), "pieces")
    return place(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
