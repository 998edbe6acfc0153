"""Documents as chunks of word codes, and answers about distinct words brought back to the chunks.

A chunk is a run of documents of one input split, bounded in bytes and in distinct words. It keeps, for
each document, the positions' codes into the chunk's own word list, and the word list dealt into
parts by a hash of the word. All rows with a given part, from every chunk, meet in one task, so that
whatever is asked about a word is worked out once for that word and goes back to each chunk that
holds it: one entry for each chunk and distinct word crosses the shuffle, not one for each position.
A word that makes up a third of the corpus is still one entry in a chunk.

The chunk table is written once, bucketed by chunk, so the codes never cross a shuffle.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workspace

#: order: the codes of the words, part after part; words: packed and sorted, counts: of positions, by a flag of the document.
CHUNKS = "chunk long, doc_ids array<long>, extra array<int>, sizes array<int>, codes binary, order binary, parts array<struct<part int, words binary, counts binary>>"
PART = pa.struct([("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])
ARROW = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("extra", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()), ("order", pa.binary()), ("parts", pa.list_(PART))])


def pack_codes(codes: np.ndarray) -> bytes:
    """Codes below 2^31 in 1 to 5 bytes: 7 bits each, the high bit says that another follows."""
    size = 1 + sum((codes >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - size
    for k in range(int(size.max(initial=0))):
        here = size > k
        out[starts[here] + k] = (codes[here] >> (7 * k) & 127) | np.where(size[here] > k + 1, 128, 0)
    return out.tobytes()


def unpack_codes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    size = last - starts + 1
    codes = (raw[starts] & 127).astype(np.int32)
    for k in range(1, int(size.max(initial=0))):
        here = size > k
        codes[here] |= (raw[starts[here] + k] & 127).astype(np.int32) << (7 * k)
    return codes


def squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def stretch(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def join_words(words: list[bytes]) -> bytes:
    """Number, lengths and bytes of the words, compressed."""
    return squeeze(len(words).to_bytes(4, "little") + np.fromiter(map(len, words), "<u4", len(words)).tobytes() + b"".join(words))


def split_words(data: bytes) -> list[bytes]:
    data = stretch(data)
    n = int.from_bytes(data[:4], "little")
    ends = (np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends], ends, strict=False)]


def join_array(words: pa.Array) -> bytes:
    """join_words of a binary array, from its memory."""
    n = len(words)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1]
    data = words.buffers()[2]
    return squeeze(n.to_bytes(4, "little") + np.diff(ends).astype("<u4").tobytes() + (data[int(ends[0]) : int(ends[-1])].to_pybytes() if data else b""))


def split_array(data: bytes) -> pa.Array:
    """What split_words gives, as a binary array over the stretched bytes."""
    data = stretch(data)
    n = int.from_bytes(data[:4], "little")
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(np.frombuffer(data, "<u4", n, 4), out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)[4 + 4 * n :]])


class _Codes(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _chunk(number: int, docs: list, extra: list, sizes: list, coded: list, words: dict, parts: int) -> dict:
    codes = np.concatenate(coded) if coded else np.zeros(0, np.int32)
    counts = np.bincount(codes, minlength=len(words))
    flagged = np.bincount(codes, np.repeat(np.asarray(extra) > 0, sizes), minlength=len(words)).astype("<u4")
    rank = np.empty(len(words), np.int32)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(words), dtype=np.int32)  # frequent words get the short codes
    names = [w if isinstance(w, bytes) else w.encode() for w in words]
    mine: dict[int, list[int]] = {}
    for i in sorted(range(len(names)), key=names.__getitem__):
        mine.setdefault(zlib.crc32(names[i]) % parts, []).append(i)
    made = [{"part": part, "words": join_words([names[i] for i in mine[part]]), "counts": squeeze(flagged[mine[part]].tobytes())} for part in sorted(mine)]
    order = rank[[i for part in sorted(mine) for i in mine[part]]].astype("<u4").tobytes()
    return {"chunk": number, "doc_ids": docs, "extra": extra, "sizes": sizes, "codes": pack_codes(rank[codes].astype(np.int64)), "order": order, "parts": made}


def _array_chunk(number: int, docs: list, extra: list, sizes: list, found: list[pa.Array], parts: int) -> dict:
    """As _chunk, of arrays of all words in order: coded, dealt into parts and sorted as arrays."""
    coded = pa.concat_arrays(found).dictionary_encode()
    codes, names = coded.indices.to_numpy(), coded.dictionary
    counts = np.bincount(codes, minlength=len(names))
    flagged = np.bincount(codes, np.repeat(np.asarray(extra) > 0, sizes), minlength=len(names)).astype("<u4")
    rank = np.empty(len(names), np.int32)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(names), dtype=np.int32)
    starts, data = np.frombuffer(names.buffers()[1], np.int32)[names.offset :].tolist(), memoryview(names.buffers()[2] or b"")
    part = np.fromiter((zlib.crc32(data[starts[i] : starts[i + 1]]) for i in range(len(names))), np.int64, len(names)) % parts
    mine = pc.sort_indices(names).to_numpy()
    mine = mine[np.argsort(part[mine], kind="stable")]
    ends = np.cumsum(np.bincount(part, minlength=parts)).tolist()
    names, flagged = names.take(pa.array(mine)), flagged[mine]
    made = [{"part": k, "words": join_array(names[a:b]), "counts": squeeze(flagged[a:b].tobytes())} for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if a < b]
    return {"chunk": number, "doc_ids": docs, "extra": extra, "sizes": sizes, "codes": pack_codes(rank[codes]), "order": rank[mine].astype("<u4").tobytes(), "parts": made}


def _pieces(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows: one ends with the row that takes its texts to size bytes."""
    ends, first = np.cumsum([len(t.as_buffer()) for t in batch.column(2)]), 0
    while first < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size)) + 1
        yield batch.slice(first, stop - first)
        first = stop


def chunked(docs: DataFrame, split: Callable[[bytes], Iterable], extra=None, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 12_000_000, chunk_words: int = 300_000, split_arrays: Callable[[pa.Array], tuple[np.ndarray, pa.Array]] | None = None) -> DataFrame:
    """The chunk table of docs, written and read back. split(text as UTF-8 bytes) gives its words, as str or bytes.

    extra: an int Column that stays with each document. Null text counts as empty. split_arrays: instead of
    split, a function of an array of texts that gives the number of words of each and all words, binary; words
    are no Python objects then, so bytes alone bound a chunk.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 24, 0
        ids, extras, sizes, coded, words, size, held = [], [], [], [], _Codes(), 0, 0
        for batch in batches:
            for doc, flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                found = split(text)
                codes = np.fromiter(map(words.__getitem__, found), np.int32, len(found))
                ids.append(doc)
                extras.append(flag)
                sizes.append(len(codes))
                coded.append(codes)
                size, held = size + len(text), held + len(codes)
                if size >= chunk_bytes or len(words) >= chunk_words:
                    yield pa.RecordBatch.from_pylist([_chunk(first + number, ids, extras, sizes, coded, words, parts)], ARROW)
                    number += 1
                    ids, extras, sizes, coded, words, size, held = [], [], [], [], _Codes(), 0, 0
        if ids:
            yield pa.RecordBatch.from_pylist([_chunk(first + number, ids, extras, sizes, coded, words, parts)], ARROW)

    def run_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 24, 0
        ids, extras, sizes, found, size = [], [], [], [], 0
        for batch in batches:
            for piece in _pieces(batch, chunk_bytes // 8):
                many, now = split_arrays(piece.column(2))
                ids += piece.column(0).to_pylist()
                extras += piece.column(1).to_pylist()
                sizes += many.tolist()
                found.append(now)
                size += sum(len(t.as_buffer()) for t in piece.column(2))
                if size >= chunk_bytes:
                    yield pa.RecordBatch.from_pylist([_array_chunk(first + number, ids, extras, sizes, found, parts)], ARROW)
                    number += 1
                    ids, extras, sizes, found, size = [], [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_array_chunk(first + number, ids, extras, sizes, found, parts)], ARROW)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit(0) if extra is None else extra).cast("int").alias("extra"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    name = f"quillspark_chunks_{uuid.uuid4().hex}"
    made = rows.mapInArrow(run_arrays if split_arrays else run, CHUNKS)
    made.write.format("parquet").option("compression", "zstd").option("path", workspace.stage_path(spark, "chunks")).bucketBy(n, "chunk").saveAsTable(name)
    chunks = spark.table(name)
    # buckets need a table to be written; once resolved, the rows are read by their files alone
    spark.sql(f"DROP TABLE {name}")
    return chunks


def word_parts(chunks: DataFrame) -> DataFrame:
    """One row for each chunk and part: chunk, part, words, counts (positions in documents with extra > 0)."""
    return chunks.select("chunk", F.explode("parts").alias("p")).select("chunk", "p.*")


def met(chunks: DataFrame, *columns: str) -> DataFrame:
    """The word parts, rows of equal part one after another in one partition."""
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return word_parts(chunks).select("chunk", "part", *columns).repartition(n, "part").sortWithinPartitions("part")


def gathered(replies: DataFrame) -> DataFrame:
    """chunk and answers: as many as the chunk has parts."""
    return replies.groupBy("chunk").agg(F.collect_list(F.struct("part", "data")).alias("answers"))


def asked(chunks: DataFrame, ask: Callable[[list[bytes]], list], column: str, kind: pa.DataType, pack: Callable[[list], object]) -> DataFrame:
    """chunk, part and pack(answers of the part's words), in the order of parts.

    ask runs in the task where all entries of its words meet, and is given each distinct word once: the
    answers of one part are held at a time.
    """

    def run(batches):
        known: dict = {}
        now = None
        for batch in batches:
            out = []
            for part, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if part != now:
                    now, known = part, {}
                words = split_words(data)
                if new := [w for w in words if w not in known]:
                    known.update(zip(new, ask(new), strict=True))
                out.append(pack([known[w] for w in words]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["chunk", "part", column])

    sql = {pa.binary(): "binary", pa.list_(pa.int32()): "array<int>"}[kind]
    return met(chunks, "words").mapInArrow(run, f"chunk long, part int, {column} {sql}")


def answered(chunks: DataFrame, ask: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """chunk and answers that hold ask(words) for every word of the chunk."""
    return gathered(asked(chunks, ask, "data", pa.binary(), join_words))


def answers_in_place(order: bytes, answers: list[dict], unpack: Callable[[bytes], list] = split_words) -> list:
    """The answers of a chunk's words, by code."""
    places = np.frombuffer(order, "<u4").tolist()
    out: list = [b""] * len(places)
    flat = (w for a in sorted(answers, key=lambda a: a["part"]) for w in unpack(a["data"]))
    for place, word in zip(places, flat, strict=True):
        out[place] = word
    return out


def reassembled(chunks: DataFrame, replies: DataFrame, build: Callable[[list, list, list, np.ndarray, list], Iterator[dict]], schema: str, arrow: pa.Schema, unpack: Callable[[bytes], list] = split_words) -> DataFrame:
    """build(doc_ids, extra, sizes, codes, answers by code) makes the rows of a chunk; one chunk is held at a time."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, extra, sizes, codes, order, answers = (batch.column(k)[i].as_py() for k in range(6))
                for rows in build(ids, extra, sizes, unpack_codes(codes), answers_in_place(order, answers or [], unpack)):
                    yield pa.RecordBatch.from_pydict(rows, arrow)

    return chunks.select("chunk", "doc_ids", "extra", "sizes", "codes", "order").join(replies, "chunk", "left").select("doc_ids", "extra", "sizes", "codes", "order", "answers").mapInArrow(run, schema)
