"""Byte-level BPE by a shuffle of distinct words: pre-tokens keep their positions as codes of a chunk's word
list, each distinct word is encoded once where its entries meet, ids go back to the chunks and the texts are
reassembled by position. Decoding explodes ids in order, joins them with the token-byte table, which has as
many rows as the vocabulary and is broadcast, and strings the bytes together again in the same task.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, word_chunks, workspace

#: Fixed value: the pattern that byte_bpe.SPLIT spells out.
SPELLED_OUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode's white space beyond U+00FF.
WIDE_SPACES = r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class PreTokens:
    """Splits texts by the pattern of a rank file. Texts within U+00FF use spelled-out classes, others the
    pattern with its \\s as Unicode's white space."""

    def __init__(self, pattern: str):
        self.pattern, self.wide = pattern, None

    def __call__(self, data: bytes) -> list[str]:
        text = data.decode()
        if self.pattern == SPELLED_OUT and not byte_bpe.UNUSUAL.search(text):
            return byte_bpe.SPLIT.findall(text)
        if self.wide is None:
            import regex

            spaces = byte_bpe.SPACES + WIDE_SPACES
            self.wide = regex.compile(self.pattern.replace(r"[^\s", f"[^{spaces}").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]"))
        return self.wide.findall(text)

    def __getstate__(self):
        return {"pattern": self.pattern, "wide": None}


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_encoders: dict[str, object] = {}


def _encoder(path: str, pattern: str):
    if path not in _encoders:
        import tiktoken

        _encoders[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
    return _encoders[path]


@lru_cache
def _width(path: str) -> str:
    return "<u2" if max(ranks(path).values(), default=0) < 1 << 16 else "<u4"


def _encode_words(path: str, pattern: str):
    def ask(words: list[bytes]) -> list[bytes]:
        one = _encoder(path, pattern)._encode_single_piece
        kind = _width(path)
        return [np.array(one(w), kind).tobytes() for w in words]

    return ask


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """The token-byte table: id, token (binary). As many rows as the vocabulary has."""
    return spark.createDataFrame([(i, bytearray(t)) for t, i in ranks(path).items()], "id int, token binary")


def _spelled(pieces: DataFrame, key: str, spark: SparkSession, path: str, out: str, close) -> DataFrame:
    """pieces: key columns (longs and ints), code = 2 * id + 1 where a unit ends, in order within a partition; each
    piece gets its token by a broadcast join, which keeps the order. close(key, ids, unit lengths in ids, unit
    lengths in bytes, bytes) makes the row of the pieces of one key; a null code is a key without ids."""
    keys = [k.split()[0] for k in key.split(", ")]
    found = pieces.join(F.broadcast(token_table(spark, path)), F.shiftright("code", 1) == F.col("id"), "left")
    arrow = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[kind]) for name, kind in map(str.split, out.split(", "))])
    found = found.select(*keys, "code", F.when(F.col("token").isNotNull() | F.col("code").isNull(), F.col("token")).otherwise(F.raise_error(F.lit("an id without a token"))).alias("token"))

    def run(batches):
        now, codes, sizes, data = None, [], [], []

        def row():
            code = np.concatenate(codes)
            last = np.flatnonzero(code & 1)
            size = np.concatenate(sizes)
            ends = np.cumsum(size)[last] if len(size) else last
            return close(now, code >> 1, np.diff(last, prepend=-1), np.diff(ends, prepend=0), b"".join(data))

        for batch in batches:
            made, columns = [], [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(keys))]
            cuts = [0, *(np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1).tolist(), batch.num_rows]
            code, token = batch.column(len(keys)), batch.column(len(keys) + 1)
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                this = tuple(int(c[a]) for c in columns)
                if this != now:
                    if now is not None:
                        made.append(row())
                    now, codes, sizes, data = this, [], [], []
                mine, bytes_of = code.slice(a, b - a).drop_null().to_numpy(), token.slice(a, b - a).drop_null()
                codes.append(mine)
                ends = np.frombuffer(bytes_of.buffers()[1], "<i4", len(bytes_of) + 1, 4 * bytes_of.offset) if len(bytes_of) else np.zeros(1, "<i4")
                sizes.append(np.diff(ends))
                if len(bytes_of):
                    data.append(bytes_of.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row(), arrow, strict=True)], schema=arrow)

    return found.mapInArrow(run, out)


def _unpack_spelled(data: bytes) -> list[tuple[bytes, bytes]]:
    """(ids as bytes, decoded bytes) of each word of a part."""
    data = word_chunks.stretch(data)
    n, width = int.from_bytes(data[:4], "little"), data[4]
    ids, size = (np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u4", n, 5 + 4 * n * k), dtype=np.int64)]) for k in range(2))
    at = 5 + 8 * n
    ids = (at + width * ids).tolist()
    size = (ids[-1] + size).tolist()
    return [(data[a:b], data[c:d]) for a, b, c, d in zip(ids, ids[1:], size, size[1:], strict=False)]


def encoded_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (bytes decoded from the ids).

    Null text counts as empty: 0 tokens, digests of nothing. Repeated rows are encoded each. Ids are decoded
    by the join with the token-byte table, each chunk's distinct words once.
    """
    chunks = word_chunks.chunked(docs, PreTokens(pattern), id_col=id_col, text_col=text_col)

    def ask(words: list[bytes]) -> list[list[int]]:
        one = _encoder(path, pattern)._encode_single_piece
        return [[2 * i for i in ids[:-1]] + [2 * ids[-1] + 1] for ids in map(one, words)]

    def close(key, ids, many, size, data):
        head = len(many).to_bytes(4, "little") + bytes([int(_width(path)[2])])
        return *key, word_chunks.squeeze(head + many.astype("<u4").tobytes() + size.astype("<u4").tobytes() + ids.astype(_width(path)).tobytes() + data)

    ids = word_chunks.asked(chunks, ask, "codes", pa.list_(pa.int32()), lambda found: [i for w in found for i in w])
    pieces = ids.select("chunk", "part", F.explode("codes").alias("code"))
    replies = word_chunks.gathered(_spelled(pieces, "chunk long, part int", docs.sparkSession, path, "chunk long, part int, data binary", close))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def build(ids, _, sizes, codes, answers):
        kind = _width(path)
        tokens = [np.frombuffer(a, kind).tolist() for a, _ in answers]
        text = [",".join(map(str, t)) for t in tokens]
        spelled = [s for _, s in answers]
        many = np.fromiter(map(len, tokens), np.int64, len(tokens))
        at = 0
        rows = {name: [] for name in arrow.names}
        for doc, size in zip(ids, sizes, strict=True):
            mine = codes[at : at + size]
            at += size
            where = mine.tolist()
            rows["doc_id"].append(doc)
            rows["n_tokens"].append(int(many[mine].sum()))
            rows["ids_sha256"].append(hashlib.sha256(",".join([text[i] for i in where]).encode()).hexdigest())
            rows["decoded_sha256"].append(hashlib.sha256(b"".join([spelled[i] for i in where])).hexdigest())
        yield rows

    return word_chunks.reassembled(chunks, replies, build, schema, arrow, _unpack_spelled)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (array<int>)."""
    chunks = word_chunks.chunked(docs, PreTokens(pattern), id_col=id_col, text_col=text_col)
    replies = word_chunks.answered(chunks, _encode_words(path, pattern))

    def build(ids, _, sizes, codes, answers):
        at = 0
        for doc, size in zip(ids, sizes, strict=True):
            mine = b"".join([answers[i] for i in codes[at : at + size].tolist()])
            at += size
            yield {"doc_id": [doc], "ids": [np.frombuffer(mine, _width(path)).astype("<i4")]}

    return word_chunks.reassembled(chunks, replies, build, "doc_id long, ids array<int>", pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))


def decoded(encoded_docs: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id, data (binary): the tokens of its ids, by a join with the token-byte table.

    Null or empty ids give no bytes; an id outside of the table is an error; rows that repeat a doc_id are decoded each.
    """
    kind = dict(encoded_docs.dtypes)[id_col]
    # a row number holds for its own task, in which the join and the stringing together stay; the last piece of a row is marked
    rows = encoded_docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    rows = workspace.staged(rows, "to-decode")
    coded = F.transform("ids", lambda x, i: F.when(i == F.size("ids") - 1, 2 * x + 1).otherwise(2 * x).cast("int"))
    pieces = rows.select("row", F.explode_outer(coded).alias("code"))
    made = _spelled(pieces, "row long", encoded_docs.sparkSession, path, "row long, data binary", lambda key, ids, many, size, data: (*key, data))
    return rows.select("row", F.col("doc_id").cast(kind).alias("doc_id")).join(made, "row").select("doc_id", "data")
