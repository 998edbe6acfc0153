"""Documents cut into prefix, middle and suffix and put in another order, by bit-parallel big integers.

A text's UTF-8 bytes become one big integer for each class of characters (bytes.translate makes it 0s and 1s,
of which int() makes bits, first byte highest). A shifted copy and a boolean operation mark all ends of
tokens at once, bit_count() gives their number, and halving the integer again and again finds the k-th
marked place. No token is ever made as a string, so memory stays at a few times the text however long it is.

Tokens: [\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+. All blanks are single bytes, so ends of
tokens are never inside a character.

Cuts and forms follow the sha256 of `seed:id` only, so a row always gets the same ones, in any partition.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_BLANKS = b" \t\n\x0b\x0c\r"
_WORD = bytes(48 if b in _BLANKS else 49 for b in range(256))
#: First bytes of characters: all but 10xxxxxx.
_FIRST = bytes(48 if 0x80 <= b < 0xC0 else 49 for b in range(256))
BATCH_BYTES = 16_000_000


def token_ends(text: bytes) -> int:
    """A bit for each byte of text, the first byte's highest: set where a token ends."""
    if not text:
        return 0
    word = int(text.translate(_WORD), 2)
    return (word & ~(word << 1)) | (~word & 1)


def select(mask: int, width: int, k: int) -> int:
    """The place, counted from the highest of width bits, after the k-th set bit; 0 for k = 0."""
    if not k:
        return 0
    place = 0
    while width > 1:
        low = width // 2
        high = mask >> low
        n = high.bit_count()
        if k <= n:
            mask, width = high, width - low
        else:
            mask, width, place, k = mask & ((1 << low) - 1), low, place + width - low, k - n
    return place + 1


def characters(text: bytes) -> int:
    return int(text.translate(_FIRST), 2).bit_count() if text else 0


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that depend on seed and key alone."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12))


def rearranged(text: bytes, numbers: tuple[int, int, int, int], percent: int = 50, spm_percent: int = 80) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, characters of prefix and of middle (None if plain), output."""
    ends = token_ends(text)
    n = ends.bit_count()
    if not text or numbers[2] % 100 >= percent or any(mark.encode() in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    cuts = [select(ends, len(text), k) for k in sorted((numbers[0] % (n + 1), numbers[1] % (n + 1)))]
    prefix, middle, suffix = text[: cuts[0]], text[cuts[0] : cuts[1]], text[cuts[1] :]
    if numbers[3] % 100 < spm_percent:
        form, parts = "spm", (SUFFIX.encode(), suffix, PREFIX.encode(), prefix, MIDDLE.encode(), middle)
    else:
        form, parts = "psm", (PREFIX.encode(), prefix, SUFFIX.encode(), suffix, MIDDLE.encode(), middle)
    return n, form, characters(prefix), characters(middle), b"".join(parts)


COLUMNS = "n long, form string, prefix_chars long, middle_chars long, output string"


def transform(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n (tokens), form (plain, spm, psm), prefix_chars, middle_chars, output.

    percent of the texts are cut, spm_percent of these start with the suffix. Null text counts as empty; empty
    texts and texts that hold one of the marks stay plain. Rows that repeat an id get the same numbers, so equal
    rows the same output; a null id is the empty string in the hash. An empty table gives no rows. Other columns
    are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def cut(batches):
        for batch in batches:
            rows, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                numbers = draws(seed, "" if doc is None else str(doc))
                rows.append((doc, *rearranged(text.as_py() or b"", numbers, percent, spm_percent)))
                size += len(rows[-1][-1])
                if size >= BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"doc_id long, {COLUMNS}")


def restored(output: Column, form: Column) -> Column:
    """The text before transform. Each mark stands once in a cut output: none can arise where two parts meet,
    for a mark begins with its only `<`."""
    part = lambda after, before: F.split_part(F.split_part(output, F.lit(after), F.lit(2)), F.lit(before), F.lit(1))
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    return (
        F.when(form == "psm", F.concat(part(PREFIX, SUFFIX), middle, part(SUFFIX, MIDDLE)))
        .when(form == "spm", F.concat(part(PREFIX, MIDDLE), middle, part(SUFFIX, PREFIX)))
        .otherwise(output)
    )


def digests(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """transform with output and restored text as SHA-256 (lowercase hex, UTF-8)."""
    made = transform(docs, seed, percent, spm_percent)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
