"""Exact token counts at every prefix of a text, by prefix dynamic programming over a sentencepiece BPE model.

A sequence of pieces is the model's encoding of a text exactly if every two neighbours are the
encoding of their own concatenation. So the encoding of a prefix ends in the one piece t that fits to
the last piece of the prefix before t, and count(prefix) = count(prefix without t) + 1: a table filled
from left to right. No piece holds a word mark after another character or a character that the model
spells in bytes, so the table starts anew at each such unit and a text's counts are sums over its
units. Units met before are looked up (a bounded table).

The counts answer truncation and budget questions without encoding anything again.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import worker_cache

MARK = "▁"
#: A unit: blanks with the word behind them, or blanks alone, or one newline.
UNIT = re.compile(r" *[^ \n]+| +|\n")


class _Units(dict):
    """unit -> the counts of its prefixes, of 0 to all of its characters."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.score = {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        bytewise = any(m.is_byte(i) for i in range(m.get_piece_size()))
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.score) or not bytewise:
            raise ValueError("a model is needed whose pieces end at word marks and that spells unknown characters in bytes")
        self.pieces = ["", *self.score]  # 0 stands for the start and for a character spelled in bytes
        self.ends: dict = {}  # trie of the pieces read backwards; a piece's number stands at key 0
        for number, piece in enumerate(self.pieces):
            node = self.ends
            for char in reversed(piece):
                node = node.setdefault(char, {})
            node[0] = number
        self.sizes, self.longest = [len(p) for p in self.pieces], max(map(len, self.pieces))
        self.fits: dict[int, bool] = {}
        self.older: dict = {}

    def merged(self, text: str) -> list[str]:
        """The model's encoding of a short text: the best-scored neighbours merge first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = max(((self.score.get(parts[i] + parts[i + 1], float("-inf")), -i) for i in range(len(parts) - 1)), default=(float("-inf"), 0))
            if best[0] == float("-inf"):
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fit(self, key: int) -> bool:
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        before, piece = self.pieces[key >> 20], self.pieces[key & 0xFFFFF]
        self.fits[key] = found = self.merged(before + piece) == ([before, piece] if before else [piece])
        return found

    def __missing__(self, unit: str) -> bytes | tuple[int, ...]:
        if (table := self.older.get(unit)) is not None:
            self[unit] = table
            return table
        text, ends, fits, sizes, n = unit.replace(" ", MARK), self.ends, self.fits, self.sizes, len(unit)
        back, reach = text[::-1], self.longest
        last, count = [0], [0]
        for i in range(1, n + 1):
            node, found = ends, []
            for char in back[n - i : n - i + reach]:
                if (node := node.get(char)) is None:
                    break
                if (piece := node.get(0)) is not None:
                    found.append(piece)
            while found:
                piece = found.pop()
                j = i - sizes[piece]
                key = last[j] << 20 | piece
                known = fits.get(key)
                if known or known is None and self.fit(key):
                    last.append(piece)
                    count.append(count[j] + 1)
                    break
            else:
                last.append(0)
                count.append(count[-1] + len(text[i - 1].encode()))
        self[unit] = table = bytes(count) if count[-1] < 128 and max(count) < 256 else tuple(count)
        return table

    def turn(self) -> None:
        """Make room: the words met since the last turn stay at hand, older ones go."""
        self.older = dict(self)
        self.clear()


class PrefixCounter:
    def __init__(self, path: str, known: int = 300_000):
        self.units, self.most = _Units(path), known

    def tables(self, text: str) -> tuple[list[str], list]:
        """The units of a text and their prefix tables. The model puts a word mark before a text that isn't empty."""
        if not text:
            return [], []
        if len(self.units) > self.most:
            self.units.turn()
        found = UNIT.findall(" " + text.replace(MARK, " "))
        return found, list(map(self.units.__getitem__, found))

    def at_units(self, text: str) -> list[int]:
        """Tokens up to the end of each unit; the last is the text's count."""
        return list(accumulate(t[-1] for t in self.tables(text)[1]))

    def count(self, text: str) -> int:
        return sum(t[-1] for t in self.tables(text)[1])

    def at_prefixes(self, text: str) -> list[int]:
        """Tokens of text[:k] for k = 0 .. len(text)."""
        out, before = [], 0
        for table in self.tables(text)[1]:
            out += [before + c for c in table[1:]]
            before += table[-1]
        return [0, *out[1:]] if text else [0]

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most `budget` tokens, by the stored tables."""
        return text[: Prefixes(*self.tables(text)).longest(budget)]


class Prefixes:
    """The stored counts of one text; answers for any prefix in logarithmic time."""

    def __init__(self, found: list[str], inner: list):
        """Of PrefixCounter.tables."""
        self.inner = inner
        self.starts = [0, *accumulate(map(len, found))]
        self.before = [0, *accumulate(t[-1] for t in self.inner)]

    def count(self, k: int) -> int:
        if k <= 0 or not self.inner:
            return 0
        k = min(k + 1, self.starts[-1])  # the model's own mark stands first
        u = min(bisect_right(self.starts, k) - 1, len(self.inner) - 1)
        return self.before[u] + self.inner[u][k - self.starts[u]]

    def total(self) -> int:
        return self.before[-1]

    def longest(self, budget: int) -> int:
        """Characters of the longest prefix of at most `budget` tokens. Sums before a unit never fall, so it ends
        in the last unit whose sum fits; within a unit counts may fall again, so that one is read from its end."""
        u = bisect_right(self.before, budget) - 1
        if u < 0 or not self.inner:
            return 0
        if u == len(self.inner):
            return self.starts[-1] - 1
        left = budget - self.before[u]
        return max(0, self.starts[u] - 1 + next((k for k in range(len(self.inner[u]) - 1, 0, -1) if self.inner[u][k] <= left), 0))


_loaded: dict[str, PrefixCounter] = {}


def loaded(path: str) -> PrefixCounter:
    if path not in _loaded:
        worker_cache.enter("prefix_tokens")
        _loaded[path] = PrefixCounter(path)
        worker_cache.hold("prefix_tokens", _loaded.clear)
    return _loaded[path]


def _mapped(docs: DataFrame, id_col: str, text_col: str, rows, schema: str) -> DataFrame:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    names, types = zip(*((name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))), strict=True)

    def run(batches):
        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column(1))
            made = list(zip(*(rows(t) for t in texts), strict=True))
            if made:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, kind in zip(made, types[1:], strict=True))], names=list(names))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit, kept_chars (characters of the longest prefix of at most
    `limit` tokens, by the prefix table). A map without shuffle.

    Null text counts as empty (0 tokens); repeated rows are counted each; a null doc_id stays null;
    other columns are not read.
    """

    def row(text: str) -> tuple[int, int, bool, int]:
        found, inner = loaded(model).tables(text)
        n = sum(t[-1] for t in inner)
        return len(text.encode()), n, n > limit, Prefixes(found, inner).longest(limit) if n > limit else len(text)

    return _mapped(docs, id_col, text_col, row, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, kept_chars long")


def prefix_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, counts (array<int>): tokens of the first k characters, k from 0."""
    return _mapped(docs, id_col, text_col, lambda t: (loaded(model).at_prefixes(t),), "doc_id long, counts array<int>")


def kept_within(prefixes: DataFrame, budget: int, counts_col: str = "counts") -> DataFrame:
    """The stored table of prefix_counts with kept_chars, the longest prefix of at most `budget` tokens. Texts and
    the model aren't needed; the answer is a fold over the stored counts in the JVM."""
    return prefixes.withColumn("kept_chars", F.array_max(F.transform(counts_col, lambda n, k: F.when(n <= budget, k.cast("long")))))


def truncated(docs: DataFrame, model: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text cut to the longest prefix of at most `budget` tokens, n_tokens of it."""

    def row(text: str) -> tuple[str, int]:
        cut = loaded(model).truncate(text, budget)
        return cut, loaded(model).count(cut)

    return _mapped(docs, id_col, text_col, row, "doc_id long, text string, n_tokens long")
