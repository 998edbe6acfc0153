"""Exact ids of a byte-level BPE vocabulary file of the tokenizers library, one distinct pre-token at a time.

The library's byte-level pre-tokenizer splits a text by a fixed pattern, and no merge crosses a split.
So the ids of a text are the ids of its pre-tokens, and each worker keeps the library's answer for the
pre-tokens it has met lately (a bounded table). Texts with characters for which the split
depends on Unicode tables, or with a special token's string, go to the library whole.
"""

from __future__ import annotations

import re

from . import worker_cache

#: The byte-level pattern's classes, spelled out for U+0000 to U+00FF and general punctuation.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = r"\t-\r \x85\xa0"
SPLIT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
#: Characters outside the classes above.
UNUSUAL = re.compile(r"[^\x00-\xff‐-‧]")


def byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, model):
        super().__init__()
        self.model, self.alphabet, self.older = model, byte_characters(), {}

    def turn(self) -> None:
        """Make room: the words met since the last turn stay at hand, older ones go."""
        self.older = dict(self)
        self.clear()

    def __missing__(self, word: str) -> bytes:
        if (ids := self.older.get(word)) is not None:
            self[word] = ids
            return ids
        letters = word.encode().decode("latin-1").translate(self.alphabet)
        found = self.model.tokenize(letters)
        self[word] = ids = b"".join([t.id.to_bytes(4, "little") for t in found])
        return ids


class ByteBpe:
    def __init__(self, path: str, known: int = 500_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known, self.most = _Known(self.library.model), known

    def encode(self, text: str) -> bytes:
        """The ids of the whole text, without added tokens, as little-endian unsigned 32-bit integers."""
        if UNUSUAL.search(text) or any(s in text for s in self.special):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return b"".join(i.to_bytes(4, "little") for i in ids)
        if len(self.known) > self.most:
            self.known.turn()
        return b"".join(map(self.known.__getitem__, SPLIT.findall(text)))


_loaded: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """One encoder for each file and Python worker."""
    worker_cache.enter("byte_bpe")
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
        worker_cache.hold("byte_bpe", _loaded.clear)
    return _loaded[path]
