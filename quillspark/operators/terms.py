"""Terms of a subject domain in texts, with their places.

One Aho-Corasick automaton holds the literals of all patterns. It is built on the driver from the pattern table, which
bounds its size, and goes to each task once. A text is read through it once; a pattern is then tried only where one of
its heads stands, or only if one of its anchors stands anywhere, and a text without any costs one scan.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.term_patterns import TABLE, TOLD, TermPattern

TERM = "struct<start: int, end: int, term: string, domain: string, category: string, confidence: double>"
#: Characters that match a letter when case is ignored although they are no capital of it.
_LIKE = {0x131: "i", 0x130: "i", 0x17F: "s", 0x212A: "k"}


class _Fold(dict):
    """One character for each, so places stay: capitals become small letters."""

    def __missing__(self, code):
        small = _LIKE.get(code) or chr(code).lower()
        self[code] = found = small if len(small) == 1 else chr(code)
        return found


class Finder:
    """The patterns of a table, with the automaton of their literals."""

    def __init__(self, table: Sequence[TermPattern] = TABLE):
        self.table = [(p, re.compile(p.pattern, re.IGNORECASE)) for p in table]
        self.fold = _Fold()
        self.literals: dict[str, list[tuple[int, bool]]] = defaultdict(list)
        for i, p in enumerate(table):
            for words, is_head in ((p.heads, True), (p.anchors, False)):
                for w in words:
                    self.literals[w.translate(self.fold)].append((i, is_head))
        self.automaton = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def _places(self, text: str) -> tuple[dict[int, list[int]], set[int]]:
        """Where heads of a pattern begin; which patterns have an anchor."""
        if self.automaton is None and self.literals:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for word, uses in self.literals.items():
                self.automaton.add_word(word, (len(word), uses))
            self.automaton.make_automaton()
        heads, anchored = defaultdict(list), set()
        for end, (size, uses) in self.automaton.iter(text.translate(self.fold)) if self.literals else ():
            for i, is_head in uses:
                if is_head:
                    heads[i].append(end + 1 - size)
                else:
                    anchored.add(i)
        return heads, anchored

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(pattern, start, end) of all matches, pattern by pattern: those that a search with each pattern finds."""
        heads, anchored = self._places(text)
        out = []
        for i, (p, regex) in enumerate(self.table):
            if p.heads:
                last = 0
                for at in sorted(set(heads[i])):
                    if at >= last and (m := regex.match(text, at)):
                        out.append((i, *m.span()))
                        last = m.end()
            elif not p.anchors or i in anchored:
                out += [(i, *m.span()) for m in regex.finditer(text)]
        return out

    def domain(self, found: list[tuple[int, int, int]]) -> str:
        """The domain with most matches, of those that can be told; `general` without any."""
        counts = dict.fromkeys(TOLD, 0)
        for i, _, _ in found:
            if self.table[i][0].domain in counts:
                counts[self.table[i][0].domain] += 1
        best = max(counts, key=counts.get)
        return best if counts[best] else "general"

    def terms(self, text: str | None, domain: str | None, most: int | None) -> list[tuple]:
        if not text or not text.strip():
            return []
        found = self.matches(text)
        domain = domain or self.domain(found)
        spans: dict[tuple[int, int], TermPattern] = {}
        for wanted in dict.fromkeys((domain, "general")):  # the domain's patterns come first
            for i, a, b in found:
                p = self.table[i][0]
                if p.domain == wanted and ((a, b) not in spans or p.confidence > spans[a, b].confidence):
                    spans[a, b] = p
        best = sorted(spans.items(), key=lambda x: -x[1].confidence)
        return [(a, b, text[a:b], p.domain, p.category, p.confidence) for (a, b), p in best[:most]]


def _run(finder: Finder, make: Callable[[Finder, str | None], object]):
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "made": [make(finder, t) for t in pdf["text"]]})

    return run


def find_terms(docs: DataFrame, domain: str | None = None, max_terms: int | None = 20, id_col: str = "doc_id", text_col: str = "content", table: Sequence[TermPattern] = TABLE) -> DataFrame:
    """id, rank, start, end, term, domain, category, confidence of each text's terms; places are code points.

    domain None: the text's own, as domains() tells it. Terms of the domain and general ones count; each span once,
    with its best confidence, the first pattern at ties. Best confidence first (rank from 0), then in the order of
    patterns and places. max_terms None: all of them. Null and blank texts have no terms.
    """
    make = lambda finder, text: finder.terms(text, domain, max_terms)
    kind = dict(docs.dtypes)[id_col]
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(_run(Finder(table), make), f"id {kind}, made array<{TERM}>")
    return found.select(F.col("id").alias(id_col), F.posexplode("made").alias("rank", "t")).select(id_col, "rank", "t.*")


def domains(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content", table: Sequence[TermPattern] = TABLE) -> DataFrame:
    """id and domain of each text: history, science or psychology by most matches (ties: in this order), else general."""
    make = lambda finder, text: finder.domain(finder.matches(text or ""))
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(_run(Finder(table), make), f"id {kind}, made string").toDF(id_col, "domain")


def term_counts(found: DataFrame) -> DataFrame:
    """domain, category, term (lower case) with its number and the best confidence, over all texts."""
    return found.groupBy("domain", "category", F.lower("term").alias("term")).agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))
