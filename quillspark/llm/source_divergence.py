"""How far the word use of sources lies apart, by a two-pass vocabulary automaton and sparse postings.

Pass 1 reads the documents into chunks of one language, bounded in bytes, and counts for each chunk in how
many of its documents each term stands; summed over chunks these are exact document frequencies, which
choose the kept terms. Pass 2 brings each chunk together with the kept terms that it holds (they meet by the
chunk's number), builds an Aho-Corasick automaton of them, each padded with a delimiter on both sides, and
counts their occurrences in one scan of the chunk's texts, source by source. So a task never holds more of the
vocabulary than its own chunk has, however large the vocabulary grows, and nothing is broadcast.

The counts are postings: for a term the sources in which it stands, S at most. All that follows is exact integer
arithmetic on them. The sum over all kept terms of |p_s - p_t| for two sources takes four parts, with b the p of
a source for a count of 0:

    V * |b_s - b_t|                                              as if no term stood in either
    + sum over terms of s of |p_s - b_t| - |b_s - b_t|           from a histogram of the p of s
    + the same with s and t exchanged
    + sum over terms of both of |p_s - p_t| - |p_s - b_t| - |b_s - p_t| + |b_s - b_t|

so only terms that two sources share make work for that pair. Pairs are rows because all ranks are wanted:
their number is that of the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hot_keys, workspace
from .word_chunks import squeeze, stretch

#: Terms are runs of letters A-Z, a-z and characters from U+0080 on; A-Z are lower-cased, other bytes are delimiters.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
CHUNK_BYTES = 12_000_000
CHUNKS = "chunk long, lang string, sources array<string>, sizes array<long>, texts binary, terms array<string>, doc_counts array<int>"
_ARROW = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("sources", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary()), ("terms", pa.list_(pa.string())), ("doc_counts", pa.list_(pa.int32()))])


class _Open:
    """A chunk that is being filled: folded texts by source, and documents by term."""

    def __init__(self):
        self.texts: dict[str, list[bytes]] = {}
        self.docs: Counter = Counter()
        self.size = 0

    def add(self, source: str, text: bytes) -> int:
        folded = text.translate(FOLD)
        self.texts.setdefault(source, []).append(folded)
        self.docs.update(set(folded.split()))
        self.size += len(folded) + 1
        return len(folded) + 1

    def row(self, number: int, lang: str) -> pa.RecordBatch:
        parts = [b" ".join(self.texts[s]) for s in self.texts]
        row = {"chunk": number, "lang": lang, "sources": list(self.texts), "sizes": [len(p) for p in parts], "texts": squeeze(b"".join(parts)), "terms": [t.decode() for t in self.docs], "doc_counts": list(self.docs.values())}
        return pa.RecordBatch.from_pylist([row], _ARROW)


def chunked(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of docs, written and read back. Null text, lang and source count as empty strings.

    A task fills one chunk for each language and closes the largest when all together pass three times chunk_bytes.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filling: dict[str, _Open] = {}
        number, total = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                chunk = filling.setdefault(lang, _Open())
                total += chunk.add(source, text.as_py())
                full = [lang] if chunk.size >= chunk_bytes else [max(filling, key=lambda x: filling[x].size)] if total > 3 * chunk_bytes else []
                for done in full:
                    total -= filling[done].size
                    yield filling.pop(done).row(number, done)
                    number += 1
        for lang, chunk in filling.items():
            yield chunk.row(number, lang)
            number += 1

    text = lambda c: F.coalesce(F.col(c), F.lit("")).cast("string")
    return workspace.staged(docs.select(text(lang_col), text(source_col), text(text_col)).mapInArrow(read, CHUNKS), "divergence-chunks")


def kept_terms(chunks: DataFrame, min_docs: int = 30) -> DataFrame:
    """(chunk, lang, term) for each chunk and each of its terms that min_docs documents of the language hold.

    One exchange by term counts and answers: a term has at most one row for each chunk, so none is hot.
    """
    terms = chunks.select("chunk", "lang", F.explode(F.arrays_zip("terms", "doc_counts")).alias("t")).select("chunk", "lang", F.col("t.terms").alias("term"), F.col("t.doc_counts").alias("docs"))
    total = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return terms.withColumn("total", total).where(F.col("total") >= min_docs).select("chunk", "lang", "term")


def occurrences(chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n): how often each kept term stands in the texts of a source; only n > 0.

    A chunk gives one row for each term, with its counts by source, so names of languages and terms cross the
    exchange once for a chunk; the sums by source need no other exchange.
    """
    entry = pa.struct([("source", pa.string()), ("n", pa.int64())])
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("entries", pa.list_(entry))])

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        import ahocorasick

        terms = right.column("term").to_pylist()
        if not terms:
            return schema.empty_table()
        automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            automaton.add_word(f" {term} ", i)
        automaton.make_automaton()
        (row,) = left.to_pylist()
        texts, start, found = stretch(row["texts"]), 0, []
        for k, size in enumerate(row["sizes"]):
            text = f" {texts[start : start + size].decode()} "
            start += size
            which, many = np.unique(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64), return_counts=True)
            found.append(np.stack([which, np.full(len(which), k), many]))
        which, source, many = np.concatenate(found, axis=1)
        order = np.argsort(which, kind="stable")
        term, ends = np.unique(which[order], return_index=True)
        entries = pa.StructArray.from_arrays([pa.array(row["sources"], pa.string()).take(pa.array(source[order])), pa.array(many[order])], fields=list(entry))
        lists = pa.ListArray.from_arrays(pa.array(np.append(ends, len(order)), pa.int32()), entries)
        return pa.table([pa.array([row["lang"]] * len(term), pa.string()), pa.array(terms, pa.string()).take(pa.array(term)), lists], schema=schema)

    texts = chunks.select("chunk", "lang", "sources", "sizes", "texts")
    found = texts.groupBy("chunk").cogroup(kept.select("chunk", "term").groupBy("chunk")).applyInArrow(scan, "lang string, term string, entries array<struct<source: string, n: bigint>>")
    each = found.repartition("lang", "term").select("lang", "term", F.explode("entries").alias("e")).select("lang", "term", "e.source", "e.n")
    return workspace.staged(each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "divergence-counts")


def smoothed(n: Column, total: Column, terms: Column, alpha: int = 5, scale: int = 1_000_000_000) -> Column:
    """1 + floor(scale * (n + alpha) / (total + alpha * terms)) as a long, exact: decimals hold the product."""
    wide = lambda c: c.cast("decimal(18,0)")
    product, below = F.lit(scale).cast("decimal(10,0)") * wide(n + alpha), wide(total + alpha * terms)
    return F.lit(1).cast("long") + F.call_function("div", product, below)


def _shared_terms(postings: DataFrame, block: int = 256, held: int = 256) -> DataFrame:
    """(lang, source, item, value): the fourth part of the sum for each pair of sources that share terms, in partial sums.

    A task keeps matrices of block x block sources and hands them on when it holds too many.
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, dict[str, int]] = {}
        sums: dict[tuple[str, int, int], np.ndarray] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (lang, a, b), values in sums.items():
                names = np.array(list(numbers[lang]), object)
                i, j = np.nonzero(values)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(names[i + a * block], pa.string()), pa.array(names[j + b * block], pa.string()), pa.array(values[i, j])], schema=schema)
            sums.clear()

        for batch in batches:
            entries = batch.column(1).flatten()
            sources = entries.field("source").to_pylist()
            p, base = entries.field("p").to_numpy(), entries.field("base").to_numpy()
            start = 0
            for lang, size in zip(batch.column(0).to_pylist(), batch.column(1).value_lengths().to_pylist(), strict=True):
                mine, start = slice(start, start + size), start + size
                known = numbers.setdefault(lang, {})
                at = np.fromiter((known.setdefault(s, len(known)) for s in sources[mine]), np.int64, size)
                order = np.argsort(at)
                at, ps, bs = at[order], p[mine][order], base[mine][order]
                cuts = {k: slice(*np.searchsorted(at, (k * block, (k + 1) * block)).tolist()) for k in np.unique(at // block).tolist()}
                for x, s in cuts.items():
                    for y, t in cuts.items():
                        if (lang, x, y) not in sums:
                            if len(sums) >= held:
                                yield from hand_on()
                            sums[lang, x, y] = np.zeros((block, block), np.int64)
                        pi, bi, pj, bj = ps[s][:, None], bs[s][:, None], ps[t][None, :], bs[t][None, :]
                        sums[lang, x, y][np.ix_(at[s] - x * block, at[t] - y * block)] += abs(pi - pj) - abs(pi - bj) - abs(bi - pj) + abs(bi - bj)
                if len(numbers) + sum(map(len, numbers.values())) > held * block:
                    yield from hand_on()
                    numbers.clear()
        yield from hand_on()

    return postings.select("lang", "entries").mapInArrow(fold, "lang string, source string, item string, value long").where(F.col("source") != F.col("item"))


def _own_terms(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, source, item, value): the second and third part of the sum for all pairs of sources."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        p, many = left.column("p").to_numpy(), left.column("many").to_numpy()
        order = np.argsort(p)
        p, many = p[order], many[order]
        n, total = np.concatenate([[0], np.cumsum(many)]), np.concatenate([[0], np.cumsum(many * p)])
        own, other = right.column("base").to_numpy(), right.column("item_base").to_numpy()
        cut = np.searchsorted(p, other)
        value = other * n[cut] - total[cut] + (total[-1] - total[cut]) - other * (n[-1] - n[cut]) - n[-1] * abs(own - other)
        return pa.table([right.column("lang"), right.column("source"), right.column("item"), pa.array(value)], schema=schema)

    histogram = postings.select("lang", F.explode("entries").alias("e")).groupBy("lang", "e.source", "e.p").agg(F.count(F.lit(1)).alias("many"))
    one_way = histogram.groupBy("lang", "source").cogroup(pairs.groupBy("lang", "source")).applyInArrow(compare, "lang string, source string, item string, value long")
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return one_way.select("lang", F.explode(both).alias("w"), "value").select("lang", "w.source", "w.item", "value")


def source_totals(chunks: DataFrame, counts: DataFrame, alpha: int = 5, scale: int = 1_000_000_000) -> DataFrame:
    """Per source of a language: lang, source, total (occurrences of kept terms), lang_total, terms (V), base (p of a
    count of 0; null if V = 0). Sources without any term are there."""
    groups = chunks.select("lang", F.explode("sources").alias("source")).distinct()
    by_source = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    found = groups.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").fillna(0, ["total", "lang_total", "terms"])
    return found.withColumn("base", F.when(F.col("terms") > 0, smoothed(F.lit(0), F.col("total"), F.col("terms"), alpha, scale)))


def audit(docs: DataFrame, min_docs: int = 30, alpha: int = 5, scale: int = 1_000_000_000, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows lang, source, part, item, value, rank for every (lang, source) group.

    part `pair`: item is each other source of the language, value the sum over the language's kept terms of the
    absolute difference of the two sources' p. part `term`: item is a kept term that the source uses more than its
    language, value by how much, the first `top` of them. Ranks count from 1 by falling value, then by item.

    Null text, lang and source count as empty strings; a group of empty texts has its pairs; a language without
    kept terms has pairs of value 0 and no terms; a language with one source has no pairs. Rows that repeat an id
    count each. An empty table gives no rows. Other columns are not read.
    """
    chunks = chunked(docs, text_col, lang_col, source_col)
    counts = occurrences(chunks, kept_terms(chunks, min_docs))
    totals = workspace.staged(source_totals(chunks, counts, alpha, scale), "divergence-totals")
    known = hot_keys.attached(counts, totals, ["lang", "source"], F.col("term"))
    known = known.withColumn("p", smoothed(F.col("n"), F.col("total"), F.col("terms"), alpha, scale))
    postings = known.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.first("lang_total").alias("lang_total"), F.first("terms").alias("terms"), F.collect_list(F.struct("source", "p", "base")).alias("entries"))
    postings = workspace.staged(postings, "divergence-postings")

    q = smoothed(F.col("n"), F.col("lang_total"), F.col("terms"), alpha, scale)
    over = postings.select("lang", F.col("term").alias("item"), q.alias("q"), F.explode("entries").alias("e"))
    over = over.where(F.col("e.p") > F.col("q")).select("lang", "e.source", F.lit("term").alias("part"), "item", (F.col("e.p") - F.col("q")).alias("value"))

    # every two sources of a language, its sources dealt over salts
    other = totals.select("lang", F.col("source").alias("item"), F.col("base").alias("item_base"), F.explode(F.sequence(F.lit(0), F.lit(hot_keys.SALTS - 1))).alias("salt"))
    pairs = totals.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(hot_keys.SALTS)).cast("int")).join(other, ["lang", "salt"]).where(F.col("source") != F.col("item"))
    sums = pairs.select("lang", "source", "item", F.coalesce(F.col("terms") * F.abs(F.col("base") - F.col("item_base")), F.lit(0)).alias("value"))
    sums = sums.unionByName(_own_terms(postings, pairs.where("base IS NOT NULL").select("lang", "source", "base", "item", "item_base"))).unionByName(_shared_terms(postings))
    apart = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    return over.select("*", rank).where(F.col("rank") <= top).unionByName(apart.select("*", rank))
