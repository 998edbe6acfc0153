"""Documents into chunks: by headings, paragraphs, sentences; size optimisation; provenance ids.

Splitting and numbering are expressions. Greedy packing is an ordered fold over one document's parts,
done in the JVM with aggregate(), so a document is the largest unit that a task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text


def chunk_id(document: Column, index: Column, content: Column) -> Column:
    """First 16 hex digits of md5 of document, index and the first 50 characters."""
    return F.substring(F.md5(F.concat_ws("_", document.cast("string"), index.cast("string"), F.substring(content, 1, 50))), 1, 16)


def pack(parts: Column, most: int, gap: str = "\n\n") -> Column:
    """Consecutive parts joined while the result stays within `most` characters."""
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(s, x):
        joined = F.when(s["open"] == "", x).otherwise(F.concat(s["open"], F.lit(gap), x))
        return F.when(F.length(joined) <= most, F.struct(joined.alias("open"), s["done"].alias("done"))).otherwise(F.struct(x.alias("open"), F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])).alias("done")))

    return F.aggregate(parts, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def _numbered(docs: DataFrame, contents: Column, id_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("document_id"), contents.alias("c")).select("document_id", F.size("c").alias("total_chunks"), F.posexplode("c").alias("chunk_index", "content"))
    return rows.select(chunk_id(F.col("document_id"), F.col("chunk_index"), F.col("content")).alias("chunk_id"), "document_id", "chunk_index", "total_chunks", "content", F.size(text.blank_split(F.col("content"))).alias("word_count"), F.length("content").alias("char_count"))


def by_paragraph(docs: DataFrame, most: int = 1000, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    parts = F.filter(F.transform(F.split(F.col(content), r"\n\s*\n"), text.strip), lambda p: p != "")
    return _numbered(docs, pack(parts, most), id_col)


def by_line(docs: DataFrame, most: int = 1000, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    return _numbered(docs, pack(F.filter(F.split(F.col(content), "\n"), lambda p: text.strip(p) != ""), most, "\n"), id_col)


def by_sentence(docs: DataFrame, most: int = 1000, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    return _numbered(docs, pack(text.sentences(F.col(content)), most, " "), id_col)


def by_words(docs: DataFrame, size: int = 200, overlap: int = 20, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    """Windows of `size` words, each beginning size - overlap words after the one before."""
    step = size - overlap
    starts = lambda w: F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(step)), lambda i: (i == 0) | (i + overlap < F.size(w)))
    runs = text.let(text.blank_split(F.col(content)), lambda w: F.transform(starts(w), lambda i: F.array_join(F.slice(w, i + 1, size), " ")))
    return _numbered(docs, F.filter(runs, lambda x: x != ""), id_col)


def sections(docs: DataFrame, id_col: str = "doc_id", content: str = "content", keep_head: bool = True) -> DataFrame:
    """Markdown sections at headings of level 1 and 2: document_id, section_no, title, content. Text before the
    first heading is section 0 (left out unless keep_head)."""
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.col(content)), r"\n(#{1,2} )", "\n\u0001$1")
    rows = docs.select(F.col(id_col).alias("document_id"), F.posexplode(F.split(marked, "\u0001")).alias("section_no", "part"))
    title = F.regexp_extract("part", r"^#{1,2} +([^\n]*)", 1)
    out = rows.select("document_id", "section_no", text.strip(title).alias("title"), text.strip(F.regexp_replace("part", r"^#{1,2} +[^\n]*", "")).alias("content"))
    return out.where("content <> '' OR title <> ''") if keep_head else out.where("section_no > 0")


def by_similarity(docs: DataFrame, threshold: float = 0.1, least: int = 100, most: int = 1000, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    """Sentences joined until word overlap with the next falls below the threshold, within size bounds."""
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("last"), F.array().cast("array<string>").alias("done"))

    def step(s, x):
        w = F.array_distinct(text.words(x))
        size = F.length(s["open"])
        cut = (s["open"] != "") & ((size + F.length(x) + 1 > most) | ((size >= least) & (text.jaccard(s["last"], w) < threshold)))
        joined = F.when(s["open"] == "", x).otherwise(F.concat(s["open"], F.lit(" "), x))
        return F.when(cut, F.struct(x.alias("open"), w.alias("last"), F.array_append(s["done"], s["open"]).alias("done"))).otherwise(F.struct(joined.alias("open"), w.alias("last"), s["done"].alias("done")))

    return _numbered(docs, F.aggregate(text.sentences(F.col(content)), start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"]))), id_col)


def merge_small(chunks: DataFrame, least: int = 50, by: str = "document_id", order: str = "chunk_index") -> DataFrame:
    """Chunks below `least` words join the next of their document; a small rest joins the last."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("content")))), lambda p: p["content"])
    many = lambda t: F.size(text.blank_split(t))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(s, x):
        joined = F.when(s["open"] == "", x).otherwise(F.concat(s["open"], F.lit("\n\n"), x))
        return F.when(many(joined) >= least, F.struct(F.lit("").alias("open"), F.array_append(s["done"], joined).alias("done"))).otherwise(F.struct(joined.alias("open"), s["done"].alias("done")))

    def end(s):
        last = F.try_element_at(s["done"], F.lit(-1))
        return F.when(s["open"] == "", s["done"]).when(F.size(s["done"]) == 0, F.array(s["open"])).otherwise(F.array_append(F.slice(s["done"], 1, F.size(s["done"]) - 1), F.concat(last, F.lit("\n\n"), s["open"])))

    grouped = chunks.groupBy(by).agg(parts.alias("p")).select(by, F.aggregate("p", start, step, end).alias("c"))
    return grouped.select(F.col(by), F.posexplode("c").alias(order, "content")).withColumn("word_count", many(F.col("content")))
