"""Curating chunk tables: tags, read marks, libraries, validity, retention reports, fuzzy merges, entity indexes, citation links."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import entities, text
from quillspark.operators import dedup

#: Most tags of a chunk, longest tag, most citations of an artifact that become links, their confidence.
MOST_TAGS, LONGEST_TAG, MOST_LINKS, CONFIDENCE = 50, 32, 100, 0.9


def clean_tag(tag: str) -> str:
    """Lower-cased letters a-z and digits, at most 32; ValueError where none is left."""
    clean = re.sub("[^a-z0-9]", "", (tag or "").lower())[:LONGEST_TAG]
    if not clean:
        raise ValueError(f"tag {tag!r} has no letters a-z or digits")
    return clean


def add_tag(tags: Column, tag: str, where: Column | None = None) -> Column:
    """tags with the tag at their end, where the condition holds and they lack it; a 51st tag fails the job. Null counts as no tags."""
    clean, have = F.lit(clean_tag(tag)), F.coalesce(tags, F.array().cast("array<string>"))
    wanted = (F.lit(True) if where is None else F.coalesce(where, F.lit(False))) & ~F.array_contains(have, clean)
    full = F.raise_error(F.lit(f"a chunk already has {MOST_TAGS} tags (maximum)")).cast("array<string>")
    return F.when(~wanted, tags).when(F.size(have) >= MOST_TAGS, full).otherwise(F.array_append(have, clean))


def remove_tag(tags: Column, tag: str, where: Column | None = None) -> Column:
    """tags without the first place of the tag, where the condition holds; null stays null."""
    at = F.array_position(tags, F.lit(clean_tag(tag)))
    wanted = (F.lit(True) if where is None else F.coalesce(where, F.lit(False))) & (at > 0)
    return F.when(wanted, F.filter(tags, lambda x, i: i != at - 1)).otherwise(tags)


def all_tags(rows: DataFrame, tags: str = "tags") -> DataFrame:
    """Distinct tags in order."""
    return rows.select(F.explode(tags).alias("tag")).distinct().orderBy("tag")


def mark_read(is_read: Column, where: Column, read: bool = True) -> Column:
    return F.when(where, F.lit(read)).otherwise(F.coalesce(is_read, F.lit(False)))


def delete_library(rows: DataFrame, library: str, column: str = "library") -> DataFrame:
    """Rows of other libraries, and those without one."""
    return rows.where(~F.col(column).eqNullSafe(library))


def has_entity(found: Column, kind: str | None = None) -> Column:
    """Whether there are entities or, with a kind, one whose text holds it in any case."""
    some = F.coalesce(F.size(found) > 0, F.lit(False))
    return some if kind is None else F.coalesce(F.exists(found, lambda e: F.contains(F.upper(e), F.lit(kind.upper()))), F.lit(False))


def good_enough(score: Column, least: float) -> Column:
    return F.coalesce(score >= least, F.lit(False))


def valid_chunk(content: Column, least: int = 50, most: int = 10_000) -> Column:
    """A text of `least` to `most` characters that isn't all blanks."""
    return F.coalesce(F.length(content).between(least, most) & (text.strip(content) != ""), F.lit(False))


def validation_counts(rows: DataFrame, valid: Column) -> DataFrame:
    """One row: total_count, valid_count, invalid_count, validation_rate (0 without rows)."""
    total, good = F.count(F.lit(1)), F.count_if(valid)
    return rows.agg(total.alias("total_count"), good.alias("valid_count"), (total - good).alias("invalid_count"), F.when(total > 0, F.round(good / total, 6)).otherwise(0.0).alias("validation_rate"))


def retention(rows: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """What each filter of a chain leaves, from one pass: step, name, kept, removed (by this filter).

    Null counts as false. Without rows every count is 0.
    """
    met = [F.coalesce(f, F.lit(False)) for f in filters.values()]
    chains = [reduce(lambda a, b: a & b, met[: i + 1]) for i in range(len(met))]
    counts = rows.agg(F.count(F.lit(1)).alias("__all"), *[F.count_if(c).alias(f"__{i}") for i, c in enumerate(chains)])
    before = ["__all", *[f"__{i}" for i in range(len(met))]]
    steps = [F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("name"), F.col(f"__{i}").alias("kept"), (F.col(before[i]) - F.col(f"__{i}")).alias("removed")) for i, name in enumerate(filters)]
    return counts.select(F.inline(F.array(*steps)))


def fuzzy_merge(rows: DataFrame, threshold: float, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    """Rows in id order, each kept unless the Jaccard similarity of its words with those of a kept one reaches the threshold.

    Texts without words are no copies of anything. Returns id and kept_id (its own for kept rows).
    """
    sets = rows.select(F.col(id_col).alias("id"), F.array_distinct(text.blank_split(F.lower(F.coalesce(content, F.lit(""))))).alias("items"))
    return dedup.greedy_classes(sets, threshold)


def entity_index(mentions: DataFrame) -> DataFrame:
    """mentions (document, chunk, place, name, kind) -> an entity a row: key, canonical and kind of its first mention (by
    document, chunk, place), variations (spellings in order), numbers of documents, chunks and mentions.

    Mentions without a name are left out. Documents and chunks are counted, not listed: a frequent entity has too many for a row.
    """
    n = mentions.where("name IS NOT NULL").withColumn("n", entities.normalized(F.col("name"), F.col("kind"))).select("*", "n.key", "n.canonical")
    first = F.min_by(F.struct("canonical", "kind"), F.struct("document", "chunk", "place"))
    out = n.groupBy("key").agg(first.alias("f"), F.array_sort(F.collect_set("name")).alias("variations"), F.count_distinct("document").alias("documents"), F.count_distinct("document", "chunk").alias("chunks"), F.count(F.lit(1)).alias("mentions"))
    return out.select("key", "f.canonical", "f.kind", "variations", "documents", "chunks", "mentions")


def entity_statistics(index: DataFrame) -> DataFrame:
    """By kind: entities, mentions and mentions for each entity."""
    return index.groupBy("kind").agg(F.count(F.lit(1)).alias("entities"), F.sum("mentions").alias("total_mentions"), F.round(F.avg("mentions"), 6).alias("mentions_per_entity"))


def by_citation(citations: DataFrame, known: DataFrame) -> DataFrame:
    """citations (artifact, place, key, title, confidence) and known (citation_key, target) -> source, target, citation_key, confidence.

    The first 100 citations of an artifact count. The title stands in for a missing key, 0.9 for a missing confidence. Of several
    citations of one target the first stays; an artifact doesn't cite itself.
    """
    named = F.coalesce(F.nullif("key", F.lit("")), F.nullif("title", F.lit("")))
    c = citations.withColumn("__n", F.row_number().over(Window.partitionBy("artifact").orderBy("place"))).where(F.col("__n") <= MOST_LINKS)
    hits = c.select("artifact", "place", "confidence", named.alias("citation_key")).join(known.dropDuplicates(["citation_key"]), "citation_key").where("target <> artifact")
    first = F.min_by(F.struct("citation_key", F.coalesce("confidence", F.lit(CONFIDENCE)).alias("confidence")), "place")
    return hits.groupBy(F.col("artifact").alias("source"), "target").agg(first.alias("f")).select("source", "target", "f.citation_key", "f.confidence")


def all_links(links: DataFrame) -> DataFrame:
    """links (source, target) from both ends: artifact, direction (out or in), other."""
    ends = F.array(F.struct(F.col("source").alias("artifact"), F.lit("out").alias("direction"), F.col("target").alias("other")), F.struct(F.col("target").alias("artifact"), F.lit("in").alias("direction"), F.col("source").alias("other")))
    return links.select(F.inline(ends))


def chunk_topics(content: Column, topics: list[str]) -> Column:
    """Those topics, in their order, that the text holds in any case."""
    return F.array_compact(F.array(*[F.when(F.contains(F.lower(content), F.lit(t.lower())), F.lit(t)) for t in topics]).cast("array<string>"))


def publication_years(rows: DataFrame, date: str) -> DataFrame:
    """year and n for texts of dates that begin with four digits."""
    return rows.select(F.substring(date, 1, 4).alias("year")).where(F.col("year").rlike(r"\A[0-9]{4}\z")).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def half_precision(vector: Column) -> Column:
    """Components rounded to the 11 significant bits of a half-precision number, as floats: ties to even, beyond 65504 infinite."""

    def rounded(x: Column) -> Column:
        d = x.cast("double")
        exponent = F.greatest(F.floor(F.log2(F.abs(d))), F.lit(-14))
        step = F.pow(F.lit(2.0), exponent - 10)
        kept = F.rint(d / step) * step
        return F.when((d == 0) | F.isnan(d) | d.isNull(), d).when(F.abs(kept) >= 65520, F.signum(d) * F.lit(float("inf"))).otherwise(kept).cast("float")

    return F.transform(vector, rounded)
