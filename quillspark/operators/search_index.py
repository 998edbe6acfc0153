"""A keyword index in files: built once, after which a query reads the rows of its own terms.

Postings are sorted by term and chunk over as many files as their texts call for, a term that every chunk holds over many of
them, in numbered folders. A dictionary, sorted by term as well, has each term's document frequency and folders. So a
query looks up a few rows of the dictionary, prunes to its terms' folders and row groups, and counts and joins nothing:
a posting carries its chunk's lengths and the fields to filter by.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text

from .search import _query_terms, top

#: Text for which a file of postings is made.
FILE_BYTES = 64_000_000
MOST_FOLDERS = 4096


@dataclass
class KeywordIndex:
    postings: DataFrame  # bucket, term, id, row, tf, dl (search tokens), words (words of over two characters), fields
    terms: DataFrame  # term, df, first and last bucket
    totals: DataFrame  # one row: n chunks, avgdl
    known: dict = field(default_factory=dict)  # the totals, once read

    def total(self, name: str) -> float:
        if not self.known:
            self.known |= self.totals.first().asDict()
        return self.known[name]


def build(chunks: DataFrame, path: str, fields: dict[str, Column] | None = None, files: int | None = None, id_col: str = "doc_id", content: str = "content") -> None:
    """Write the index. fields: what predicates of searches may use, by name. Null content has no words; rows that
    repeat an id are chunks of their own, as for a scan.

    The texts are tokenised once; what is shuffled are distinct (chunk, term) pairs with counts. files: of postings, by
    default one for each 64 MB of text; they lie in 4096 folders at most, each with a range of terms.
    """
    stop = text.literal_array(text.SEARCH_STOPWORDS)
    names = list(fields or {})
    if files is None:
        size = chunks.agg(F.coalesce(F.sum(F.octet_length(content)), F.lit(0))).first()[0]
        files = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    each = -(-files // MOST_FOLDERS)
    rows = chunks.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), *[c.alias(n) for n, c in (fields or {}).items()], text.words(F.coalesce(F.col(content), F.lit(""))).alias("w"))

    def measured(w: Column) -> Column:
        kept = F.filter(w, lambda x: F.length(x) > 1)
        return F.struct(
            F.size(F.filter(w, lambda x: (F.length(x) > 1) & ~F.array_contains(stop, x))).alias("dl"),
            F.size(F.filter(w, lambda x: F.length(x) > 2)).alias("words"),
            kept.alias("kept"),
        )

    rows = rows.select("id", "row", *names, text.let(F.col("w"), measured).alias("m")).select("id", "row", *names, "m.*")
    kept = rows.select("id", "row", *names, "dl", "words", F.explode("kept").alias("term"))
    counted = kept.groupBy("id", "row", *names, "dl", "words", "term").agg(F.count(F.lit(1)).alias("tf"))
    dealt = counted.repartitionByRange(files, "term", "row").sortWithinPartitions("term", "row").withColumn("bucket", F.floor(F.spark_partition_id() / each).cast("int"))
    dealt.select("bucket", "term", "id", "row", "tf", "dl", "words", *names).write.partitionBy("bucket").parquet(f"{path}/postings")
    # the schema is stated, for an index without postings has no files
    written = chunks.sparkSession.read.schema(dealt.schema).parquet(f"{path}/postings")
    terms = written.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    terms.repartitionByRange(-(-files // 8), "term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    # chunks without a word count as well
    rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).coalesce(1).write.parquet(f"{path}/totals")


def load(spark: SparkSession, path: str) -> KeywordIndex:
    return KeywordIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/totals"))


def _matched(index: KeywordIndex, terms: list[str]) -> tuple[DataFrame, Column]:
    """Postings of the terms, from their folders only, and the df of a posting's term."""
    known = index.terms.where(F.col("term").isin(terms)).collect()  # a row for each term of the query
    buckets = sorted({b for r in known for b in range(r["first"], r["last"] + 1)})
    df = F.lit(0)
    for r in known:
        df = F.when(F.col("term") == r["term"], F.lit(r["df"])).otherwise(df)
    return index.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin([r["term"] for r in known])), df


def _nothing(index: KeywordIndex) -> DataFrame:
    return index.postings.select("id", F.lit(0.0).alias("score")).limit(0)


def bm25(index: KeywordIndex, query: str, top_k: int = 10, predicate: Column | None = None, k1: float = 1.5, b: float = 0.75, delta: float = 0.5) -> DataFrame:
    """As search.bm25, from the index: (id, score), best first, ties by id. The predicate, over the index's fields,
    acts before the cut; statistics are those of all chunks."""
    terms = _query_terms(query)
    if not terms:
        return _nothing(index)
    times = F.lit(0)
    for t in set(terms):
        times = F.when(F.col("term") == t, F.lit(terms.count(t))).otherwise(times)
    hits, df = _matched(index, sorted(set(terms)))
    tf, n, average = F.col("tf"), F.lit(index.total("n")), F.lit(index.total("avgdl"))
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    part = idf * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / average)) + delta) * times
    hits = hits if predicate is None else hits.where(predicate)
    return top(hits.groupBy("id", "row").agg(F.round(F.sum(part), 6).alias("score")).select("id", "score").where("score > 0"), top_k)


def tfidf(index: KeywordIndex, query: str, top_k: int = 10, predicate: Column | None = None) -> DataFrame:
    """As search.tfidf, from the index."""
    terms = sorted({w for w in re.findall(r"\w+", query.lower()) if len(w) > 2})
    if not terms:
        return _nothing(index)
    hits, df = _matched(index, terms)
    hits = hits if predicate is None else hits.where(predicate)
    part = F.col("tf") / F.col("words") * (1 + F.lit(index.total("n")) / (1 + df))
    return top(hits.groupBy("id", "row").agg(F.round(F.sum(part), 6).alias("score")).select("id", "score").where("score > 0"), top_k)
