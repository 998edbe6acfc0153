"""Corpus profiles, topics, entities, readability, sentiment and quality of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text

#: Words of the sentiment lexicon.
POSITIVE = """good great excellent amazing wonderful fantastic best better love loved happy joy pleased success successful win won
brilliant outstanding perfect beautiful nice awesome impressive positive beneficial advantage gain improve superior effective""".split()
NEGATIVE = """bad terrible horrible awful worst worse hate hated sad unhappy fail failed failure loss poor negative problem issue
wrong error mistake difficult hard impossible weak inferior ineffective harm damage""".split()
#: Words that show a transition.
TRANSITIONS = ["however", "therefore", "furthermore", "moreover", "additionally", "consequently", "nevertheless", "meanwhile", "specifically", "for example", "in addition", "as a result", "on the other hand"]


def profile(chunks: DataFrame) -> DataFrame:
    """One row: chunks, distinct sources, characters, mean size (floor), reading minutes at 1000 characters each."""
    total = F.coalesce(F.sum(F.length("content")), F.lit(0))
    return chunks.agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.countDistinct("source_file").alias("total_documents"),
        total.cast("long").alias("total_chars"),
        F.floor(total / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avg_chunk_size"),
        F.floor(F.floor(total / 5) / 200).alias("reading_minutes"),
    )


def _top(counted: DataFrame, k: int) -> DataFrame:
    return counted.orderBy(F.desc("n"), "term").limit(k)


def topics(chunks: DataFrame, k: int = 20) -> DataFrame:
    """The most frequent words of five characters or more that are no stop words or numbers: term, n."""
    stop = text.literal_array(text.CORPUS_STOPWORDS)
    w = F.filter(text.words(F.col("content")), lambda x: (F.length(x) >= 5) & ~F.array_contains(stop, x) & ~x.rlike("^[0-9]+$"))
    return _top(chunks.select(F.explode(w).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")), k)


def capitalised(chunks: DataFrame, k: int = 15) -> DataFrame:
    """The most frequent runs of capitalised words longer than three characters: term, n."""
    found = F.regexp_extract_all(F.col("content"), F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"), F.lit(1))
    return _top(chunks.select(F.explode(found).alias("term")).where("length(term) > 3").groupBy("term").agg(F.count(F.lit(1)).alias("n")), k)


def ngram_topics(chunks: DataFrame, stopwords: list[str], k: int = 10, least: int = 2) -> DataFrame:
    """Words, pairs and triples of words of three letters or more within a chunk: topic, frequency, weight (share of all terms)."""
    stop = text.literal_array(stopwords)
    w = F.regexp_extract_all(F.lower(F.col("content")), F.lit(r"(?<![\p{L}\p{N}_])([a-z]{3,})(?![\p{L}\p{N}_])"), F.lit(1))
    base = chunks.select(w.alias("w"))
    grams = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).otherwise(F.array().cast("array<array<string>>"))
    terms = base.select(F.explode(F.concat(grams(1), grams(2), grams(3))).alias("t")).where(~F.arrays_overlap("t", stop)).select(F.array_join("t", " ").alias("topic")).where("length(topic) >= 4")
    counted = terms.groupBy("topic").agg(F.count(F.lit(1)).alias("frequency"))
    total = counted.agg(F.sum("frequency").alias("total"))
    return counted.where(F.col("frequency") >= least).crossJoin(F.broadcast(total)).select("topic", "frequency", F.round(F.col("frequency") / F.col("total"), 9).alias("weight")).orderBy(F.desc("frequency"), "topic").limit(k)


def sentiment(content: Column) -> Column:
    """Struct of label and score (positive - negative words over all words, three digits)."""
    share = lambda w: F.when(F.size(w) > 0, (F.size(F.filter(w, _is_in(POSITIVE))) - F.size(F.filter(w, _is_in(NEGATIVE)))) / F.size(w)).otherwise(0.0)
    label = lambda x: F.when(x > 0.05, "positive").when(x < -0.05, "negative").otherwise("neutral")
    return text.let(text.let(text.blank_split(F.lower(content)), share), lambda x: F.struct(label(x).alias("sentiment"), F.round(x, 3).alias("sentiment_score")))


def _is_in(words: list[str]):
    table = text.literal_array(words)
    return lambda x: F.array_contains(table, x)


def readability(chunks: DataFrame, id_col: str = "doc_id", digits: int = 2) -> DataFrame:
    """Per chunk: words, sentences, syllables, complex words and six indices, over whole texts of letters a-z."""
    w = F.regexp_extract_all(F.lower(F.col("content")), F.lit(r"\b([a-z]+)\b"), F.lit(1))
    parts = F.filter(F.split(F.col("content"), r"[.!?]+\s*"), lambda s: text.strip(s) != "")
    base = chunks.select(F.col(id_col), F.length("content").alias("chars"), w.alias("w"), F.size(parts).alias("sentences"))
    base = base.withColumn("syl", F.transform("w", lambda x: text.syllables(x, guard=False)))
    n = base.select(id_col, "chars", "sentences", F.size("w").alias("words"), F.aggregate("syl", F.lit(0), lambda s, x: s + x).alias("syllables"), F.size(F.filter("syl", lambda x: x >= 3)).alias("complex_words"), F.size(F.array_distinct("w")).alias("distinct_words"))
    ok = (F.col("words") > 0) & (F.col("sentences") > 0)
    per_sentence, per_word = F.col("words") / F.col("sentences"), F.col("syllables") / F.col("words")
    floor0 = lambda x: F.greatest(F.lit(0.0), x)
    ease = F.least(F.lit(100.0), floor0(206.835 - 1.015 * per_sentence - 84.6 * per_word))
    columns = {
        "flesch_ease": ease,
        "kincaid_grade": floor0(0.39 * per_sentence + 11.8 * per_word - 15.59),
        "gunning_fog": 0.4 * (per_sentence + 100 * (F.col("complex_words") / F.col("words"))),
        "smog": 1.0430 * F.sqrt(F.col("complex_words") * (30 / F.col("sentences"))) + 3.1291,
        "ari": floor0(4.71 * (F.col("chars") / F.col("words")) + 0.5 * per_sentence - 21.43),
        "coleman_liau": floor0(0.0588 * (F.col("chars") / F.col("words") * 100) - 0.296 * (F.col("sentences") / F.col("words") * 100) - 15.8),
    }
    level = F.lit("very_difficult")
    for least, name in ((30, "difficult"), (50, "fairly_difficult"), (60, "standard"), (70, "fairly_easy"), (80, "easy"), (90, "very_easy")):
        level = F.when(ease >= least, name).otherwise(level)
    return n.select(id_col, "words", "sentences", "syllables", "complex_words", F.when(F.col("words") > 0, F.round(F.col("distinct_words") / F.col("words"), 6)).otherwise(0.0).alias("type_token_ratio"), *[F.when(ok, F.round(c, digits)).otherwise(0.0).alias(name) for name, c in columns.items()], F.when(ok, level).otherwise("standard").alias("level"))


def quality(content: Column) -> Column:
    """Struct of coherence, completeness, density, readability and their weighted sum (0.3, 0.3, 0.2, 0.2)."""
    shielded = F.regexp_replace(content, r"\b(Mr|Mrs|Ms|Dr|Prof|Inc|Ltd|Jr|Sr|vs)\.", "$1\u0002")
    shielded = F.regexp_replace(shielded, r"([0-9])\.([0-9])", "$1\u0002$2")
    parts = F.transform(text.sentences(shielded), lambda x: F.replace(x, F.lit("\u0002"), F.lit(".")))
    linked = F.greatest(*[F.contains(F.lower(content), F.lit(t)) for t in TRANSITIONS])
    stop = text.literal_array(text.QUALITY_STOPWORDS)

    def parts_of(s, w):
        n = F.size(s)
        share = lambda test: F.size(F.filter(s, test)) / n
        base = share(lambda x: x.rlike(r"^\p{Lu}")) * share(lambda x: x.rlike("[.!?]$"))
        full = F.aggregate(s, F.lit(0.0), lambda t, x: t + F.when(F.size(text.blank_split(x)) >= 3, 1.0).when(x.rlike("[.!?]$"), 0.5).otherwise(0.0))
        syl = F.aggregate(w, F.lit(0), lambda t, x: t + text.syllables(x))
        return F.struct(
            F.when(n > 0, F.least(F.lit(1.0), base * F.when(linked, 1.1).otherwise(1.0))).otherwise(0.0).alias("coherence"),
            F.when(n > 0, F.least(F.lit(1.0), full / n)).otherwise(0.0).alias("completeness"),
            (F.size(F.filter(w, lambda x: ~F.array_contains(stop, x))) / F.size(w)).alias("dense"),
            F.when((n > 0) & (F.size(w) > 0), (206.835 - 1.015 * (F.size(w) / n) - 84.6 * (syl / F.size(w)))).alias("flesch"),
        )

    def scores(p):
        density = F.when(p["dense"].isNull(), 0.0).when(p["dense"] < 0.4, p["dense"] / 0.4 * 0.5).when(p["dense"] > 0.7, 1.0).otherwise(0.5 + (p["dense"] - 0.4) / 0.3 * 0.5)
        readable = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), p["flesch"])) / 100, F.lit(0.0))
        readable = F.when(p["flesch"].isNull(), 0.0).otherwise(readable)
        total = 0.3 * p["coherence"] + 0.3 * p["completeness"] + 0.2 * density + 0.2 * readable
        return F.struct(*[F.round(c, 6).alias(name) for name, c in (("coherence", p["coherence"]), ("completeness", p["completeness"]), ("density", density), ("readability", readable), ("quality", total))])

    w = text.words(content)
    dense_safe = lambda s, w: F.when(F.size(w) > 0, parts_of(s, w))
    empty = F.struct(*[F.lit(0.0).alias(n) for n in ("coherence", "completeness", "density", "readability", "quality")])
    return text.let(parts, lambda s: text.let(w, lambda v: F.when(F.size(v) > 0, text.let(dense_safe(s, v), scores)).otherwise(empty)))


def facets(rows: DataFrame, columns: list[str], top: int = 20) -> DataFrame:
    """facet, value, n: the most frequent values of each column."""
    long = rows.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])).alias("facet", "value")).where("value IS NOT NULL")
    counted = long.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("__r", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))).where(F.col("__r") <= top).drop("__r")


def missing_years(rows: DataFrame, column: str) -> DataFrame:
    """Years between the first and the last that have no row."""
    years = rows.select(F.year(column).alias("year")).where("year IS NOT NULL").distinct()
    span = years.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a IS NOT NULL")
    return span.select(F.explode(F.sequence("a", "b")).alias("year")).join(years, "year", "left_anti")


def cooccurrence(mentions: DataFrame) -> DataFrame:
    """mentions (chunk, entity) -> a, b (a < b), chunks that hold both."""
    m = mentions.distinct()
    x, y = m.alias("x"), m.alias("y")
    return x.join(y, (F.col("x.chunk") == F.col("y.chunk")) & (F.col("x.entity") < F.col("y.entity"))).groupBy(F.col("x.entity").alias("a"), F.col("y.entity").alias("b")).agg(F.count(F.lit(1)).alias("chunks"))


def entity_profiles(mentions: DataFrame) -> DataFrame:
    """mentions (entity, variation, document, chunk) -> profile by entity."""
    return mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("document").alias("documents"), F.countDistinct("chunk").alias("chunks"), F.array_sort(F.collect_set("variation")).alias("variations"))


def cross_domain(mentions: DataFrame, least: int = 2) -> DataFrame:
    """Entities seen at least `least` times and in more than one domain."""
    return mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("domain")).alias("domains")).where((F.col("n") >= least) & (F.size("domains") > 1))
