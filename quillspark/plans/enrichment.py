"""Queries: row enrichment and staged pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import enrich, pipeline
from quillspark.schema import chunks, table
from quillspark.sources import adapters

from .base import query


@query("chunk_metadata", r"SELECT doc_id, len(regexp_extract_all(text, 'https?://[^\s<>\x22{}|\\^`\[\]]+')) AS urls, len(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS emails, len(string_split(text, E'\n\n')) AS paragraphs FROM documents")
def chunk_metadata(spark, d):
    m = chunks(spark, d).select("doc_id", *enrich.metadata(F.col("content")))
    return m.select("doc_id", F.size("urls").cast("long").alias("urls"), F.size("emails").cast("long").alias("emails"), F.col("paragraph_count").cast("long").alias("paragraphs"))


@query("element_types", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Code' WHEN 1 THEN 'Table' WHEN 2 THEN 'Image' WHEN 3 THEN 'ListItem' WHEN 4 THEN 'Title' ELSE 'NarrativeText' END AS kind FROM part")
def element_types(spark, d):
    c = F.expr("CASE p_partkey % 6 WHEN 0 THEN 'def run(x)' WHEN 1 THEN '|a|b|' WHEN 2 THEN 'see [Figure 3]' WHEN 3 THEN '- item' WHEN 4 THEN 'A Short Title' ELSE 'this is plain. text, with points.' END")
    return table(spark, d, "part").select("p_partkey", enrich.element_type(c).alias("kind"))


@query("event_techniques", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN ['T1136'] WHEN 1 THEN ['T1078', 'T1110'] ELSE [] END AS techniques FROM events")
def event_techniques(spark, d):
    e = F.expr("CASE event_id % 3 WHEN 0 THEN 'CreateUser' WHEN 1 THEN 'login with password' ELSE event_type END")
    return table(spark, d, "events").select("event_id", enrich.techniques(e).alias("techniques"))


CLAIMS = "CASE p_size % 6 WHEN 0 THEN 'Prices never rise every single year here' WHEN 1 THEN 'prices FALL every single year here now' WHEN 2 THEN 'prices rise every single year without end' WHEN 3 THEN 'prices fall every single year missing here' WHEN 4 THEN p_name ELSE 'prices rise every single year here' END"
CLAIMS_SQL = f"""
WITH c AS (SELECT p_partkey, list_distinct(string_split('prices rise every single year here', ' ')) AS x, list_distinct(string_split(lower({CLAIMS}), ' ')) AS y FROM part),
s AS (SELECT p_partkey, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) AS s,
             list_has_any(x, ['not', 'no', 'never', 'without', 'missing', 'lacks']) <> list_has_any(y, ['not', 'no', 'never', 'without', 'missing', 'lacks']) AS negated,
             (list_contains(x, 'rise') AND list_contains(y, 'fall')) OR (list_contains(x, 'fall') AND list_contains(y, 'rise')) AS opposite FROM c),
r AS (SELECT p_partkey, s, CASE WHEN s >= 0.5 THEN round(s * (CASE WHEN negated THEN 0.3 ELSE 0 END + CASE WHEN opposite THEN 0.2 ELSE 0 END), 6) ELSE 0.0 END::DOUBLE AS score FROM s)
SELECT p_partkey, score, CASE WHEN score >= 0.2 THEN 'REFUTES' WHEN s >= 0.5 THEN 'SUPPORTS' ELSE 'NEUTRAL' END AS support FROM r
"""


@query("contradictions", CLAIMS_SQL)
def contradictions(spark, d):
    a, b = F.lit("prices rise every single year here"), F.expr(CLAIMS)
    return table(spark, d, "part").select("p_partkey", enrich.contradiction(a, b, gate=0.5).alias("score"), enrich.support(a, b, refute=0.2, gate=0.5).alias("support"))


@query("extractive_summary")
def summaries(spark, d):
    return enrich.extract(chunks(spark, d))


@query("cloze_cards", "SELECT p_partkey, 'It weighs ____ tons.' AS question, p_size::VARCHAR AS answer FROM part")
def cloze(spark, d):
    c = enrich.clozes(F.expr("concat('No number. It weighs ', p_size, ' tons.')"))
    return table(spark, d, "part").select("p_partkey", F.explode(c).alias("c")).select("p_partkey", "c.question", "c.answer")


@query(
    "template_questions",
    r"""
WITH d AS (SELECT doc_id, text || ' Part ' || lang || ' is a test. The ' || source || ' Word was the end; Delta Force are an ' || lang || ' game' AS t FROM documents)
SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(t, '\b([A-Z][a-z]+(?: [A-Z][a-z]+)*) (?:is|are|was|were) (?:an?|the) ', 1), lambda x: 'What is ' || x || '?'))) AS questions FROM d WHERE t IS NOT NULL""",
)
def template_questions(spark, d):
    """Questions about every document, to whose text a few definitions are added."""
    more = [F.lit(" Part "), F.col("library"), F.lit(" is a test. The "), F.col("source_file"), F.lit(" Word was the end; Delta Force are an "), F.col("library"), F.lit(" game")]
    rows = chunks(spark, d).withColumn("content", F.concat("content", *more)).where("content IS NOT NULL")
    return rows.select("doc_id", F.array_sort(enrich.questions(F.col("content"))).alias("questions"))


@query("answer_grounding", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS share FROM part")
def grounding(spark, d):
    return table(spark, d, "part").select("p_partkey", enrich.grounding(F.when(F.col("p_size") % 2 == 0, "old mills").otherwise("old barns"), F.lit("there were old mills")).alias("share"))


@query("hashing_vectors")
def hashing(spark, d):
    return chunks(spark, d).select("doc_id", adapters.hashing_vector(text.search_tokens(F.col("content")), 64).alias("vector"))


@query("staged_pipeline", "SELECT lang AS library, count(*) AS n, sum(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')))::BIGINT AS words FROM documents WHERE length(text) >= 100 GROUP BY 1")
def staged(spark, d):
    stages = [
        pipeline.Stage("long enough", lambda df: df.where(F.length("content") >= 100), ("content",)),
        pipeline.Stage("count words", lambda df: df.withColumn("words", F.size(text.words(F.col("content")))), ("content",), ("words",)),
        pipeline.Stage("by library", lambda df: df.groupBy("library").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words")), ("library", "words"), ("n",)),
    ]
    return pipeline.run(chunks(spark, d), stages)


@query("incremental_run", "SELECT (SELECT count(*) FROM documents WHERE doc_id % 5 <= 1) AS processed, (SELECT count(*) FROM documents) AS known")
def incremental_run(spark, d):
    files = chunks(spark, d).select(F.col("doc_id").alias("path"), F.sha2("content", 256).alias("hash"))
    old = files.where("path % 5 <> 0").withColumn("hash", F.when(F.col("path") % 5 == 1, F.lit("x")).otherwise(F.col("hash")))
    done, manifest = pipeline.incremental(files, old, lambda df: df)
    return done.agg(F.count(F.lit(1)).alias("processed")).crossJoin(manifest.agg(F.count(F.lit(1)).alias("known")))
