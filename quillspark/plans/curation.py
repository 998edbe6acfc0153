"""Queries: tags, validity, retention, entity names and indexes, citation links, expanded and multi-vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import entities, refiners, text, vectors
from quillspark.operators import curation, query_lang, search, search_index
from quillspark.schema import chunks, table
from quillspark.sources import scratch

from .base import query
from .retrieval import _vector, keyword_index

TAGS = "[left(regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g'), 32), left(regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g'), 32)]"


def _tagged(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", F.array(text.sanitize_tag(F.col("p_brand")), text.sanitize_tag(F.col("p_type"))).alias("tags"))


@query("tag_added", f"SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND NOT list_contains(t, 'brand13') THEN list_append(t, 'brand13') ELSE t END AS tags FROM (SELECT p_partkey, p_size, {TAGS} AS t FROM part)")
def tag_added(spark, d):
    return _tagged(spark, d).select("p_partkey", curation.add_tag(F.col("tags"), "Brand #13!", F.col("p_size") % 2 == 0).alias("tags"))


@query("tag_removed", f"SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN list_filter(t, lambda x: x <> 'brand13') ELSE t END AS tags FROM (SELECT p_partkey, p_size, {TAGS} AS t FROM part)")
def tag_removed(spark, d):
    return _tagged(spark, d).select("p_partkey", curation.remove_tag(F.col("tags"), "Brand #13", F.col("p_size") % 2 == 0).alias("tags"))


@query("tags_all", f"SELECT DISTINCT unnest({TAGS}) AS tag FROM part ORDER BY 1")
def tags_all(spark, d):
    return curation.all_tags(_tagged(spark, d))


@query("marked_read", "SELECT doc_id, (doc_id % 3 = 0 OR lang = 'de') AS is_read FROM documents")
def marked_read(spark, d):
    return chunks(spark, d).select("doc_id", curation.mark_read(F.col("doc_id") % 3 == 0, F.col("library") == "de").alias("is_read"))


@query("library_deleted", "SELECT doc_id, lang AS library FROM documents WHERE lang IS DISTINCT FROM 'de'")
def library_deleted(spark, d):
    return curation.delete_library(chunks(spark, d), "de").select("doc_id", "library")


@query("filter_entities", "SELECT p_partkey FROM part WHERE p_size % 3 <> 0 AND contains(upper(p_type), 'PROMO')")
def filter_entities(spark, d):
    found = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("p_name", "p_type"))
    rows = table(spark, d, "part").withColumn("entities", found)
    return rows.where(curation.has_entity(F.col("entities")) & curation.has_entity(F.slice("entities", 2, 1), "Promo")).select("p_partkey")


@query("filter_quality", "SELECT event_id FROM events WHERE value >= 10.0")
def filter_quality(spark, d):
    return table(spark, d, "events").where(curation.good_enough(F.col("value"), 10.0)).select("event_id")


VALID = r"coalesce(length(text) BETWEEN 50 AND 10000 AND regexp_replace(text, '\s+', '', 'g') <> '', false)"


@query("filter_valid", f"SELECT doc_id FROM documents WHERE {VALID}")
def filter_valid(spark, d):
    return chunks(spark, d).where(curation.valid_chunk(F.col("content"))).select("doc_id")


@query("validation_counts", f"SELECT count(*) AS total_count, count_if({VALID}) AS valid_count, count(*) - count_if({VALID}) AS invalid_count, round(count_if({VALID}) / count(*), 6) AS validation_rate FROM documents")
def validation_counts(spark, d):
    return curation.validation_counts(chunks(spark, d), curation.valid_chunk(F.col("content")))


@query("filter_retention", "WITH c AS (SELECT count(*) AS n, count_if(n_chars >= 200) AS a, count_if(n_chars >= 200 AND lang = 'en') AS b FROM documents) SELECT 1 AS step, 'length' AS name, a AS kept, n - a AS removed FROM c UNION ALL SELECT 2, 'library', b, a - b FROM c")
def filter_retention(spark, d):
    return curation.retention(chunks(spark, d), {"length": F.col("char_count") >= 200, "library": F.col("library") == "en"})


@query("fuzzy_merge")
def fuzzy_merge(spark, d):
    return curation.fuzzy_merge(chunks(spark, d), 0.8)


NAMES = "CASE p_size % 6 WHEN 0 THEN concat(' ', p_brand, ' Corp. ') WHEN 1 THEN concat(p_brand, ' corporation') WHEN 2 THEN concat('Dr. ', p_type, ' ') WHEN 3 THEN 'mit' WHEN 4 THEN concat(p_brand, ' Co., Ltd.') ELSE p_name END"
KINDS = "CASE WHEN p_size % 6 IN (0, 1, 4) THEN 'ORG' WHEN p_size % 6 = 2 THEN 'Person' ELSE 'misc' END"
LONG = "CASE p_size % 6 WHEN 0 THEN p_brand || ' Corporation' WHEN 1 THEN p_brand || ' corporation' WHEN 2 THEN p_type WHEN 3 THEN 'Massachusetts Institute of Technology' WHEN 4 THEN p_brand || ' Company., Limited' ELSE p_name END"
KEY = "lower(CASE p_size % 6 WHEN 0 THEN p_brand WHEN 1 THEN p_brand WHEN 2 THEN p_type WHEN 3 THEN 'mit' WHEN 4 THEN p_brand || ' Company.,' ELSE p_name END)"


def _named(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", F.expr(NAMES).alias("name"), F.expr(KINDS).alias("kind"))


@query("entity_names", f"SELECT p_partkey, {KEY} AS key, {LONG} AS canonical FROM part")
def entity_names(spark, d):
    return _named(spark, d).select("p_partkey", entities.normalized(F.col("name"), F.col("kind")).alias("n")).select("p_partkey", "n.*")


@query("entity_link_keys", "SELECT p_partkey, lower(CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_brand WHEN 2 THEN p_name END) AS key FROM part")
def entity_link_keys(spark, d):
    name = F.expr("CASE p_size % 3 WHEN 0 THEN concat('  ', p_brand, ' Inc. ') WHEN 1 THEN concat(p_brand, ' Co Corporation') WHEN 2 THEN p_name END")
    # the endings go one after another in their order, so the company before the corporation goes as well
    return table(spark, d, "part").select("p_partkey", entities.link_key(name).alias("key"))


def _entity_index(spark, d):
    return curation.entity_index(_named(spark, d).select(F.col("p_size").alias("document"), F.col("p_partkey").alias("chunk"), F.lit(0).alias("place"), "name", "kind"))


@query("entity_index", f"SELECT key, min_by(canonical, document::BIGINT * 100000000 + chunk) AS canonical, min_by(kind, document::BIGINT * 100000000 + chunk) AS kind, list_sort(list_distinct(list(name))) AS variations, count(DISTINCT document) AS documents, count(DISTINCT chunk) AS chunks, count(*) AS mentions FROM (SELECT {KEY} AS key, {LONG} AS canonical, {KINDS} AS kind, {NAMES} AS name, p_size AS document, p_partkey AS chunk FROM part) GROUP BY 1")
def entity_index(spark, d):
    return _entity_index(spark, d)


@query("entity_statistics", f"WITH i AS (SELECT {KEY} AS key, min_by({KINDS}, p_size::BIGINT * 100000000 + p_partkey) AS kind, count(*) AS n FROM part GROUP BY 1) SELECT kind, count(*) AS entities, sum(n)::BIGINT AS total_mentions, round(avg(n), 6) AS mentions_per_entity FROM i GROUP BY 1")
def entity_statistics(spark, d):
    return curation.entity_statistics(_entity_index(spark, d))


def _citations(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("artifact"), F.col("l_linenumber").alias("place"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("k"), F.col("l_suppkey"))).otherwise("").alias("key"), F.concat(F.lit("t"), F.col("l_suppkey")).alias("title"), F.when(F.col("l_linenumber") == 2, F.lit(0.5)).alias("confidence"))
    s = table(spark, d, "supplier")
    return curation.by_citation(c, s.select(F.explode(F.array(F.concat(F.lit("k"), "s_suppkey"), F.concat(F.lit("t"), "s_suppkey"))).alias("citation_key"), F.col("s_suppkey").alias("target")))


@query("links_by_citation", "WITH c AS (SELECT l_orderkey AS source, l_suppkey AS target, CASE WHEN l_linenumber % 2 = 0 THEN 'k' ELSE 't' END || l_suppkey AS citation_key, CASE WHEN l_linenumber = 2 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence, l_linenumber AS place FROM lineitem WHERE l_orderkey <> l_suppkey) SELECT source, target, citation_key, confidence FROM c QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY place) = 1")
def links_by_citation(spark, d):
    return _citations(spark, d)


@query("links_both_ways", "WITH l AS (SELECT DISTINCT l_orderkey AS source, l_suppkey AS target FROM lineitem WHERE l_orderkey <> l_suppkey) SELECT source AS artifact, 'out' AS direction, target AS other FROM l UNION ALL SELECT target, 'in', source FROM l")
def links_both_ways(spark, d):
    return curation.all_links(_citations(spark, d))


TOPICS = ["ontion", "ering", "the"]


@query("chunk_topics", "WITH t AS (SELECT doc_id, list_filter(['ontion', 'ering', 'the'], lambda x: contains(lower(text), x)) AS topics FROM documents) SELECT doc_id, topics, topics[1] AS primary_topic FROM t WHERE topics IS NOT NULL")
def chunk_topics(spark, d):
    rows = chunks(spark, d).where("content IS NOT NULL").select("doc_id", curation.chunk_topics(F.col("content"), TOPICS).alias("topics"))
    return rows.select("doc_id", "topics", F.try_element_at("topics", F.lit(1)).alias("primary_topic"))


@query("publication_years", "SELECT year(o_orderdate)::VARCHAR AS year, count(*) AS n FROM orders GROUP BY 1")
def publication_years(spark, d):
    return curation.publication_years(table(spark, d, "orders").select(F.col("o_orderdate").cast("string").alias("date")), "date")


@query("identifiers_valid", "SELECT p_partkey, p_size % 3 = 0 AS cve, CASE WHEN p_size % 20 > 10 THEN 'CVSS score ' || (p_size % 20) || '.0 out of bounds (0.0-10.0)' END AS cvss, CASE WHEN p_size % 2 = 0 THEN [p_size || ' U.S. ' || p_partkey] ELSE [] END AS citations FROM part")
def identifiers_valid(spark, d):
    cve = F.expr("CASE p_size % 3 WHEN 0 THEN concat('CVE-2021-', 1000 + p_partkey % 9000) WHEN 1 THEN 'cve-2021-1234' END")
    text_ = F.expr("concat('see ', p_size, if(p_size % 2 = 0, ' U.S. ', ' US '), p_partkey)")
    return table(spark, d, "part").select("p_partkey", entities.cve_valid(cve).alias("cve"), entities.cvss_error((F.col("p_size") % 20).cast("double")).alias("cvss"), entities.legal_citations(text_).alias("citations"))


@query("refine_skills", "SELECT p_partkey, list_sort(list_distinct(CASE p_size % 3 WHEN 0 THEN ['Javascript', 'Kubernetes', p_brand] WHEN 1 THEN ['Node.js', p_name] ELSE ['js', 'React'] END)) AS skills FROM part")
def refine_skills(spark, d):
    return table(spark, d, "part").select("p_partkey", refiners.skills(F.expr("CASE p_size % 3 WHEN 0 THEN array('JS', 'K8s', 'Javascript', p_brand) WHEN 1 THEN array('Node', 'Node.js', p_name) ELSE array('js', 'React.js') END")).alias("skills"))


@query("refine_notes", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN ['a', 'b' || p_size] WHEN 1 THEN ['x', 'y' || p_size] ELSE [] END AS tags, CASE WHEN p_size % 3 = 1 THEN ['one two', p_brand] ELSE [] END AS aliases FROM part")
def refine_notes(spark, d):
    listed = F.expr("CASE WHEN p_size % 3 = 0 THEN array('#a', concat('##b', p_size)) END")
    tags, aliases = (F.expr(f"CASE WHEN p_size % 3 = 1 THEN {x} END") for x in ("concat(' #x,, #y', p_size, ' ')", "concat(' one two , ', p_brand, ',')"))
    none = F.lit(None).cast("array<string>")
    return table(spark, d, "part").select("p_partkey", refiners.note_tags(listed, tags).alias("tags"), refiners.front_matter_list(none, aliases, ",").alias("aliases"))


@query("refine_games", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'NPC' WHEN 1 THEN 'NPC' WHEN 2 THEN 'Location' WHEN 3 THEN 'Item' END AS game_type, CASE WHEN p_size % 5 = 0 THEN p_size::BIGINT END AS hp, CASE WHEN p_size % 5 = 1 THEN 17::BIGINT END AS ac, CASE WHEN p_size % 5 = 2 THEN '1/4' END AS cr FROM part")
def refine_games(spark, d):
    c = F.expr("CASE p_size % 5 WHEN 0 THEN concat('This npc in a town has Hit  Points: ', p_size) WHEN 1 THEN 'She was a lvl 7 elf. AC 17.' WHEN 2 THEN 'a DUNGEON of Challenge Rating 1/4, personal' WHEN 3 THEN 'Rarity: rare' ELSE 'rarity: HPX 3' END")
    return table(spark, d, "part").select("p_partkey", refiners.game_type(c).alias("game_type"), *refiners.game_stats(c))


@query("half_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x = 0 THEN 0 ELSE round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END)), 6) AS total FROM embeddings WHERE embedding IS NOT NULL")
def half_vectors(spark, d):
    v = table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", curation.half_precision(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("packed_vectors", "SELECT vec_id, 2 * len(embedding) AS n_bytes, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x = 0 THEN 0 ELSE round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END)), 6) AS total FROM embeddings WHERE embedding IS NOT NULL")
def packed_vectors(spark, d):
    """Vectors stored in half precision, two bytes a component, and read back."""
    packed = scratch.saved(table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", vectors.packed_half("embedding").alias("packed")), "packed")
    v = packed.select("vec_id", F.length("packed").alias("n_bytes"), vectors.unpacked_half("packed").alias("v"))
    return v.select("vec_id", "n_bytes", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("search_multi_vector", """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
 s AS (SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 6) AS score FROM embeddings, q),
 c AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM s WHERE id % 2 = 0 QUALIFY r <= 20),
 a AS (SELECT id - id % 10 AS id, row_number() OVER (ORDER BY score DESC, id) AS r FROM s WHERE id % 2 = 1 QUALIFY r <= 20),
 p AS (SELECT id, 1.0::DOUBLE / (60 + r) AS part FROM c UNION ALL SELECT id, 0.8::DOUBLE / (60 + r) FROM a) SELECT id, round(sum(part), 6) AS score FROM p GROUP BY 1 ORDER BY score DESC, id LIMIT 10""")
def search_multi_vector(spark, d):
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").select("embedding").first()[0]
    hits = lambda odd: search.vector_top(e, q, 20, F.col("vec_id") % 2 == odd)
    parents = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("question"), (F.col("vec_id") - F.col("vec_id") % 10).alias("id"))
    return search.multi_vector(hits(0), hits(1), parents)


@query("search_expanded")
def search_expanded(spark, d):
    q = "what is ontion ering?"
    index = keyword_index(spark, d)
    return search.expanded(lambda x, k: search_index.bm25(index, x, k), [q, *query_lang.expand(q, "factual")], 10)
