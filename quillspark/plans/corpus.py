"""Queries: corpus profile, topics, entities, readability, quality, dedup and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import analytics, dedup, resolve
from quillspark.schema import chunks, table

from .base import query

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
SPLIT = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
NORM = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"


@query("corpus_profile", "SELECT count(*) AS total_chunks, count(DISTINCT source) AS total_documents, sum(length(text))::BIGINT AS total_chars, floor(sum(length(text)) / count(*))::BIGINT AS avg_chunk_size, floor(floor(sum(length(text)) / 5) / 200)::BIGINT AS reading_minutes FROM documents")
def profile(spark, d):
    return analytics.profile(chunks(spark, d))


@query("corpus_topics", f"SELECT term, count(*) AS n FROM (SELECT unnest({WORDS}) AS term FROM documents) WHERE length(term) >= 5 AND term NOT IN ({', '.join(repr(w) for w in text.CORPUS_STOPWORDS)}) AND NOT regexp_full_match(term, '[0-9]+') GROUP BY 1 ORDER BY n DESC, term LIMIT 20")
def topics(spark, d):
    return analytics.topics(chunks(spark, d))


@query("corpus_capitalised")
def capitalised(spark, d):
    return analytics.capitalised(chunks(spark, d))


TOPIC_STOP = "the and for are but not you all can had her was one our out day get has him his".split()


@query(
    "topic_ngrams",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), o AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
 l AS (SELECT x, lead(x) OVER d AS y, lead(x, 2) OVER d AS z FROM o WHERE regexp_full_match(x, '[a-z]{3,}') WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
 g AS (SELECT [x] AS t FROM l UNION ALL SELECT [x, y] FROM l WHERE y IS NOT NULL UNION ALL SELECT [x, y, z] FROM l WHERE z IS NOT NULL),
 t AS (SELECT array_to_string(t, ' ') AS topic FROM g WHERE NOT list_has_any(t, ["""
    + ", ".join(f"'{w}'" for w in TOPIC_STOP)
    + r"""])), c AS (SELECT topic, count(*) AS frequency FROM t WHERE length(topic) >= 4 GROUP BY 1)
 SELECT topic, frequency, round(frequency / (SELECT sum(frequency) FROM c), 9) AS weight FROM c WHERE frequency >= 2 ORDER BY frequency DESC, topic LIMIT 10""",
)
def ngrams(spark, d):
    return analytics.ngram_topics(chunks(spark, d), TOPIC_STOP)


GOOD, BAD = (", ".join(f"'{w}'" for w in ws) for ws in (analytics.POSITIVE, analytics.NEGATIVE))


@query("sentiment", f"WITH s AS (SELECT doc_id, {SPLIT.replace('text', 'lower(text)')} AS w FROM documents), c AS (SELECT doc_id, CASE WHEN len(w) > 0 THEN (len(list_filter(w, lambda x: x IN ({GOOD}))) - len(list_filter(w, lambda x: x IN ({BAD})))) / len(w) ELSE 0 END AS s FROM s) SELECT doc_id, CASE WHEN s > 0.05 THEN 'positive' WHEN s < -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment, round(s, 3) AS sentiment_score FROM c")
def sentiment(spark, d):
    return chunks(spark, d).select("doc_id", analytics.sentiment(F.col("content")).alias("s")).select("doc_id", "s.*")


SYL = "CASE WHEN length(x) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - (CASE WHEN x LIKE '%e' THEN 1 ELSE 0 END)) END"


@query(
    "readability",
    rf"""WITH b AS (SELECT doc_id, length(text) AS chars, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]+')) AS w, len(list_filter(regexp_split_to_array(text, '[.!?]+\s*'), lambda s: regexp_replace(s, '\s+', '', 'g') <> '')) AS s FROM documents),
 n AS (SELECT doc_id, chars, s::DOUBLE AS s, len(w)::DOUBLE AS n, list_sum(list_transform(w, lambda x: {SYL}))::DOUBLE AS y, len(list_filter(w, lambda x: {SYL} >= 3))::DOUBLE AS c FROM b)
 SELECT doc_id, n::INT AS words, round(greatest(0.0, least(100.0, 206.835::DOUBLE - 1.015::DOUBLE * (n / s) - 84.6::DOUBLE * (y / n))), 6) AS flesch_ease, round(greatest(0.0, 0.39::DOUBLE * (n / s) + 11.8::DOUBLE * (y / n) - 15.59::DOUBLE), 6) AS kincaid_grade,
  round(0.4::DOUBLE * (n / s + 100 * (c / n)), 6) AS gunning_fog, round(1.043::DOUBLE * sqrt(c * (30 / s)) + 3.1291::DOUBLE, 6) AS smog FROM n WHERE n > 0 AND s > 0""",
)
def readability(spark, d):
    return analytics.readability(chunks(spark, d), digits=6).where("words > 0 AND sentences > 0").select("doc_id", "words", "flesch_ease", "kincaid_grade", "gunning_fog", "smog")


@query("readability_all")
def readability_all(spark, d):
    return analytics.readability(chunks(spark, d))


@query("quality_scores")
def quality(spark, d):
    return chunks(spark, d).select("doc_id", analytics.quality(F.col("content")).alias("q")).select("doc_id", "q.*")


@query("facets", "WITH l AS (SELECT 'lang' AS facet, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents), c AS (SELECT facet, value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY 1, 2) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 5")
def facets(spark, d):
    return analytics.facets(table(spark, d, "documents"), ["lang", "source"], 5)


@query("facets_parts", "WITH l AS (SELECT 'p_brand' AS facet, p_brand AS value FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part), c AS (SELECT facet, value, count(*) AS n FROM l GROUP BY 1, 2) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 20")
def facets_parts(spark, d):
    return analytics.facets(table(spark, d, "part"), ["p_brand", "p_size"], 20)


@query("missing_years", "WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) % 3 <> 0) SELECT r.year::INT AS year FROM (SELECT unnest(range((SELECT min(y) FROM y), (SELECT max(y) FROM y) + 1)) AS year) r WHERE r.year NOT IN (SELECT y FROM y)")
def missing_years(spark, d):
    return analytics.missing_years(table(spark, d, "orders").where("year(o_orderdate) % 3 <> 0"), "o_orderdate")


@query("dedup_exact", f"WITH h AS (SELECT doc_id, md5({NORM}) AS h, len({SPLIT}) AS n FROM documents) SELECT doc_id AS id, h AS content_hash, first_value(doc_id) OVER w AS kept_id, count(*) OVER (PARTITION BY h) AS group_size FROM h WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)")
def dedup_exact(spark, d):
    return dedup.exact(chunks(spark, d))


@query("dedup_keep_first", r"SELECT doc_id, md5(lower(trim(text))) AS h FROM documents QUALIFY row_number() OVER (PARTITION BY md5(lower(trim(text))) ORDER BY doc_id) = 1")
def keep_first(spark, d):
    rows = chunks(spark, d).select("doc_id", F.md5(F.lower(F.trim(F.col("content")))).alias("h"))
    return dedup.keep_first(rows, F.col("h"), "doc_id")


SHINGLE = f"s AS (SELECT doc_id AS id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) ELSE [n] END) AS items FROM (SELECT doc_id, n, list_filter(string_split(n, ' '), lambda x: x <> '') AS w FROM (SELECT doc_id, {NORM} AS n FROM documents)))"


@query("similar_shingles", f"WITH {SHINGLE}, u AS (SELECT id, len(items) AS n, unnest(items) AS item FROM s), p AS (SELECT a.id AS a, b.id AS b, count(*) AS i, a.n AS x, b.n AS y FROM u a JOIN u b ON a.item = b.item AND a.id < b.id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) GROUP BY ALL) SELECT a, b, round(i / (x + y - i), 6) AS similarity FROM p WHERE i / (x + y - i) >= 0.8")
def similar_shingles(spark, d):
    rows = chunks(spark, d).select(F.col("doc_id").alias("id"), text.shingles(F.col("content")).alias("items"))
    return dedup.similar_pairs(rows, 0.8).withColumn("similarity", F.round("similarity", 6))


@query("dedup_near_greedy")
def near_greedy(spark, d):
    rows = chunks(spark, d).select(F.col("doc_id").alias("id"), text.shingles(F.col("content")).alias("items"))
    return dedup.greedy_classes(rows, 0.85)


@query("similar_vectors", "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT * FROM p WHERE similarity >= 0.35")
def similar_vectors(spark, d):
    return dedup.vector_pairs(table(spark, d, "embeddings"), 0.35)


@query(
    "window_matches",
    f"""WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents), x AS (SELECT doc_id, unnest(range(0, greatest(len(w) - 1, 0) + 1, 25)) AS s, w FROM t),
 win AS (SELECT doc_id, (s / 25)::INT AS window_no, list_distinct(w[s+1:s+50]) AS w FROM x WHERE len(w[s+1:s+50]) >= 5),
 it AS (SELECT item_id, list_distinct({WORDS}) AS w FROM benchmark),
 j AS (SELECT doc_id, window_no, item_id, count(*) AS shared, n, m FROM (SELECT doc_id, window_no, len(w) AS n, unnest(w) AS x FROM win) JOIN (SELECT item_id, len(w) AS m, unnest(w) AS x FROM it) USING (x) GROUP BY ALL),
 k AS (SELECT doc_id, window_no, item_id, shared, round(shared / (n + m - shared), 6) AS similarity FROM j WHERE shared >= 5)
 SELECT * FROM k WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY doc_id, window_no ORDER BY similarity DESC, item_id) <= 3""",
)
def window_matches(spark, d):
    return dedup.window_matches(chunks(spark, d), table(spark, d, "benchmark"))


MENTIONS = "m AS (SELECT DISTINCT l_orderkey AS chunk, (l_partkey % 50)::VARCHAR AS entity FROM lineitem)"


def _mentions(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), (F.col("l_partkey") % 50).cast("string").alias("entity"))


@query("entity_cooccurrence", f"WITH {MENTIONS} SELECT x.entity AS a, y.entity AS b, count(*) AS chunks FROM m x JOIN m y ON x.chunk = y.chunk AND x.entity < y.entity GROUP BY 1, 2")
def cooccurrence(spark, d):
    return analytics.cooccurrence(_mentions(spark, d))


@query("entity_profiles", "SELECT (l_partkey % 50)::VARCHAR AS entity, count(*) AS mentions, count(DISTINCT l_orderkey) AS documents, count(DISTINCT l_orderkey * 10 + l_linenumber) AS chunks, list_sort(list_distinct(list(l_shipdate::DATE::VARCHAR))) AS variations FROM lineitem GROUP BY 1")
def profiles(spark, d):
    m = table(spark, d, "lineitem").select((F.col("l_partkey") % 50).cast("string").alias("entity"), F.col("l_shipdate").cast("date").cast("string").alias("variation"), F.col("l_orderkey").alias("document"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk"))
    return analytics.entity_profiles(m)


@query("entity_cross_domain", "SELECT l_partkey AS entity, count(*) AS n, list_sort(list_distinct(list(l_returnflag))) AS domains FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT l_returnflag) > 1")
def cross_domain(spark, d):
    return analytics.cross_domain(table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("domain")))


@query("entity_cross_document", "SELECT sha256('part:' || l_partkey) AS entity_hash, count(DISTINCT l_orderkey) AS documents, count(*) AS mentions FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def cross_document(spark, d):
    rows = table(spark, d, "lineitem").select(F.sha2(F.concat_ws(":", F.lit("part"), F.lower(F.trim(F.col("l_partkey").cast("string")))), 256).alias("entity_hash"), "l_orderkey")
    return rows.groupBy("entity_hash").agg(F.countDistinct("l_orderkey").alias("documents"), F.count(F.lit(1)).alias("mentions")).where("documents > 1")


@query("fuzzy_names", "WITH n AS (SELECT n_name, array_to_string(list_sort(list_filter(string_split(lower(n_name), ' '), lambda x: x <> '')), ' ') AS k FROM nation), p AS (SELECT a.n_name AS a, b.n_name AS b, round(1 - levenshtein(a.k, b.k) / greatest(length(a.k), length(b.k)), 6) AS ratio FROM n a JOIN n b ON a.n_name < b.n_name) SELECT * FROM p WHERE ratio >= 0.4")
def fuzzy(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.lit("nation").alias("kind"), text.token_sort(F.col("n_name")).alias("key"), "n_name")
    pairs = resolve.similar_keys(n, 0.4)
    for end in ("a", "b"):
        pairs = pairs.join(n.select(F.col("node").alias(end), F.col("n_name").alias(f"name_{end}")), end)
    names = F.sort_array(F.array("name_a", "name_b"))
    return pairs.select(names[0].alias("a"), names[1].alias("b"), F.round("ratio", 6).alias("ratio"))


@query("keyword_counts", f"WITH t AS (SELECT doc_id, unnest({WORDS}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS n FROM t WHERE length(term) > 3 GROUP BY 1, 2) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) <= 5")
def keywords(spark, d):
    from pyspark.sql import Window

    t = chunks(spark, d).select("doc_id", F.explode(text.words(F.col("content"))).alias("term")).where("length(term) > 3")
    c = t.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "term"))).where("r <= 5").drop("r")


@query("text_hashes", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def hashes(spark, d):
    c = F.col("content")
    return chunks(spark, d).select("doc_id", F.md5(c).alias("md5"), F.sha1(c).alias("sha1"), F.sha2(c, 256).alias("sha256"))


@query("pii_counts", r"SELECT doc_id, len(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b')) AS n_email, len(regexp_extract_all(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b')) AS n_ssn, len(regexp_extract_all(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')) AS n_ip_address FROM documents")
def pii(spark, d):
    return chunks(spark, d).select("doc_id", *text.pii_counts(F.col("content"))).select("doc_id", "n_email", "n_ssn", "n_ip_address")


@query("redacted", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[EMAIL]', 'g'), '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', '[IP_ADDRESS]', 'g')) AS digest FROM documents")
def redacted(spark, d):
    return chunks(spark, d).select("doc_id", F.md5(text.redact(F.col("content"), ("EMAIL", "IP_ADDRESS"))).alias("digest"))


@query("clean_text", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', E'\n\n', 'g'), ' {2,}', ' ', 'g'), 'https?://[^\s]+', '', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def cleaned(spark, d):
    return chunks(spark, d).select("doc_id", F.md5(text.clean_text(F.col("content"), True)).alias("digest"))


@query("normalize_whitespace", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def whitespace(spark, d):
    return chunks(spark, d).select("doc_id", F.md5(text.normalize_whitespace(F.col("content"))).alias("digest"))


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 77) || '...' ELSE text END AS short FROM documents")
def truncated(spark, d):
    return chunks(spark, d).select("doc_id", text.truncate(F.col("content"), 80).alias("short"))


@query("sanitize_tag", "SELECT p_partkey, left(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]', '', 'g'), 32) AS tag FROM part")
def tags(spark, d):
    return table(spark, d, "part").select("p_partkey", text.sanitize_tag(F.concat_ws(" ", "p_name", "p_type")).alias("tag"))


@query("sentence_counts", r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g') <> ''))::INT AS sentences FROM documents")
def sentence_counts(spark, d):
    return chunks(spark, d).select("doc_id", F.size(text.sentences(F.col("content"))).alias("sentences"))


@query("ocr_cleanup")
def ocr(spark, d):
    return chunks(spark, d).select("doc_id", F.md5(text.ocr_cleanup(text.drop_page_numbers(text.clean_bullets(F.col("content"))))).alias("digest"))
