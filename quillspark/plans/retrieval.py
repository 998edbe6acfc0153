"""Queries: keyword, vector and hybrid search, score fusion, re-ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import search, search_index
from quillspark.schema import chunks, table
from quillspark.sources import scratch

from .base import query

Q = "ontion ering the"
STOP = ", ".join(f"'{w}'" for w in text.SEARCH_STOPWORDS)
TOK = f"""tok AS (SELECT doc_id, lang, list_filter(regexp_extract_all(lower(coalesce(text,'')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1 AND w NOT IN ({STOP})) AS t FROM documents)"""
BM25 = f"""{TOK}, q AS (SELECT unnest(['ontion','ering']) AS term),
 tf AS (SELECT doc_id, lang, len(t) AS dl, term, len(list_filter(t, lambda w: w = term)) AS tf FROM tok, q),
 st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
 df AS (SELECT term, count_if(tf > 0) AS df FROM tf GROUP BY 1),
 bm AS (SELECT doc_id AS id, lang, round(sum(ln((n-df+0.5)/(df+0.5)+1)*((tf*2.5)/(tf+1.5*(0.25+0.75*dl/avgdl))+0.5)), 6) AS score
        FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY 1, 2)"""
VEC = """qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7),
 vec AS (SELECT vec_id AS id, label, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))), 6) AS score
         FROM embeddings, qv)"""


def _vector(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 7").first()["embedding"]


_INDEXES: dict[tuple[str, str], str] = {}


def keyword_index(spark, d):
    """The index of a folder's documents: built by the first search of an application, read by all later ones."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        path = scratch.scratch(spark, "keyword-index")
        search_index.build(chunks(spark, d), path, {"library": F.col("library")})
        _INDEXES[key] = path
    return search_index.load(spark, _INDEXES[key])


@query("search_bm25", f"WITH {BM25} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 10")
def bm25(spark, d):
    return search_index.bm25(keyword_index(spark, d), Q, 10)


@query("search_bm25_library", f"WITH {BM25} SELECT id, score FROM bm WHERE lang = 'fr' ORDER BY score DESC, id LIMIT 5")
def bm25_library(spark, d):
    return search_index.bm25(keyword_index(spark, d), Q, 5, predicate=F.col("library") == "fr")


@query("search_bm25_scan", f"WITH {BM25} SELECT id, score FROM bm WHERE lang = 'fr' ORDER BY score DESC, id LIMIT 5")
def bm25_scan(spark, d):
    return search.bm25(chunks(spark, d), Q, 5, predicate=F.col("library") == "fr")


@query("index_totals", f"WITH {TOK} SELECT count(*) AS n, round(avg(len(t)), 6) AS avgdl FROM tok")
def index_totals(spark, d):
    return keyword_index(spark, d).totals.select("n", F.round("avgdl", 6).alias("avgdl"))


@query("index_postings", f"WITH {TOK} SELECT term, doc_id AS id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY 1, 2")
def postings(spark, d):
    return search.postings(chunks(spark, d))


@query("index_lengths", f"WITH {TOK} SELECT doc_id AS id, len(t)::INT AS dl FROM tok")
def lengths(spark, d):
    return search.lengths(chunks(spark, d))


@query("index_term_statistics", f"WITH {TOK} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY 1")
def term_statistics(spark, d):
    return search.postings(chunks(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


TFIDF = """WITH tok AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text,'')), '[\\p{L}\\p{N}_]+'), lambda w: length(w) > 2) AS t FROM documents),
 q AS (SELECT unnest(['ontion','ering','the']) AS term),
 tf AS (SELECT doc_id, len(t) AS dl, term, len(list_filter(t, lambda w: w = term)) AS tf FROM tok, q),
 df AS (SELECT term, count_if(tf > 0) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS n FROM tok)
 SELECT doc_id AS id, round(sum(tf / dl * (1 + n / (1 + df))), 6) AS score FROM tf JOIN df USING (term), st WHERE dl > 0 GROUP BY 1 HAVING sum(tf) > 0 ORDER BY score DESC, id LIMIT 10"""


@query("search_tfidf", TFIDF)
def tfidf(spark, d):
    return search_index.tfidf(keyword_index(spark, d), Q, 10)


@query("search_tfidf_scan", TFIDF)
def tfidf_scan(spark, d):
    return search.tfidf(chunks(spark, d), Q, 10)


@query("search_vector", f"WITH {VEC} SELECT id, score FROM vec ORDER BY score DESC, id LIMIT 10")
def vector(spark, d):
    return search.vector_top(table(spark, d, "embeddings"), _vector(spark, d))


@query("search_vector_filtered", f"WITH {VEC} SELECT id, score FROM vec WHERE label = 3 ORDER BY score DESC, id LIMIT 10")
def vector_filtered(spark, d):
    return search.vector_top(table(spark, d, "embeddings"), _vector(spark, d), predicate=F.col("label") == 3)


@query("search_vector_threshold", f"WITH {VEC} SELECT id, score FROM vec WHERE score >= 0.25 ORDER BY score DESC, id LIMIT 10")
def vector_threshold(spark, d):
    return search.vector_top(table(spark, d, "embeddings"), _vector(spark, d), threshold=0.25)


LISTS = f"{BM25}, {VEC}, a AS (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 50), b AS (SELECT id, score FROM vec ORDER BY score DESC, id LIMIT 50)"


def _lists(spark, d, k=50):
    return search_index.bm25(keyword_index(spark, d), Q, k), search.vector_top(table(spark, d, "embeddings"), _vector(spark, d), k)


RANKS = "r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, 'lexical' AS source FROM a UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id), 'semantic' FROM b)"


@query("fuse_rrf", f"WITH {LISTS}, {RANKS} SELECT id, round(sum(1.0::DOUBLE/(60+rank)), 6) AS score FROM r GROUP BY 1 ORDER BY score DESC, id LIMIT 10")
def rrf(spark, d):
    a, b = _lists(spark, d)
    return search.fuse_rrf({"lexical": a, "semantic": b})


@query("fuse_rrf_weighted", f"WITH {LISTS}, {RANKS} SELECT id, round(sum((CASE source WHEN 'lexical' THEN 1.0 ELSE 0.8 END)::DOUBLE/(60+rank)), 6) AS score FROM r GROUP BY 1 ORDER BY score DESC, id LIMIT 10")
def rrf_weighted(spark, d):
    a, b = _lists(spark, d)
    return search.fuse_rrf({"lexical": a, "semantic": b}, weights={"lexical": 1.0, "semantic": 0.8})


WEIGHTED = "w AS (SELECT coalesce(x.id, y.id) AS id, coalesce(x.s, 0) AS xs, coalesce(y.s, 0) AS ys FROM (SELECT id, score / max(score) OVER () AS s FROM a) x FULL JOIN (SELECT id, score / max(score) OVER () AS s FROM b) y ON x.id = y.id)"


@query("fuse_weighted", f"WITH {LISTS}, {WEIGHTED} SELECT id, round(0.4::DOUBLE*xs + 0.6::DOUBLE*ys, 6) AS score FROM w ORDER BY score DESC, id LIMIT 10")
def weighted(spark, d):
    return search.fuse_weighted(*_lists(spark, d))


@query("search_hybrid", f"WITH {LISTS}, {WEIGHTED} SELECT w.id, round(round(0.65::DOUBLE*xs + 0.35::DOUBLE*ys, 6) * (CASE WHEN source IN ('src1','src10','src11','src12','src13','src14','src15','src16','src17','src18','src19') THEN 1.25::DOUBLE WHEN source = 'src2' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END), 6) AS score FROM w LEFT JOIN documents ON w.id = doc_id ORDER BY score DESC, id LIMIT 10")
def hybrid(spark, d):
    hits = search.vector_top(table(spark, d, "embeddings"), _vector(spark, d), 50)
    return search.hybrid(chunks(spark, d), Q, hits, intent="factual", rules=[("src1*", 1), ("src2$", 5)], lexical=search_index.bm25(keyword_index(spark, d), Q, 50))


PROV = "p AS (SELECT id, score, 'a' AS provider FROM a UNION ALL SELECT id, score, 'b' FROM b)"


def _providers(spark, d):
    a, b = _lists(spark, d)
    return a.withColumn("provider", F.lit("a")).unionByName(b.withColumn("provider", F.lit("b")))


@query("normalize_min_max", f"WITH {LISTS}, {PROV} SELECT id, provider, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) AS normalized FROM p WINDOW w AS (PARTITION BY provider)")
def min_max(spark, d):
    return search.normalize_min_max(_providers(spark, d)).select("id", "provider", F.round("normalized", 6).alias("normalized"))


@query("normalize_z_score", f"WITH {LISTS}, {PROV} SELECT id, provider, round(1 / (1 + exp(-(score - avg(score) OVER w) / stddev_pop(score) OVER w)), 6) AS normalized FROM p WINDOW w AS (PARTITION BY provider)")
def z_score(spark, d):
    return search.normalize_z(_providers(spark, d)).select("id", "provider", F.round("normalized", 6).alias("normalized"))


@query("fuse_providers", f"WITH {LISTS}, {PROV}, m AS (SELECT id, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS x FROM p WINDOW w AS (PARTITION BY provider)) SELECT id, round(sum(0.5::DOUBLE * x), 6) AS score FROM m GROUP BY 1")
def providers(spark, d):
    return search.fuse_providers(_providers(spark, d))


@query("first_hits", f"WITH {LISTS} SELECT id, score, 'lexical' AS source FROM a UNION ALL SELECT id, score, 'semantic' FROM b WHERE id NOT IN (SELECT id FROM a)")
def first_hits(spark, d):
    a, b = _lists(spark, d)
    return search.first_hits({"lexical": a, "semantic": b}).select("id", "score", "source")


@query("rerank_terms", f"""WITH {BM25}, h AS (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 100)
 SELECT id, round(0.4::DOUBLE * ((contains(lower(text),'ontion')::INT + contains(lower(text),'ering')::INT + contains(lower(text),'the')::INT) / 3)
  + 0.3::DOUBLE * ((contains(lower(source),'ontion')::INT + contains(lower(source),'ering')::INT + contains(lower(source),'the')::INT) / 3)
  + 0.2::DOUBLE * contains(lower(text), 'ontion ering the')::INT + 0.1::DOUBLE * score, 6) AS score FROM h JOIN documents ON id = doc_id ORDER BY 2 DESC, id LIMIT 10""")
def rerank(spark, d):
    c = chunks(spark, d)
    hits = search_index.bm25(keyword_index(spark, d), Q, 100).join(c.select(F.col("doc_id").alias("id"), "content", F.col("source_file").alias("section_title")), "id")
    return search.term_rerank(hits, Q, 10).select("id", "score")


@query("authority_boost", "SELECT doc_id, CASE WHEN regexp_matches(source, '(?i)src1.*') THEN 1.25::DOUBLE WHEN regexp_matches(source, '(?i)src.*5') THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS boost FROM documents")
def authority(spark, d):
    return chunks(spark, d).select("doc_id", search.authority_boost(F.col("source_file"), rules=[("src1*", 1), ("src*5", 5)]).alias("boost"))


@query("authority_level", "SELECT doc_id, CASE (doc_id % 7) WHEN 1 THEN 1.25::DOUBLE WHEN 2 THEN 1.15::DOUBLE WHEN 3 THEN 1.05::DOUBLE WHEN 5 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS boost FROM documents")
def authority_level(spark, d):
    return chunks(spark, d).select("doc_id", search.authority_boost(F.col("source_file"), F.col("doc_id") % 7).alias("boost"))


@query("metadata_boost", "SELECT doc_id, (CASE WHEN lang = 'fr' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN source = 'src3' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) AS score FROM documents")
def boosted(spark, d):
    c = chunks(spark, d).withColumn("metadata", F.create_map(F.lit("lang"), "library", F.lit("source"), "source_file"))
    return c.select("doc_id", search.metadata_boost(F.lit(1.0), F.col("metadata"), "texts of SRC3 in fr", {"lang": 1.5, "source": 2.0}).alias("score"))


@query("expand_parents", """WITH h AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS score, l_orderkey AS parent FROM lineitem WHERE l_quantity >= 45),
 r AS (SELECT CASE WHEN parent % 3 = 0 THEN id ELSE parent END AS result_id, id, score FROM h)
 SELECT result_id, id, score FROM r QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY score DESC, id) = 1""")
def parents(spark, d):
    items = table(spark, d, "lineitem")
    hits = items.where("l_quantity >= 45").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("score"))
    mapping = items.where("l_orderkey % 3 <> 0").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("child_id"), F.col("l_orderkey").alias("parent_id"))
    return search.expand_parents(hits, mapping)


@query("parent_statistics", "SELECT count(*) AS mappings, count(DISTINCT l_orderkey) AS parents, round(count(*) / count(DISTINCT l_orderkey), 6) AS average FROM lineitem")
def parent_statistics(spark, d):
    n, p = F.count(F.lit(1)), F.countDistinct("l_orderkey")
    return table(spark, d, "lineitem").agg(n.alias("mappings"), p.alias("parents"), F.round(n / p, 6).alias("average"))


@query("proximity_span")
def proximity(spark, d):
    return chunks(spark, d).select("doc_id", search.minimum_span(F.col("content"), ["the", "ing", "ent"]).alias("span"))
