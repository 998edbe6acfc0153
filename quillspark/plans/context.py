"""Queries: routing by domain, ranking by nearness of terms, context windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import context, query_lang, search_index
from quillspark.schema import chunks, table

from .base import query
from .language import DOMAIN_TEXT, DOMAINS_SQL
from .retrieval import BM25, Q, keyword_index

#: The factors once more, for DuckDB; domains that the classifier doesn't give are left out.
FACTORS = "('legal',1.2,1.0),('tech',1.1,0.9),('pkm',0.8,1.2),('cyber',1.3,1.0),('genealogy',1.1,1.0),('rpg',1.0,1.1)"


@query(
    "query_routes",
    f"""WITH d AS ({DOMAINS_SQL}), x AS (SELECT p_partkey, unnest(CASE WHEN len(domains) = 0 THEN [''] ELSE domains END) AS n FROM d)
SELECT p_partkey, round(coalesce(avg(k), 1), 6)::DOUBLE AS keyword, round(coalesce(avg(v), 1), 6)::DOUBLE AS vector
FROM x LEFT JOIN (VALUES {FACTORS}) f(n, k, v) USING (n) GROUP BY p_partkey""",
)
def query_routes(spark, d):
    """Each part's text as a query: its domains and what they make of keyword and vector scores."""
    f = context.factors(query_lang.domains(F.expr(DOMAIN_TEXT)))
    return table(spark, d, "part").select("p_partkey", F.round(f["keyword"], 6).alias("keyword"), F.round(f["vector"], 6).alias("vector"))


@query(
    "search_nearness",
    f"""WITH {BM25}, h AS (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 50),
t AS (SELECT id, score, lower(text) AS low, length(text) AS n FROM h JOIN documents ON id = doc_id),
p AS (SELECT id, score, n, list_filter(range(1, n + 1), lambda i: substr(low, i, 6) = 'ontion') AS a, list_filter(range(1, n + 1), lambda i: substr(low, i, 5) = 'ering') AS b FROM t),
o AS (SELECT id, score, n, len(a) > 0 AND len(b) > 0 AS two, list_sort(list_concat(list_transform(a, lambda i: {{'p': i, 'w': 6}}), list_transform(b, lambda i: {{'p': i, 'w': 5}}))) AS e FROM p),
m AS (SELECT id, score, n, CASE WHEN two THEN 1.0 ELSE 0.5 END AS coverage,
  CASE WHEN two THEN list_min(list_transform(list_filter(range(2, len(e) + 1), lambda i: e[i].w <> e[i - 1].w), lambda i: e[i].p - e[i - 1].p + e[i].w)) ELSE 0 END AS span,
  CASE WHEN two THEN (e[-1].p - e[1].p) / (len(e) - 1)::DOUBLE ELSE 0 END AS apart, e FROM o),
c AS (SELECT *, list_reduce(list_transform(e, lambda x: {{'f': x.p, 'c': 1}}), lambda s, x: CASE WHEN x.f - s.f > 50 THEN {{'f': x.f, 'c': s.c + 1}} ELSE s END).c AS clusters FROM m),
s AS (SELECT id, score, least(1.0, coverage * 0.4 + CASE WHEN span > 0 THEN greatest(0, 1 - span / n::DOUBLE) ELSE 0 END * 0.3 + (1 - least(apart / 50.0, 1.0)) * 0.2 + least(clusters / 5.0, 1.0) * 0.2)::DOUBLE AS near FROM c)
SELECT id, round(near, 6) AS nearness, round(score * 0.7 + near * 0.3, 6)::DOUBLE AS score FROM s""",
)
def search_nearness(spark, d):
    """The fifty best hits of the keyword index, ranked again by how near the query's terms stand."""
    hits = search_index.bm25(keyword_index(spark, d), Q, 50).join(chunks(spark, d).select(F.col("doc_id").alias("id"), "content"), "id")
    return context.rank_by_nearness(hits, Q).select("id", F.round("nearness", 6).alias("nearness"), F.round("score", 6).alias("score"))


@query(
    "context_windows",
    r"""WITH RECURSIVE w AS (SELECT conv_id, turn, role, len(text) % 5 AS score, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM conversations),
u AS (SELECT conv_id, turn, role, score, floor(len(t) * 1.3)::BIGINT AS tokens FROM w QUALIFY row_number() OVER (PARTITION BY conv_id, lower(array_to_string(t, ' ')) ORDER BY score DESC NULLS LAST, turn) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC NULLS LAST, turn) AS rk FROM u),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY rk) AS nth, min(rk) OVER (PARTITION BY conv_id, role) AS f FROM r WHERE rk <= 100),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY nth > 1, CASE WHEN nth = 1 THEN f ELSE rk END) AS place FROM g),
s AS (SELECT conv_id, turn, role, rk, tokens, place, tokens <= 60 AS took, CASE WHEN tokens <= 60 THEN tokens ELSE 0 END AS used FROM o WHERE place = 1
  UNION ALL SELECT o.conv_id, o.turn, o.role, o.rk, o.tokens, o.place, s.used + o.tokens <= 60, s.used + CASE WHEN s.used + o.tokens <= 60 THEN o.tokens ELSE 0 END FROM s JOIN o ON o.conv_id = s.conv_id AND o.place = s.place + 1),
k AS (SELECT * FROM s QUALIFY took OR (rk = 1 AND NOT bool_or(took) OVER (PARTITION BY conv_id)))
SELECT conv_id, turn, role, tokens, row_number() OVER (PARTITION BY conv_id ORDER BY rk) AS rank, (sum(tokens) OVER (PARTITION BY conv_id))::BIGINT AS used FROM k""",
)
def context_windows(spark, d):
    """Conversations as queries, their turns as what was found, roles as documents; sixty tokens each."""
    rows = table(spark, d, "conversations").withColumn("score", F.length("text") % 5)
    return context.windows(rows, "conv_id", "turn", "role", content="text", budget=60)
