"""Queries: query language, classification, links, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import links, query_lang
from quillspark.schema import chunks, table

from .base import query


@query("query_language", "SELECT doc_id FROM documents WHERE lower(lang) = 'en' AND NOT contains(lower(text), 'license') AND contains(lower(text), 'of the') AND contains(lower(text), 'tion') AND contains(lower(text), 'ering')")
def language(spark, d):
    c = chunks(spark, d)
    p = query_lang.parse('tion AND ering "of the" lang:EN NOT license')
    return c.where(query_lang.predicate(p, F.col("content"), {"lang": F.col("library")})).select("doc_id")


@query("query_language_or", "SELECT doc_id FROM documents WHERE lower(source) = 'src3' AND (contains(lower(text), 'ontion') OR contains(lower(text), 'ciónes')) AND NOT contains(lower(text), 'anda')")
def language_or(spark, d):
    p = query_lang.parse("ontion OR ciónes source:src3 -anda")
    return chunks(spark, d).where(query_lang.predicate(p, F.col("content"), {"source": F.col("source_file")})).select("doc_id")


ASKED = "CASE p_partkey % 7 WHEN 0 THEN 'What is ' || p_name || '?' WHEN 1 THEN 'How do I use ' || p_name WHEN 2 THEN 'Compare it vs that' WHEN 3 THEN 'Tell me about ' || p_name WHEN 4 THEN 'Explain the concept of size' WHEN 5 THEN 'theme and motif' ELSE 'plain words' END"


@query("query_intent", "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'factual' WHEN 1 THEN 'procedural' WHEN 2 THEN 'comparative' WHEN 3 THEN 'exploratory' WHEN 4 THEN 'conceptual' WHEN 5 THEN 'literary' ELSE 'exploratory' END AS intent FROM part")
def intents(spark, d):
    return table(spark, d, "part").select("p_partkey", query_lang.intent(F.expr(ASKED)).alias("intent"))


DOMAIN_TEXT = "concat(p_name, CASE p_partkey % 8 WHEN 0 THEN ' the Judge saw a Threat' WHEN 1 THEN ' debugging this' WHEN 2 THEN ' case law and a Tree-Sitter' WHEN 3 THEN ' my Daily Note, a D&D dungeon' WHEN 4 THEN ' grandparents logged' WHEN 5 THEN ' COURT of Courts, judge, court' WHEN 6 THEN ' ip address items' ELSE ' none' END)"
#: The rule once more, for DuckDB: any mark, anywhere, in any case.
DOMAIN_WORDS = {
    "legal": "statute|jurisdiction|judge|docket|court|legal|opinion|ruling|citation|bluebook|case law|precedent|plaintiff|defendant|lawsuit|litigation",
    "tech": "code|function|method|class|api|implementation|tree-sitter|language|import|export|dependency|software|develop|debug|refactor|algorithm",
    "pkm": "vault|obsidian|wikilink|backlink|frontmatter|alias|tag|daily note|logseq|roam|knowledge base",
    "genealogy": "family|tree|ancestor|descendant|parent|child|birth|death|marriage|gedcom|genealogy|lineage|grandfather|grandmother|relative",
    "rpg": "npc|character sheet|stat block|armor class|hit points|dungeon|campaign|adventure|d&d|tabletop|dm|game master|monster|item|rarity",
    "cyber": "log|cve|vulnerability|attack|tactic|technique|mitre|security|threat|ip address|source ip|firewall|cloudtrail|syslog|incident|breach",
}
DOMAINS_SQL = "SELECT p_partkey, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(c, '(?i){w}') THEN '{n}' END" for n, w in DOMAIN_WORDS.items()) + f"], lambda x: x IS NOT NULL) AS domains FROM (SELECT p_partkey, {DOMAIN_TEXT} AS c FROM part)"
COUNTS_SQL = "SELECT p_partkey, " + ", ".join("(" + " + ".join(f"len(regexp_extract_all(c, '(?i){m}'))" for m in DOMAIN_WORDS[n].split("|")) + f")::INT AS {n}" for n in ("legal", "tech", "rpg", "cyber")) + f" FROM (SELECT p_partkey, {DOMAIN_TEXT} AS c FROM part)"


@query("query_domains", DOMAINS_SQL)
def domains(spark, d):
    return table(spark, d, "part").select("p_partkey", query_lang.domains(F.expr(DOMAIN_TEXT)).alias("domains"))


@query("domain_scores", COUNTS_SQL)
def scores(spark, d):
    m = query_lang.domain_scores(F.expr(DOMAIN_TEXT))
    return table(spark, d, "part").select("p_partkey", *[m[n].alias(n) for n in ("legal", "tech", "rpg", "cyber")])


@query("citations_valid", "SELECT p_partkey, 2 AS cited, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS invalid, 1.0::DOUBLE AS coverage, p_size % 2 <> 0 AS valid FROM part")
def citations(spark, d):
    answer = F.expr("concat('A first statement here [a1]. A second one follows [', if(p_size % 2 = 0, 'zz', 'b2'), '].')")
    return table(spark, d, "part").select("p_partkey", *query_lang.citations_valid(answer, F.array(F.lit("a1"), F.lit("b2"))))


@query("links_by_time", "WITH y AS (SELECT o_orderkey AS id, o_custkey AS c, year(o_orderdate) AS y FROM orders) SELECT a.id AS a, b.id AS b FROM y a JOIN y b ON a.c = b.c AND a.id < b.id AND abs(a.y - b.y) <= 1")
def by_time(spark, d):
    return links.by_time(table(spark, d, "orders").withColumn("y", F.year("o_orderdate")), "o_orderkey", "y", 1, within="o_custkey")


@query("links_by_entity", "WITH m AS (SELECT DISTINCT l_orderkey AS artifact, l_partkey AS entity FROM lineitem), p AS (SELECT x.artifact AS a, y.artifact AS b, x.entity FROM m x JOIN m y ON x.entity = y.entity AND x.artifact <> y.artifact) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a, entity ORDER BY b) <= 2")
def by_entity(spark, d):
    return links.by_entity(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("artifact"), F.col("l_partkey").alias("entity")), 2)


@query("family_links", "SELECT 'h' || c_custkey AS src, 'spouse_of' AS relation, 'w' || c_custkey AS dst FROM customer UNION ALL SELECT unnest(['h' || c_custkey, 'w' || c_custkey]), 'parent_of', 'c' || c_custkey FROM customer WHERE c_nationkey % 2 = 0")
def family(spark, d):
    f = table(spark, d, "customer").select(F.concat(F.lit("h"), "c_custkey").alias("husb"), F.concat(F.lit("w"), "c_custkey").alias("wife"), F.when(F.col("c_nationkey") % 2 == 0, F.array(F.concat(F.lit("c"), "c_custkey"))).otherwise(F.array().cast("array<string>")).alias("children"))
    return links.family(f)


@query("key_values", "SELECT p_partkey, unnest(['name', 'size']) AS key, unnest([p_name, p_size::VARCHAR]) AS value FROM part")
def key_values(spark, d):
    c = table(spark, d, "part").select("p_partkey", F.expr("concat('Name: \"', p_name, '\"\\nno pair here\\n size = ', p_size)").alias("content"))
    return links.key_values(c, "p_partkey", "content").select("p_partkey", "key", "value")


@query("merge_metadata", "SELECT p_partkey, p_name AS a, 'new' AS b, p_brand AS c FROM part")
def merge_metadata(spark, d):
    base = F.create_map(F.lit("a"), "p_name", F.lit("b"), F.lit("old"))
    m = links.merge_maps(base, F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), "p_brand"))
    return table(spark, d, "part").select("p_partkey", m["a"].alias("a"), m["b"].alias("b"), m["c"].alias("c"))


@query("nearest_captions", "WITH b AS (SELECT l_orderkey AS page, l_linenumber AS box, min(l_quantity) AS x, min(l_discount) * 100 AS y FROM lineitem GROUP BY 1, 2), p AS (SELECT b.page, b.box, c.box AS block, sqrt((b.x - c.x) * (b.x - c.x) + (b.y - c.y) * (b.y - c.y)) AS distance FROM b JOIN b c ON b.page = c.page AND c.box <= 2) SELECT page, box, block, round(distance, 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY page, box ORDER BY distance, block) = 1")
def nearest(spark, d):
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("box")).agg(F.min("l_quantity").alias("x"), (F.min("l_discount") * 100).alias("y"))
    return links.nearest(b, b.where("box <= 2").withColumnRenamed("box", "block"))


@query("export_json_ld", """SELECT p_partkey, '{"@context":"https://schema.org","@type":"Product","identifier":"' || p_partkey || '","p_name":"' || p_name || '"}' AS json FROM part""")
def json_ld(spark, d):
    return links.json_ld(table(spark, d, "part"), "p_partkey", "Product", ["p_name"])


@query("outline", "SELECT p_partkey, unnest(['1', '1.2', '1.2.' || p_size]) AS number, unnest(['Start', 'Middle', p_name]) AS title, unnest([1, 2, 3])::INT AS depth, unnest(['', '1', '1.2']) AS parent FROM part")
def outline(spark, d):
    c = table(spark, d, "part").select("p_partkey", F.expr("concat('1. Start\\ntext\\n1.2 Middle\\n1.2.', p_size, '  ', p_name)").alias("content"))
    return links.outline(c, "p_partkey", "content").drop("line_no")


@query(
    "line_kinds",
    r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
m AS (SELECT doc_id, CASE WHEN no % 3 = 0 THEN ['# ', '- ', '12. ', '| a |', '> ', '    ', '#', '-'][(doc_id + no // 3) % 8 + 1] || line ELSE line END AS line FROM l)
SELECT doc_id, CASE WHEN regexp_full_match(line, '[ \t\r\f\v]*') THEN 'blank' WHEN regexp_matches(line, '^#{1,6} ') THEN 'heading'
  WHEN regexp_matches(line, '^\s*(?:[-*+]|[0-9]+[.)]) ') THEN 'list' WHEN regexp_matches(line, '^\s*\|.*\|\s*$') THEN 'table'
  WHEN regexp_matches(line, '^\s*> ') THEN 'quote' WHEN regexp_matches(line, '^(?: {4}|\t|```)') THEN 'code' ELSE 'text' END AS kind, count(*) AS n
FROM m GROUP BY 1, 2""",
)
def line_kinds(spark, d):
    """Kinds of the lines of every document, every third line being marked up."""
    marks = F.array(*[F.lit(m) for m in ("# ", "- ", "12. ", "| a |", "> ", "    ", "#", "-")])
    lines = chunks(spark, d).select("doc_id", F.posexplode(F.split("content", "\n")).alias("no", "line")).withColumn("no", F.col("no") + 1)
    mark = F.element_at(marks, ((F.col("doc_id") + F.expr("no div 3")) % 8 + 1).cast("int"))
    marked = F.when(F.col("no") % 3 == 0, F.concat(mark, "line")).otherwise(F.col("line"))
    return lines.groupBy("doc_id", links.line_kind(marked).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("dated_events", "SELECT o_orderkey, o_orderdate::DATE AS event_date, 'day' AS form FROM orders UNION ALL SELECT o_orderkey, make_date(year(o_orderdate), 1, 1), 'year' FROM orders")
def dated(spark, d):
    c = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("On "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" it came; in "), F.year("o_orderdate"), F.lit(" it went.")).alias("content"))
    return links.dated_events(c, "o_orderkey", "content")


@query("host_rules", "SELECT page_id, CASE WHEN regexp_matches(lower(url), '://([^/?#:]*\\.)?blog\\.[^/?#:]*example\\.net') THEN 'example.net' WHEN regexp_matches(lower(url), '://[^/?#:]*example\\.net') THEN 'example.net' WHEN regexp_matches(lower(url), '://[^/?#:]*\\.org([/?#:]|$)') THEN 'org' END AS suffix, CASE WHEN regexp_matches(lower(url), '://[^/?#:]*example\\.net') THEN 'block' ELSE 'allow' END AS verdict FROM pages")
def host_rules(spark, d):
    rules = spark.createDataFrame([("org", "allow"), ("net", "allow"), ("example.net", "block")], "suffix string, verdict string")
    return links.rules_of_hosts(table(spark, d, "pages"), rules)


@query("concept_map", "WITH c AS (SELECT DISTINCT doc_id, concept FROM documents, (VALUES ('ontion'), ('ering'), ('tionan'), ('anthe'), ('ouand')) t(concept) WHERE contains(lower(text), concept)) SELECT x.concept AS a, y.concept AS b, count(*) AS n FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.concept < y.concept GROUP BY 1, 2")
def concept_map(spark, d):
    from quillspark.operators.analytics import cooccurrence

    low, concepts = F.lower("content"), ["ontion", "ering", "tionan", "anthe", "ouand"]
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(x)), F.lit(x)) for x in concepts]))
    return cooccurrence(chunks(spark, d).select(F.col("doc_id").alias("chunk"), F.explode(found).alias("entity"))).withColumnRenamed("chunks", "n")


@query("split_integrity", "SELECT count(*) AS total, count(*) AS intact FROM documents")
def integrity(spark, d):
    joined = F.array_join(text.sentences(F.col("content")), " ")
    same = text.normalize_whitespace(joined) == text.normalize_whitespace(F.col("content"))
    return chunks(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_if(same).alias("intact"))


@query("history_search", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') AND role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 20")
def history(spark, d):
    return table(spark, d, "conversations").where(F.contains(F.lower("text"), F.lit("the")) & (F.col("role") == "user")).orderBy(F.desc("conv_id"), F.desc("turn")).select("conv_id", "turn").limit(20)
