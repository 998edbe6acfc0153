"""Queries: chunking, domain metadata, format readers, graphs, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import refiners
from quillspark.operators import chunking, graph
from quillspark.schema import chunks, table
from quillspark.sources import pages, scratch
from quillspark.streaming import ingest

from .base import query


@query("chunk_ids", "SELECT doc_id, left(md5(doc_id || '_0_' || left(text, 50)), 16) AS chunk_id FROM documents")
def chunk_ids(spark, d):
    return chunks(spark, d).select("doc_id", chunking.chunk_id(F.col("doc_id"), F.lit(0), F.col("content")).alias("chunk_id"))


@query("chunk_by_line")
def chunk_lines(spark, d):
    return chunking.by_line(chunks(spark, d), 1000)


@query("chunk_by_paragraph")
def chunk_paragraphs(spark, d):
    return chunking.by_paragraph(chunks(spark, d), 1000)


@query("chunk_by_sentence")
def chunk_sentences(spark, d):
    return chunking.by_sentence(chunks(spark, d), 800)


@query("chunk_by_similarity")
def chunk_similarity(spark, d):
    return chunking.by_similarity(chunks(spark, d))


@query("chunk_by_words", r"WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents), x AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 1, 0) + 1, 180)) AS s FROM t), k AS (SELECT doc_id, array_to_string(w[s+1:s+200], ' ') AS content, s FROM x WHERE s = 0 OR s + 20 < len(w)) SELECT doc_id AS document_id, md5(content) AS digest FROM k WHERE content <> ''")
def chunk_words(spark, d):
    return chunking.by_words(chunks(spark, d), 200, 20).select("document_id", F.md5("content").alias("digest"))


@query("merge_small_chunks")
def merge_small(spark, d):
    return chunking.merge_small(chunking.by_sentence(chunks(spark, d), 200), 60)


@query("markdown_sections")
def markdown_sections(spark, d):
    body = F.concat(F.lit("# "), "source_file", F.lit("\n\n"), "content", F.lit("\n\n## end\nlast"))
    return chunking.sections(chunks(spark, d).select("doc_id", body.alias("content")))


def _rule_sql(kind: str, pattern: str) -> str:
    """The rule of one column over text c in DuckDB, whose expressions have no lookahead: what follows is taken in."""
    p = pattern.replace("(?=", "(?:").replace("'", "''")
    strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    every, upper = f"regexp_extract_all(c, '{p}', 1)", lambda x: f"upper({x})"
    first = strip(f"{every}[1]")
    kept = f"list_filter(list_transform({every}, lambda x: {strip('x')}), lambda x: x <> '')"
    two = lambda sep: f"{every}[1] || '{sep}' || regexp_extract_all(c, '{p}', 2)[1]"
    amount = lambda x: f"replace({x}, ',', '')::DOUBLE"
    return {
        "first": first,
        "upper": upper(first),
        "spaced": upper(rf"regexp_replace({first}, '\s+', ' ', 'g')"),
        "capital": f"upper(substr({first}, 1, 1)) || lower(substr({first}, 2))",
        "pair": two(", "),
        "words": two(" "),
        "every": f"list_sort(list_distinct(list_transform({kept}, lambda x: {upper('x')})))",
        "names": f"list_sort(list_distinct({kept}))",
        "list": f"list_filter(list_transform(string_split({first}, ','), lambda x: {strip('x')}), lambda x: x <> '')",
        "number": f"{first}::DOUBLE",
        "dollars_first": amount(first),
        "dollars_most": f"list_max(list_transform({every}, lambda x: {amount('x')}))",
    }[kind]


def _refine(name: str, template: str) -> None:
    """Texts made by one template, which both engines understand; case, blanks and presence vary with the row."""

    def run(spark, d):
        made = table(spark, d, "part").select("p_partkey", F.expr(template).alias("content"))
        return made.select("p_partkey", *refiners.domain(F.col("content"), name))

    columns = ", ".join(f"{_rule_sql(kind, pattern)} AS {column}" for column, (kind, pattern) in refiners.PATTERNS[name].items())
    query(f"refine_{name}", f"SELECT p_partkey, {columns} FROM (SELECT p_partkey, {template} AS c FROM part)")(run)


_refine("cyber", "concat('See ', CASE p_size % 3 WHEN 0 THEN 'CVE' WHEN 1 THEN 'cve' ELSE 'Cve' END, '-2021-', 10000 + p_partkey, ' and cve-2020-1234. ', CASE p_size % 2 WHEN 0 THEN 'CVSS: ' ELSE 'score  ' END, p_size % 10, '.5', chr(10), 'Affected:  alpha, ', p_name, ' ,beta ', p_size, chr(10))")
_refine("auto", "concat('VIN 1HGCM82633A', 100000 + p_partkey % 900000, '. ', CASE p_size % 3 WHEN 0 THEN 'Part: ab-' WHEN 1 THEN 'part number #Xy-' ELSE 'Parts ' END, p_size, ' and P/N: XY-9')")
_refine("bio", "concat(CASE p_size % 3 WHEN 0 THEN 'Project: abc-' WHEN 1 THEN 'lab id #x' ELSE 'None ' END, p_size, ' of H2O and NaCl with C6H12O', p_size, '. ', CASE p_size % 2 WHEN 0 THEN 'SOP: wash twice.' ELSE 'method  ' END, p_type, chr(10))")
_refine("grant", "concat('fon: AB-12345-', p_size, '. Up to ', CASE p_size % 3 WHEN 0 THEN 'nothing' ELSE '$ ' END, p_size, ',500.00 then $9', chr(10), 'deadline:   May ', p_size, chr(10))")
_refine("political", "concat(CASE p_size % 3 WHEN 0 THEN 'SENATOR: jane doe' WHEN 1 THEN 'Mayor  J. Roe' ELSE 'Nobody' END, ', ', CASE p_size % 4 WHEN 0 THEN 'Vote: nay' WHEN 1 THEN 'RESULT:YEA' WHEN 2 THEN 'action: Abstain' ELSE 'Vote: maybe' END, '. Donor: Acme & Co, PAC: Beta Fund. $', p_size, ',000 and $100')")
_refine("museum", "concat('accession number: 1987.', p_size, '.3', chr(10), CASE p_size % 3 WHEN 0 THEN 'Artist: Claude Monet' WHEN 1 THEN 'Maker: Vincent van Gogh' ELSE 'artist: nobody' END, ', ', CASE p_size % 4 WHEN 0 THEN 'Era: late 19th' WHEN 1 THEN 'PERIOD:  EDO PERIOD' WHEN 2 THEN 'date: Circa 1900' ELSE 'Era: ' END, chr(10), 'Medium: oil, Canvas', chr(10))")
_refine("mfg", "concat('P/N: abc-', 1000 + p_partkey, '. ', CASE p_size % 2 WHEN 0 THEN 'Service: Every ' ELSE 'cycle  every  ' END, p_size, CASE p_size % 3 WHEN 0 THEN ' hours' WHEN 1 THEN ' DAYS' ELSE ' eons' END, '. error e', p_size % 9, '-', 100 + p_size, ' Fault: AB-12')")
_refine("edu", "concat(CASE p_size % 4 WHEN 0 THEN 'Grade: kindergarten' WHEN 1 THEN 'level  HIGHER ED' WHEN 2 THEN concat('grade:', p_size) ELSE concat('Grade: ', p_size) END, chr(10), 'SUBJECT: Modern Physics.', chr(10), 'ccss.m-', p_size, ' ')")
_refine("disaster", "concat(CASE p_size % 4 WHEN 0 THEN 'Incident: river flood' WHEN 1 THEN 'TYPE:  WILD FIRE' WHEN 2 THEN 'nature: Quake' ELSE 'Incident: x' END, '.', chr(10), 'At 12.34567,', CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE '   ' END, '-', p_size, '.55555 ', CASE p_size % 2 WHEN 0 THEN 'Priority: HIGH' ELSE 'severity:low' END)")
_refine("gaming", "concat(CASE p_size % 2 WHEN 0 THEN 'Patch 1.' ELSE 'VERSION: 2.' END, p_size, '.2b Hero: Alpha Beta, Champion: Zed', CASE p_size % 3 WHEN 0 THEN ', Agent: Zed' ELSE ', agent: low' END, '.')")
_refine("urban", "concat('Zone R', CASE p_size % 3 WHEN 0 THEN '-' WHEN 1 THEN ' ' ELSE '' END, p_size % 9, 'A with far of ', p_size, '.5 and ', CASE p_size % 2 WHEN 0 THEN 'Density: Mid rise' ELSE 'target is  9 units/acre' END, '.')")
_refine("spiritual", "concat('Read ', CASE p_size % 3 WHEN 0 THEN 'John ' WHEN 1 THEN '1  John   ' ELSE 'john ' END, p_size, ':16 and Mark 1:2-4')")
_refine("wellness", "concat('About ', 100 + p_size, CASE p_size % 3 WHEN 0 THEN ' kcal' WHEN 1 THEN 'CAL' ELSE ' joules' END, ' per bowl')")
_refine("ai", "concat('Model: Delta-', p_size, ' has ', p_size, CASE p_size % 4 WHEN 0 THEN ' Billion' WHEN 1 THEN '.5   million' WHEN 2 THEN 'b' ELSE ' T' END, ' weights')")


@query("refine_status_and_themes", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Restored' WHEN 1 THEN 'Original' END AS status, CASE WHEN p_size % 2 = 0 THEN ['Grace', 'Wisdom'] ELSE ['Covenant'] END AS themes FROM part")
def status_and_themes(spark, d):
    text = F.expr("concat(CASE p_size % 3 WHEN 0 THEN 'restored and missing' WHEN 1 THEN 'missing but original' ELSE 'plain' END, CASE WHEN p_size % 2 = 0 THEN ' knowledge and mercy' ELSE ' an oath' END)")
    c = table(spark, d, "part").select("p_partkey", text.alias("c"))
    return c.select("p_partkey", refiners.status_word(F.col("c")).alias("status"), refiners.themes(F.col("c")).alias("themes"))


MEALS = "(['3 g protein, 9g Carbs, ' || p_size || ' g Protein and 7.5 g carbohydrates', 'Protein: ' || p_size || 'g, Fat: 5.5g, Carbs: 45g. Contains nuts, Soy', 'CARBOHYDRATES ' || p_size || ' g; fat:3 g fat 4g eggs or peanuts', 'Fat 1' || p_size || '0g shellfish, gluten-free'])[p_partkey % 4 + 1]"
GRAMS = r"regexp_extract(list_last(list_filter(regexp_extract_all(c, '(?i)\b\d{1,3}(?:\.\d)?\s*g\s*(?:Protein|Fat|Carbs|Carbohydrates)\b|\b(?:Protein|Fat|Carbs|Carbohydrates)[:\s]*\d{1,3}(?:\.\d)?\s*g\b'), lambda x: contains(lower(x), '%s'))), '\d{1,3}(?:\.\d)?')"


@query(
    "refine_macros",
    f"WITH m AS (SELECT p_partkey, {MEALS} AS c FROM part) SELECT p_partkey, "
    + ", ".join(f"try_cast({GRAMS % word} AS DOUBLE) AS {name}" for name, word in (("protein", "protein"), ("fat", "fat"), ("carbs", "carb")))
    + r", list_filter(['Gluten', 'Dairy', 'Nuts', 'Peanuts', 'Soy', 'Shellfish', 'Eggs'], lambda a: regexp_matches(c, '(?i)\b' || a || '\b')) AS allergens FROM m",
)
def macros(spark, d):
    meals = [
        F.expr("concat('3 g protein, 9g Carbs, ', p_size, ' g Protein and 7.5 g carbohydrates')"),
        F.expr("concat('Protein: ', p_size, 'g, Fat: 5.5g, Carbs: 45g. Contains nuts, Soy')"),
        F.expr("concat('CARBOHYDRATES ', p_size, ' g; fat:3 g fat 4g eggs or peanuts')"),
        F.expr("concat('Fat 1', p_size, '0g shellfish, gluten-free')"),
    ]
    c = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*meals), (F.col("p_partkey") % 4 + 1).cast("int")).alias("c"))
    m = refiners.macros(F.col("c"))
    of = [F.try_element_at(m, F.lit(name)).alias(name.lower()) for name in ("Protein", "Fat", "Carbs")]
    return c.select("p_partkey", *of, refiners.allergens(F.col("c")).alias("allergens"))


@query("html_documents")
def html(spark, d):
    return pages.html_documents(table(spark, d, "pages"))


@query("url_types", r"SELECT page_id, CASE WHEN regexp_matches(regexp_extract(url, '^[^?#]*'), '(?i)/[^/]*\.html?$') THEN 'html' ELSE 'web' END AS type FROM pages")
def url_types(spark, d):
    return table(spark, d, "pages").select("page_id", pages.type_of_url(F.col("url")).alias("type"))


@query("url_domains", r"SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def url_domains(spark, d):
    return table(spark, d, "pages").groupBy(F.try_parse_url("url", F.lit("HOST")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("byte_types", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'json' WHEN 3 THEN 'gzip' ELSE 'html' END AS type FROM pages")
def byte_types(spark, d):
    data = F.expr("CASE page_id % 5 WHEN 0 THEN cast('%PDF-1.4' AS binary) WHEN 1 THEN unhex('89504E470D0A') WHEN 2 THEN cast('  {\"a\":1}' AS binary) WHEN 3 THEN unhex('1F8B0800') ELSE cast('<!DOCTYPE html><html>' AS binary) END")
    return table(spark, d, "pages").select("page_id", pages.type_of_bytes(data).alias("type"))


@query("jsonl_round_trip", "SELECT doc_id, lang AS library, md5(text) AS digest FROM documents")
def jsonl(spark, d):
    path = scratch.scratch(spark, "jsonl")
    pages.write_jsonl(chunks(spark, d), path)
    good, _ = pages.read_jsonl(spark, path, "doc_id long, content string, library string")
    return good.select("doc_id", "library", F.md5("content").alias("digest"))


@query("jsonl_malformed", "SELECT (SELECT count(*) FROM documents WHERE doc_id % 7 <> 0) AS good, (SELECT count(*) FROM documents WHERE doc_id % 7 = 0) AS bad")
def malformed(spark, d):
    path = scratch.scratch(spark, "jsonl")
    c = chunks(spark, d)
    c.select(F.when(F.col("doc_id") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("doc_id", "library"))).alias("value")).write.text(path)
    good, bad = pages.read_jsonl(spark, path, "doc_id long, library string")
    return good.agg(F.count(F.lit(1)).alias("good")).crossJoin(bad.agg(F.count(F.lit(1)).alias("bad")))


@query("csv_round_trip", "SELECT p_partkey, p_name, p_retailprice FROM part")
def csv(spark, d):
    path = scratch.scratch(spark, "csv")
    table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice").write.option("header", True).option("escape", '"').csv(path)
    return spark.read.schema("p_partkey long, p_name string, p_retailprice double").option("header", True).option("escape", '"').csv(path)


@query("partitioned_round_trip", "SELECT doc_id, lang AS library FROM documents WHERE lang = 'de'")
def partitioned(spark, d):
    path = scratch.scratch(spark, "by-library")
    chunks(spark, d).select("doc_id", "library").write.partitionBy("library").parquet(path)
    return spark.read.schema("doc_id long, library string").parquet(path).where("library = 'de'")


@query("notebook_cells", "SELECT p_partkey AS id, unnest([0, 1])::INT AS cell_no, unnest(['markdown', 'code']) AS cell_type, unnest(['# ' || p_name, 'x = ' || p_size || 'print(x)']) AS source FROM part")
def notebooks(spark, d):
    body = F.expr("to_json(named_struct('cells', array(named_struct('cell_type', 'markdown', 'source', array(concat('# ', p_name))), named_struct('cell_type', 'code', 'source', array(concat('x = ', p_size), 'print(x)')))))")
    return pages.notebook_cells(table(spark, d, "part").select(F.col("p_partkey").alias("id"), body.alias("body")))


@query("gedcom_records", "SELECT c_custkey AS file, 'I1' AS ref, 'INDI' AS kind, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex FROM customer")
def gedcom(spark, d):
    body = F.expr("array('0 HEAD', '1 SOUR x', '0 @I1@ INDI', concat('1 NAME ', c_name), concat('1 SEX ', if(c_custkey % 2 = 0, 'F', 'M')), '1 NAME other', '0 TRLR')")
    lines = table(spark, d, "customer").select(F.col("c_custkey").alias("file"), F.posexplode(body).alias("line_no", "value"))
    return pages.gedcom_records(lines)


EDGES = "e AS (SELECT DISTINCT l_suppkey AS src, (l_partkey % 100) + 1 AS dst FROM lineitem)"


def _edges(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100 + 1).alias("dst")).distinct()


@query("graph_degrees", f"WITH {EDGES}, o AS (SELECT src AS node, count(*) AS n FROM e GROUP BY 1), i AS (SELECT dst AS node, count(*) AS n FROM e GROUP BY 1) SELECT coalesce(o.node, i.node) AS node, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM o FULL JOIN i ON o.node = i.node")
def degrees(spark, d):
    return graph.degrees(_edges(spark, d))


@query("graph_statistics", f"WITH {EDGES}, n AS (SELECT src AS v FROM e UNION ALL SELECT dst FROM e), g AS (SELECT v, count(*) AS k FROM n GROUP BY 1) SELECT count(*) AS nodes, (SELECT count(*) FROM e) AS edges, round((SELECT count(*) FROM e) / (count(*) * (count(*) - 1)), 9) AS density, round(avg(k), 6) AS average_degree, max(k) AS largest_degree FROM g")
def statistics(spark, d):
    return graph.statistics(_edges(spark, d))


@query("graph_neighbors", f"WITH {EDGES} SELECT DISTINCT node FROM (SELECT dst AS node FROM e WHERE src = 5 UNION SELECT src FROM e WHERE dst = 5) WHERE node <> 5")
def neighbors(spark, d):
    return graph.neighbors(_edges(spark, d), 5)


@query("graph_components", "WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, l_orderkey // 7 * 7 AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON r.node = u.a) SELECT node, min(c) AS component FROM r GROUP BY 1")
def components(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), (F.floor(F.col("l_orderkey") / 7) * 7).alias("dst")).distinct()
    return graph.connected(e)


@query("graph_pagerank")
def pagerank(spark, d):
    return graph.pagerank(_edges(spark, d), rounds=10).select("node", F.round("rank", 9).alias("rank"))


@query("graph_hits")
def hits(spark, d):
    return graph.hits(_edges(spark, d), 5).select("node", F.round("hub", 9).alias("hub"), F.round("authority", 9).alias("authority"))


@query("graph_paths", f"WITH {EDGES} SELECT [a.src, a.dst] AS path, 1 AS hops FROM e a WHERE a.src = 3 AND a.dst = 40 UNION ALL SELECT [a.src, b.src, b.dst], 2 FROM e a JOIN e b ON a.dst = b.src WHERE a.src = 3 AND b.dst = 40 AND a.dst NOT IN (3, 40) UNION ALL SELECT [a.src, b.src, c.src, c.dst], 3 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src WHERE a.src = 3 AND c.dst = 40 AND a.dst NOT IN (3, 40) AND b.dst NOT IN (3, 40) AND a.dst <> b.dst")
def paths(spark, d):
    return graph.paths(_edges(spark, d), 3, 40, 3)


@query("graph_cycles", f"WITH {EDGES}, f AS (SELECT * FROM e WHERE src <> dst) SELECT [a.src, a.dst] AS path FROM f a JOIN f b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst UNION ALL SELECT [a.src, b.src, c.src] FROM f a JOIN f b ON a.dst = b.src JOIN f c ON b.dst = c.src AND c.dst = a.src WHERE a.src < b.src AND a.src < c.src AND b.src <> c.src")
def cycles(spark, d):
    return graph.cycles(_edges(spark, d), 3)


@query("graph_ego", f"WITH {EDGES}, n1 AS (SELECT 5 AS node UNION SELECT dst FROM e WHERE src = 5 UNION SELECT src FROM e WHERE dst = 5) SELECT src, dst FROM e WHERE src IN (SELECT node FROM n1) AND dst IN (SELECT node FROM n1)")
def ego(spark, d):
    return graph.ego(_edges(spark, d), 5, 1)


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return ingest.windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("stream_ingest", "SELECT doc_id, lang AS library FROM documents WHERE n_chars >= 100")
def stream_ingest(spark, d):
    source = table(spark, d, "documents")
    folder, out, checkpoint = (scratch.scratch(spark, f"stream-{x}") for x in ("in", "out", "checkpoint"))
    source.write.parquet(folder)
    stream = ingest.stream_table(spark, folder, source.schema)
    ingest.run_once(stream, lambda s: s.where("n_chars >= 100").select("doc_id", F.col("lang").alias("library")), out, checkpoint)
    return spark.read.schema("doc_id long, library string").parquet(out)


@query("stream_new_contents", "SELECT sha256(text) AS content_hash FROM documents GROUP BY 1")
def stream_new(spark, d):
    source = chunks(spark, d).select("doc_id", "content")
    folder, out, checkpoint = (scratch.scratch(spark, f"stream-{x}") for x in ("in", "out", "checkpoint"))
    source.write.parquet(folder)
    ingest.run_once(ingest.stream_table(spark, folder, source.schema), lambda s: ingest.new_contents(s).select("content_hash"), out, checkpoint)
    return spark.read.schema("content_hash string").parquet(out)
