"""Queries: table operators, aggregates, timelines, study statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import audit as audit_logs
from quillspark.operators import tables, timeline
from quillspark.schema import chunks, table

from .base import query


@query("filter_chain", "SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 200 AND 5000 AND lang = 'en' AND regexp_matches(source, '(?i)SRC1[0-9]')")
def filter_chain(spark, d):
    ok = tables.all_of(F.col("char_count").between(200, 5000), F.col("library") == "en", F.col("source_file").rlike("(?i)SRC1[0-9]"))
    return chunks(spark, d).where(ok).select("doc_id", F.col("char_count").alias("n_chars"))


@query("filter_topic", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'ontion')::INT + contains(lower(text), 'ering')::INT + contains(lower(text), 'license')::INT) / 3 >= 0.6")
def filter_topic(spark, d):
    return chunks(spark, d).where(tables.topic_share(F.col("content"), "ontion ering license") >= 0.6).select("doc_id")


@query("filter_dates", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-03-01' AND DATE '1995-03-31'")
def filter_dates(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderdate").cast("date").between("1995-03-01", "1995-03-31")).select("o_orderkey")


@query("filter_excluded_terms", "SELECT doc_id FROM documents WHERE NOT contains(lower(text), 'the') AND NOT contains(lower(text), 'license')")
def excluded(spark, d):
    low = F.lower("content")
    return chunks(spark, d).where(~F.contains(low, F.lit("the")) & ~F.contains(low, F.lit("license"))).select("doc_id")


@query("parse_times", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderkey % 10 <> 3")
def parse_times(spark, d):
    raw = F.when(F.col("o_orderkey") % 10 == 3, "not a date").when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, d, "orders").select("o_orderkey", tables.parse_time(raw).cast("date").alias("day")).where("day IS NOT NULL")


@query("libraries", "SELECT library FROM (SELECT DISTINCT lang AS library FROM documents UNION SELECT 'default') ORDER BY 1")
def libraries(spark, d):
    c = chunks(spark, d).select("library").distinct()
    return c.union(spark.createDataFrame([("default",)], "library string")).distinct()


@query("count_by_library", "SELECT lang AS library, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def count_by_library(spark, d):
    return chunks(spark, d).groupBy("library").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_file").alias("sources"))


@query("point_lookup", "SELECT doc_id, lang AS library, n_chars AS char_count FROM documents WHERE doc_id = 42")
def point(spark, d):
    return chunks(spark, d).where("doc_id = 42").select("doc_id", "library", "char_count").limit(1)


@query("chunks_of_document", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 7 ORDER BY l_linenumber")
def of_document(spark, d):
    return table(spark, d, "lineitem").where("l_orderkey = 7").select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_linenumber")


@query("delete_documents", "SELECT count(*) AS left_rows, count(DISTINCT l_orderkey) AS left_documents FROM lineitem WHERE l_orderkey % 5 <> 0")
def delete(spark, d):
    items = table(spark, d, "lineitem")
    gone = table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    left = items.join(gone, "l_orderkey", "left_anti")
    return left.agg(F.count(F.lit(1)).alias("left_rows"), F.countDistinct("l_orderkey").alias("left_documents"))


@query("upsert", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer UNION ALL SELECT c_custkey + 1000000, 'new' FROM customer WHERE c_custkey % 100 = 1")
def upsert(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_name")
    rows = base.where("c_custkey % 4 = 0").select("c_custkey", F.lit("new").alias("c_name")).unionByName(base.where("c_custkey % 100 = 1").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("new").alias("c_name")))
    return tables.upsert(base, rows, "c_custkey")


@query("reassign_library", "SELECT CASE WHEN lang = 'de' THEN 'german' ELSE lang END AS library, count(*) AS n FROM documents GROUP BY 1")
def reassign(spark, d):
    return chunks(spark, d).withColumn("library", F.when(F.col("library") == "de", "german").otherwise(F.col("library"))).groupBy("library").agg(F.count(F.lit(1)).alias("n"))


@query("tag_membership", "SELECT DISTINCT lower(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')) AS tag FROM part ORDER BY 1")
def all_tags(spark, d):
    from quillspark.functions import text

    return table(spark, d, "part").select(F.array(text.sanitize_tag(F.col("p_type"))).alias("tags")).select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


@query("unread", "SELECT lang AS library, count(*) AS n FROM documents WHERE NOT (doc_id % 3 = 0) GROUP BY 1")
def unread(spark, d):
    return chunks(spark, d).withColumn("is_read", F.col("doc_id") % 3 == 0).where(~F.col("is_read")).groupBy("library").agg(F.count(F.lit(1)).alias("n"))


@query("sync_delta", "SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0")
def delta(spark, d):
    c = table(spark, d, "customer")
    return tables.push_delta(c, c.where("c_custkey % 7 <> 0"), "c_custkey").select("c_custkey")


@query("sync_counts", "SELECT count_if(a) AS local, count_if(b) AS remote, count_if(a AND b) AS both, count_if(a AND NOT b) AS to_push, count_if(b AND NOT a) AS to_pull FROM (SELECT c_custkey % 3 <> 0 AS a, c_custkey % 5 <> 0 AS b FROM customer) WHERE a OR b")
def sync_counts(spark, d):
    c = table(spark, d, "customer")
    return tables.sync_counts(c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 5 <> 0"), "c_custkey")


@query("orphan_chunks", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 1)")
def orphans(spark, d):
    return tables.orphans(table(spark, d, "lineitem"), table(spark, d, "orders").where("o_orderkey % 4 <> 1"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("orphan_links", "SELECT l_partkey AS src, l_suppkey AS dst, CASE WHEN l_partkey % 11 = 0 THEN 'unknown source' ELSE 'unknown target' END AS reason FROM lineitem WHERE l_partkey % 11 = 0 OR l_suppkey % 11 = 0")
def orphan_links(spark, d):
    known = table(spark, d, "part").where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("node")).union(table(spark, d, "supplier").where("s_suppkey % 11 <> 0").select("s_suppkey"))
    return tables.link_orphans(table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")), known)


@query("split_by_size", "SELECT o_custkey, o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4)::BIGINT AS split FROM orders")
def split_size(spark, d):
    return tables.split_by_size(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_orderkey", 4, "o_custkey")


@query("split_by_topic", "WITH c AS (SELECT p_size::VARCHAR AS t, count(*) AS n FROM part GROUP BY 1) SELECT CASE WHEN n >= 40 THEN t ELSE 'other' END AS topic, sum(n)::BIGINT AS n FROM c GROUP BY 1")
def split_topic(spark, d):
    return tables.split_by_topic(table(spark, d, "part"), F.col("p_size").cast("string"), 40).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("split_by_source", "SELECT regexp_extract(source, '^([a-z]+)', 1) AS stem, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def split_source(spark, d):
    return chunks(spark, d).groupBy(F.regexp_extract("source_file", "^([a-z]+)", 1).alias("stem")).agg(F.count(F.lit(1)).alias("n"), F.sum("char_count").alias("chars"))


@query("merge_by_document", "SELECT conv_id, string_agg(text, E'\\n\\n' ORDER BY turn, text) AS text, count(*) AS parts FROM conversations GROUP BY 1")
def merge_document(spark, d):
    return tables.concat_by_parent(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("merge_records", "SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority, list(o_totalprice ORDER BY o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def merge_records(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return tables.merge_records(rows, "o_custkey", "o_orderkey", {"o_orderstatus": "first", "o_orderpriority": "last", "o_totalprice": "accumulate"})


@query("merge_records_unique", "SELECT o_custkey, len(list(DISTINCT o_orderpriority)) AS n FROM orders GROUP BY 1")
def merge_unique(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return tables.merge_records(rows, "o_custkey", "o_orderkey", {"o_orderpriority": "unique"}).select("o_custkey", F.size("o_orderpriority").cast("long").alias("n"))


@query("merge_libraries", "SELECT source, count(*) AS n FROM (SELECT 'customer' AS source, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier) GROUP BY 1")
def merge_libraries(spark, d):
    a = table(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_name").alias("name"))
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_name").alias("name"))
    return a.unionByName(b).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("validate_rows", "SELECT p_partkey, (CASE WHEN p_size > 40 THEN 1 ELSE 0 END + CASE WHEN p_retailprice < 950 THEN 1 ELSE 0 END + CASE WHEN length(p_name) > 12 THEN 1 ELSE 0 END)::INT AS errors FROM part WHERE p_size > 40 OR p_retailprice < 950 OR length(p_name) > 12")
def validate(spark, d):
    e = tables.validation_errors({"p_partkey": {"required": True}, "p_size": {"high": 40}, "p_retailprice": {"low": 950}, "p_name": {"length": 12}})
    return table(spark, d, "part").select("p_partkey", F.size(e).alias("errors")).where("errors > 0")


@query("validate_types", "SELECT doc_id, CASE WHEN regexp_full_match(substr(source, 4), '[0-9]+') AND substr(source, 4)::INT % 2 = 0 THEN [] ELSE ['v'] END AS bad FROM documents")
def validate_types(spark, d):
    v = F.when(F.substring("source_file", 4, 9).cast("int") % 2 == 0, F.substring("source_file", 4, 9)).otherwise(F.lit("x"))
    return chunks(spark, d).select("doc_id", v.alias("v")).select("doc_id", tables.cast_errors({"v": "int"}).alias("bad"))


@query("sort_table_descending", "SELECT c_custkey, lower(c_mktsegment) AS segment FROM customer ORDER BY CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE lower(c_mktsegment) END DESC NULLS FIRST, c_custkey LIMIT 50")
def sort_table(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("s"), F.lower("c_mktsegment").alias("segment"))
    return tables.sort_table(c, "s", True, "c_custkey").select("c_custkey", "segment").limit(50)


@query("adjacent_islands", "WITH r AS (SELECT DISTINCT o_custkey, o_orderkey // 3 AS n FROM orders), i AS (SELECT o_custkey, n, n - row_number() OVER (PARTITION BY o_custkey ORDER BY n) AS g FROM r) SELECT o_custkey, min(n)::BIGINT AS first, max(n)::BIGINT AS last, count(*) AS parts FROM i GROUP BY o_custkey, g")
def islands(spark, d):
    r = table(spark, d, "orders").select("o_custkey", F.floor(F.col("o_orderkey") / 3).alias("n")).distinct()
    return tables.adjacent_islands(r, "o_custkey", "n")


@query("changed_files", "SELECT doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 5 = 1 THEN 'modified' ELSE 'unchanged' END AS state FROM documents")
def changed(spark, d):
    now = chunks(spark, d).select(F.col("doc_id").alias("path"), F.sha2("content", 256).alias("hash"))
    old = now.where("path % 5 <> 0").withColumn("hash", F.when(F.col("path") % 5 == 1, F.lit("0")).otherwise(F.upper("hash")))
    return tables.changed_files(now, old).select("path", "state")


CHAIN = """
WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
c AS (
  SELECT user_id, event_id, n, repeat('0', 64) AS previous_hash, sha256(event_id || '|' || event_type || '|' || repeat('0', 64)) AS entry_hash FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.n, c.entry_hash, sha256(e.event_id || '|' || e.event_type || '|' || c.entry_hash) FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1)"""


def _chain(spark, d):
    return audit_logs.hash_chain(table(spark, d, "events").select("event_id", "user_id", "event_type"), "user_id", ["event_id"], ["event_id", "event_type"])


@query("hash_chain", f"{CHAIN} SELECT event_id, previous_hash, entry_hash FROM c")
def hash_chain(spark, d):
    return _chain(spark, d).select("event_id", "previous_hash", "entry_hash")


@query(
    "hash_chain_broken",
    """
WITH e AS (SELECT user_id, event_id, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) % 89 = 0, false) AS after_gone FROM events),
f AS (SELECT user_id, event_id, CASE WHEN after_gone THEN 'link' ELSE 'content' END AS fault FROM e WHERE event_id % 89 <> 0 AND (event_id % 97 = 0 OR after_gone))
SELECT user_id, min(event_id) AS event_id, min_by(fault, event_id) AS fault FROM f GROUP BY 1""",
)
def hash_chain_broken(spark, d):
    """The first broken entry of each user's log, after every 97th event was changed and every 89th taken out."""
    kept = _chain(spark, d).where("event_id % 89 <> 0")
    changed = kept.withColumn("event_type", F.when(F.col("event_id") % 97 == 0, F.concat("event_type", F.lit("!"))).otherwise(F.col("event_type")))
    found = audit_logs.first_broken(changed, "user_id", ["event_id"], ["event_id", "event_type"])
    return found.select("user_id", "event_id", "fault")


@query("audit_hashes", "SELECT count(*) AS total, count_if(doc_id % 10 <> 0) AS verified, count_if(doc_id % 10 = 0) AS failed FROM documents")
def audit(spark, d):
    rows = chunks(spark, d).select("doc_id", F.sha2("content", 256).alias("h"))
    golden = rows.select(F.col("doc_id").alias("g"), F.when(F.col("doc_id") % 10 == 0, "bad").otherwise(F.col("h")).alias("want"))
    j = rows.join(golden, rows["doc_id"] == golden["g"], "left")
    return j.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("h") == F.col("want")).alias("verified"), F.count_if(F.coalesce(F.col("h") != F.col("want"), F.lit(True))).alias("failed"))


@query("knowledge_audit", "SELECT lang AS library, count(*) AS n, min(n_chars) AS smallest, median(n_chars) AS middle, max(n_chars) AS largest, round(avg((doc_id IN (SELECT doc_id FROM labels))::INT), 6) AS labelled FROM documents GROUP BY 1")
def knowledge_audit(spark, d):
    l = table(spark, d, "labels").select("doc_id").distinct().withColumn("has", F.lit(1))
    c = chunks(spark, d).join(l, "doc_id", "left")
    return c.groupBy("library").agg(F.count(F.lit(1)).alias("n"), F.min("char_count").alias("smallest"), F.median("char_count").alias("middle"), F.max("char_count").alias("largest"), F.round(F.avg(F.coalesce("has", F.lit(0))), 6).alias("labelled"))


@query("log_classes", "SELECT CASE WHEN contains(event_type, 'error') THEN 'error' WHEN contains(event_type, 'click') THEN 'warn' ELSE 'info' END AS class, count(*) AS n FROM events GROUP BY 1")
def log_classes(spark, d):
    e = F.col("event_type")
    return table(spark, d, "events").groupBy(F.when(e.contains("error"), "error").when(e.contains("click"), "warn").otherwise("info").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("stage_statistics", "SELECT event_type, count(*) AS calls, round(100 * avg((value > 20)::INT), 6) AS success_rate, round(sum(value) / nullif(count_if(value > 20), 0), 6) AS latency_per_success, round(avg(value), 6) AS latency FROM events GROUP BY 1")
def stage_statistics(spark, d):
    ok = F.col("value") > 20
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(100 * F.avg(ok.cast("int")), 6).alias("success_rate"), F.round(F.sum("value") / F.nullif(F.count_if(ok), F.lit(0)), 6).alias("latency_per_success"), F.round(F.avg("value"), 6).alias("latency"))


@query("flatten_logs", "SELECT event_id, 'a' || user_id AS user, event_type AS event, '10.0.' || (user_id % 200) || '.7' AS src_ip, CASE event_id % 3 WHEN 0 THEN 'cloudtrail' WHEN 1 THEN 'ecs' ELSE 'syslog' END AS log_format FROM events")
def flatten_logs(spark, d):
    e = table(spark, d, "events")
    user, ip = F.concat(F.lit("a"), "user_id"), F.concat(F.lit("10.0."), F.col("user_id") % 200, F.lit(".7"))
    a = F.to_json(F.struct(F.lit("2024-01-01").alias("eventTime"), F.col("event_type").alias("eventName"), ip.alias("sourceIPAddress"), F.struct(user.alias("userName")).alias("userIdentity")))
    b = F.to_json(F.struct(F.struct(F.lit("8").alias("version")).alias("ecs"), F.struct(F.col("event_type").alias("action")).alias("event"), F.struct(ip.alias("ip")).alias("source"), F.struct(user.alias("name")).alias("user")))
    c = F.to_json(F.struct(F.lit("h").alias("HOST"), F.col("event_type").alias("PROGRAM"), ip.alias("SOURCEIP"), user.alias("USER")))
    body = e.select("event_id", F.when(F.col("event_id") % 3 == 0, a).when(F.col("event_id") % 3 == 1, b).otherwise(c).alias("body"))
    flat = body.select(F.col("event_id").alias("no"), *timeline.flatten_log(F.col("body")))
    return flat.select(F.col("no").alias("event_id"), "user", F.col("event_id").alias("event"), "src_ip", "log_format")


@query("mask_ip", "SELECT event_id, '10.' || (user_id % 5) || '.xxx.xxx' AS masked FROM events")
def mask(spark, d):
    return table(spark, d, "events").select("event_id", timeline.mask_ip(F.concat(F.lit("10."), F.col("user_id") % 5, F.lit(".1.2"))).alias("masked"))


@query("timeline_range", "SELECT event_id, event_type FROM events WHERE ts BETWEEN (SELECT min(ts) FROM events) AND (SELECT min(ts) FROM events) + INTERVAL 1 HOUR ORDER BY ts, event_id")
def timeline_range(spark, d):
    e = table(spark, d, "events")
    low = e.agg(F.min("ts")).first()[0]
    import datetime

    return timeline.between(e, F.lit(low), F.lit(low + datetime.timedelta(hours=1))).select("event_id", "event_type")


@query("actor_groups", "SELECT user_id, count(*) AS events, round(least(0.9::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * count(*)), 6) AS confidence FROM events GROUP BY 1 HAVING count(*) > 1")
def actors(spark, d):
    return timeline.actor_groups(table(spark, d, "events"), "user_id").select("user_id", "events", "confidence")


@query("anchored_groups", "WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), w AS (SELECT event_id, user_id, n, ts AS start, 0 AS group_no FROM e WHERE n = 1 UNION ALL SELECT e.event_id, e.user_id, e.n, CASE WHEN e.ts - w.start > INTERVAL 6 HOUR THEN e.ts ELSE w.start END, CASE WHEN e.ts - w.start > INTERVAL 6 HOUR THEN w.group_no + 1 ELSE w.group_no END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1) SELECT event_id, user_id, group_no::BIGINT AS group_no FROM w")
def anchored(spark, d):
    return timeline.anchored_groups(table(spark, d, "events"), "user_id", 6 * 3600)


@query("timeline_summary", "SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def timeline_summary(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("user_id").alias("users"))


@query("next_intervals", "WITH e AS (SELECT event_id, (event_id % 6)::INT AS q, (user_id % 20)::INT AS p FROM events), f AS (SELECT *, greatest(1.3::DOUBLE, 2.5::DOUBLE + 0.1::DOUBLE - (5 - q) * (0.08::DOUBLE + (5 - q) * 0.02::DOUBLE)) AS ease FROM e) SELECT event_id, CASE WHEN q < 3 THEN 1 WHEN p = 0 THEN 1 WHEN p = 1 THEN 6 ELSE floor(p * ease)::INT END AS interval_days, round(ease, 6) AS ease FROM f")
def intervals(spark, d):
    return table(spark, d, "events").select("event_id", *timeline.next_interval((F.col("event_id") % 6).cast("int"), (F.col("user_id") % 20).cast("int"), F.lit(2.5)))


@query("study_streaks", "WITH x AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events), i AS (SELECT user_id, d, d - (row_number() OVER (PARTITION BY user_id ORDER BY d))::INT AS g FROM x), r AS (SELECT user_id, g, count(*) AS days, max(d) AS last_day FROM i GROUP BY 1, 2) SELECT user_id, days, last_day FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last_day DESC) = 1")
def streaks(spark, d):
    return timeline.streak(table(spark, d, "events"), "ts", "user_id")


@query("study_accuracy", "SELECT user_id, round(100 * avg((value >= 30)::INT), 1) AS accuracy, count(*) AS reviews, max(ts) AS last_review FROM events GROUP BY 1")
def accuracy(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(100 * F.avg((F.col("value") >= 30).cast("int")), 1).alias("accuracy"), F.count(F.lit(1)).alias("reviews"), F.max("ts").alias("last_review"))


@query("study_mastery", "SELECT CASE WHEN n = 1 THEN 'NEW' WHEN v < 40 THEN 'LEARNING' WHEN v < 60 THEN 'REVIEWING' ELSE 'MATURE' END AS level, count(*) AS n FROM (SELECT user_id, count(*) AS n, avg(value) AS v FROM events GROUP BY 1) GROUP BY 1")
def mastery(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))
    return u.groupBy(F.when(F.col("n") == 1, "NEW").when(F.col("v") < 40, "LEARNING").when(F.col("v") < 60, "REVIEWING").otherwise("MATURE").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("due_cards", "SELECT count_if(o_orderdate IS NULL OR o_orderdate <= TIMESTAMP '1996-01-01') AS due, count(*) AS total FROM orders")
def due(spark, d):
    return table(spark, d, "orders").agg(F.count_if(F.col("o_orderdate").isNull() | (F.col("o_orderdate") <= F.lit("1996-01-01").cast("timestamp"))).alias("due"), F.count(F.lit(1)).alias("total"))


@query("grades", "SELECT user_id, CASE WHEN p >= 90 THEN 'A' WHEN p >= 80 THEN 'B' WHEN p >= 70 THEN 'C' WHEN p >= 60 THEN 'D' ELSE 'F' END AS grade FROM (SELECT user_id, 100 * avg((value >= 10)::INT) AS p FROM events GROUP BY 1)")
def grades(spark, d):
    p = F.col("p")
    u = table(spark, d, "events").groupBy("user_id").agg((100 * F.avg((F.col("value") >= 10).cast("int"))).alias("p"))
    return u.select("user_id", F.when(p >= 90, "A").when(p >= 80, "B").when(p >= 70, "C").when(p >= 60, "D").otherwise("F").alias("grade"))


@query("context_budget")
def context_budget(spark, d):
    rows = table(spark, d, "conversations").withColumn("words", F.size(F.split("text", r"\s+")))
    return timeline.budget(rows, "conv_id", [-F.col("turn")], "words", 300, "turn")


@query("smoothed_curve", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 3) AS smoothed FROM events")
def smoothed(spark, d):
    return timeline.smooth(table(spark, d, "events"), "user_id", "event_id", "value").select("event_id", "smoothed")


@query("durations", "SELECT l_orderkey, l_linenumber, (epoch_ms(l_shipdate) - epoch_ms(o_orderdate))::BIGINT AS ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def durations(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", (F.unix_millis(F.col("l_shipdate").cast("timestamp")) - F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("ms"))


@query("diverse_first", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def diverse(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r <= 2").select("o_custkey", "o_orderkey")
