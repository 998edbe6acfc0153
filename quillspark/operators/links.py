"""Links between rows: by entity, citation, time and kinship; key-value texts; metadata merges; exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_time(rows: DataFrame, id_col: str, year: str, most: int, within: str) -> DataFrame:
    """Pairs (a < b) of equal `within` at most `most` years apart: each row meets the years of its window, an equi-join instead
    of a range scan. `within` (an entity, a library) bounds the result, which is quadratic in the rows of one of its values
    and a year; rows without id, year or `within` have no links.
    """
    r = rows.select(F.col(id_col).alias("id"), F.col(within).alias("w"), F.col(year).alias("y"))
    left = r.select(F.col("id").alias("a"), "w", F.explode(F.sequence(F.col("y") - most, F.col("y") + most)).alias("y"))
    return left.join(r.select(F.col("id").alias("b"), "w", "y"), ["w", "y"]).where("a < b").select("a", "b").distinct()


def by_entity(mentions: DataFrame, most: int = 5) -> DataFrame:
    """mentions (artifact, entity) -> links a -> b that share an entity, the first `most` partners of each artifact and entity."""
    m = mentions.distinct()
    x, y = m.alias("x"), m.alias("y")
    pairs = x.join(y, (F.col("x.entity") == F.col("y.entity")) & (F.col("x.artifact") != F.col("y.artifact"))).select(F.col("x.artifact").alias("a"), F.col("y.artifact").alias("b"), F.col("x.entity").alias("entity"))
    return pairs.withColumn("__r", F.row_number().over(Window.partitionBy("a", "entity").orderBy("b"))).where(F.col("__r") <= most).drop("__r")


def family(families: DataFrame) -> DataFrame:
    """families (husb, wife, children array) -> edges src, relation, dst."""
    spouse = families.where("husb IS NOT NULL AND wife IS NOT NULL").select(F.col("husb").alias("src"), F.lit("spouse_of").alias("relation"), F.col("wife").alias("dst"))
    child = families.select(F.array_compact(F.array("husb", "wife")).alias("p"), F.explode("children").alias("dst")).select(F.explode("p").alias("src"), F.lit("parent_of").alias("relation"), "dst")
    return spouse.unionByName(child).distinct()


def key_values(rows: DataFrame, id_col: str, content: str, lines: int = 100) -> DataFrame:
    """id, key, value of lines `key: value` or `key=value` among the first `lines`; quotes at the ends of a value go."""
    line = rows.select(F.col(id_col), F.posexplode(F.slice(F.split(F.col(content), "\n"), 1, lines)).alias("line_no", "line"))
    pattern = r"^\s*([A-Za-z_][A-Za-z0-9_ -]*?)\s*[:=]\s*(.+?)\s*$"
    out = line.where(F.col("line").rlike(pattern)).select(id_col, "line_no", F.regexp_extract("line", pattern, 1).alias("key"), F.regexp_replace(F.regexp_extract("line", pattern, 2), "^[\"']|[\"']$", "").alias("value"))
    return out.select(id_col, "line_no", F.lower("key").alias("key"), "value")


def merge_maps(base: Column, updates: Column) -> Column:
    """Entries of both; updates win."""
    keep = F.map_filter(base, lambda k, v: ~F.map_contains_key(updates, k))
    return F.map_concat(keep, updates)


def nearest(boxes: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each box (page, box, x, y) the nearest block (page, block, x, y) of its page by centre distance, ties by block."""
    b = blocks.select("page", "block", F.col("x").alias("bx"), F.col("y").alias("by"))
    d = F.sqrt(F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("by"), 2))
    joined = boxes.join(b, "page").withColumn("distance", d)
    best = joined.groupBy("page", "box").agg(F.min(F.struct("distance", "block")).alias("m"))
    return best.select("page", "box", F.col("m.block").alias("block"), F.round("m.distance", 6).alias("distance"))


def json_ld(rows: DataFrame, id_col: str, kind: str, fields: list[str]) -> DataFrame:
    """id and a Schema.org record as JSON text."""
    return rows.select(F.col(id_col), F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type"), F.col(id_col).cast("string").alias("identifier"), *fields)).alias("json"))


def outline(rows: DataFrame, id_col: str, content: str) -> DataFrame:
    """Numbered headings (1, 1.2, 1.2.3 ...) of each text: line number, number, title, depth and the parent's number."""
    line = rows.select(F.col(id_col), F.posexplode(F.split(F.col(content), "\n")).alias("line_no", "line"))
    pattern = r"^\s*([0-9]+(?:\.[0-9]+)*)\.?\s+(\S.*)$"
    number = F.regexp_extract("line", pattern, 1)
    return line.where(F.col("line").rlike(pattern)).select(id_col, "line_no", number.alias("number"), F.trim(F.regexp_extract("line", pattern, 2)).alias("title"), F.size(F.split(number, r"\.")).alias("depth"), F.regexp_replace(number, r"\.?[0-9]+$", "").alias("parent"))


def line_kind(line: Column) -> Column:
    """heading, list, code, table, quote, blank or text, by the first form that fits."""
    kinds = [("blank", r"^\s*$"), ("heading", r"^#{1,6} "), ("list", r"^\s*(?:[-*+]|[0-9]+[.)]) "), ("table", r"^\s*\|.*\|\s*$"), ("quote", r"^\s*> "), ("code", r"^(?: {4}|\t|```)")]
    out = F.lit("text")
    for name, pattern in reversed(kinds):
        out = F.when(line.rlike(pattern), name).otherwise(out)
    return out


def dated_events(rows: DataFrame, id_col: str, content: str) -> DataFrame:
    """Month-day-year dates and years of 'in/during/by YYYY' phrases of each text, as dates: id, event_date, form."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    full = F.transform(F.regexp_extract_all(F.col(content), F.lit(rf"\b((?:{months}) [0-9]{{1,2}}, [0-9]{{4}})\b"), F.lit(1)), lambda x: F.struct(F.try_to_date(x, "MMMM d, yyyy").alias("event_date"), F.lit("day").alias("form")))
    year = F.transform(F.regexp_extract_all(F.col(content), F.lit(r"\b(?:[Ii]n|[Dd]uring|[Bb]y) ([0-9]{4})\b"), F.lit(1)), lambda x: F.struct(F.try_to_date(F.concat(x, F.lit("-01-01"))).alias("event_date"), F.lit("year").alias("form")))
    return rows.select(F.col(id_col), F.explode(F.concat(full, year)).alias("e")).select(id_col, "e.event_date", "e.form").where("event_date IS NOT NULL")


def rules_of_hosts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id and the longest rule (host suffix, verdict) of its host: hosts meet rules on their suffixes, an equi-join."""
    host = F.lower(F.regexp_extract("url", r"://([^/?#:]+)", 1))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, 100), "."))
    hits = pages.select("page_id", F.explode(suffixes).alias("suffix")).join(rules, "suffix")
    best = hits.groupBy("page_id").agg(F.max_by(F.struct("suffix", "verdict"), F.length("suffix")).alias("b"))
    return pages.select("page_id").join(best, "page_id", "left").select("page_id", F.col("b.suffix").alias("suffix"), F.coalesce("b.verdict", F.lit("allow")).alias("verdict"))
