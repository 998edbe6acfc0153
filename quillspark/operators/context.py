"""From hits to what a model is given: routing by domain, ranking by nearness of terms, context windows.

Windows are built for many queries at once: rows carry the query they were found by. Copies fold in a grouped
aggregate with a map-side part, a ranked cut bounds every query's rows, and the greedy choice is one fold
over these rows in a JVM expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text

#: By domain the factors of keyword and vector scores, needed metadata, boosted fields, tools.
STRATEGIES = {
    "legal": (1.2, 1.0, ["docket_number", "jurisdiction", "citation"], {"citation": 2.0, "court": 1.5}, ["legal_citation_resolver"]),
    "tech": (1.1, 0.9, ["language", "imports"], {"function_name": 2.0, "class_name": 2.0}, ["tree_sitter_lookup"]),
    "pkm": (0.8, 1.2, ["aliases", "tags"], {"aliases": 1.5}, ["wikilink_resolver"]),
    "cyber": (1.3, 1.0, ["src_ip", "event_id", "cve_id"], {"cve_id": 3.0, "event_id": 2.0}, ["attack_mapper", "timeline_builder"]),
    "genealogy": (1.1, 1.0, ["birth_date", "parent_of"], {"name": 2.0}, ["family_tree_walker"]),
    "rpg": (1.0, 1.1, ["rpg_type", "rpg_stats"], {"rpg_type": 1.5}, ["stat_block_viewer"]),
    "urban": (1.2, 1.0, ["urban_zoning_code", "urban_far_ratio"], {"urban_zoning_code": 2.5}, []),
    "ai_safety": (1.0, 1.2, ["ai_model_name", "ai_param_count"], {"ai_model_name": 2.0}, []),
    "gaming": (1.1, 1.0, ["game_stat_changes", "game_patch_ver"], {"game_stat_changes": 1.5}, []),
    "auto": (1.4, 1.0, ["auto_vin", "auto_part_number"], {"auto_part_number": 3.0, "auto_vin": 2.0}, []),
    "bio": (1.2, 1.0, ["bio_experiment_id", "bio_lab_ref"], {"bio_experiment_id": 2.0}, []),
    "museum": (1.0, 1.1, ["museum_artist", "museum_era"], {"museum_artist": 2.0}, []),
    "spiritual": (1.2, 1.0, ["spiritual_scripture", "spiritual_verse_ref"], {"spiritual_verse_ref": 2.0}, []),
    "wellness": (1.1, 1.0, ["wellness_calories", "wellness_macros"], {"wellness_macros": 1.5}, []),
}
#: Words of a query whose nearness says nothing.
NEARNESS_STOPWORDS = """a an the and or but in on at to for of with by is are was were be been being have has had do does did will would
could should may might must this that these those it its as from""".split()


@dataclass
class Strategy:
    name: str = "default"
    modifiers: tuple[float, float] = (1.0, 1.0)
    required: list[str] = field(default_factory=list)
    boosts: dict[str, float] = field(default_factory=dict)
    tools: list[str] = field(default_factory=list)


def strategy(domains: list[str]) -> Strategy:
    """The strategy of a query's domains: mean factors, the largest boost of a field, all metadata and tools, sorted.

    Domains without a strategy count for nothing; with none left it is the default.
    """
    met = [d.lower() for d in domains if d.lower() in STRATEGIES]
    if not met:
        return Strategy()
    found = [STRATEGIES[d] for d in met]
    boosts: dict[str, float] = {}
    for name, factor in (b for s in found for b in s[3].items()):
        boosts[name] = max(factor, boosts.get(name, 0.0))
    mean = lambda i: sum(s[i] for s in found) / len(found)
    union = lambda i: sorted({x for s in found for x in s[i]})
    return Strategy(met[0] if len(domains) == 1 else "merged", (mean(0), mean(1)), union(2), boosts, union(4))


def nearness_terms(query: str) -> list[str]:
    """Runs of a-z of two letters or more that are no stop words, in order, repeated ones too."""
    return [w for w in re.findall(r"\b[a-zA-Z]+\b", query.lower()) if len(w) >= 2 and w not in NEARNESS_STOPWORDS]


def nearness(content: Column, terms: list[str], window: int = 50) -> Column:
    """Struct of a text against a query's terms: coverage, min_span, avg_distance, clusters, nearness (0 to 1).

    Terms are found anywhere, also within words, and all their places count. min_span: characters of the shortest
    stretch with every term that occurs. clusters: places further than `window` from a cluster's first open the
    next. Spans and distances are 0 where fewer than two terms occur, and all is 0 without any, for null
    and empty texts, and without terms. Finding the places is an Arrow UDF, linear but for their sort.
    """
    distinct = list(dict.fromkeys(terms))

    @F.pandas_udf("struct<coverage double, min_span long, avg_distance double, clusters int, n_chars long>")
    def places(texts):
        import pandas as pd

        def one(value):
            low, at = (value or "").lower(), []
            for n, term in enumerate(distinct):
                i = low.find(term)
                while i >= 0:
                    at.append((i, n))
                    i = low.find(term, i + 1)
            at.sort()
            need = {n for _, n in at}
            coverage = len(need) / len(terms) if terms else 0.0
            clusters, first = 0, None
            for i, _ in at:
                if first is None or i - first > window:
                    clusters, first = clusters + 1, i
            if len(need) < 2:
                return coverage, 0, 0.0, clusters, len(value or "")
            seen, end, span = dict.fromkeys(need, 0), 0, None
            missing = len(need)
            for i, n in at:
                while missing and end < len(at):
                    missing -= seen[at[end][1]] == 0
                    seen[at[end][1]] += 1
                    end += 1
                if missing:
                    break
                last, m = at[end - 1]
                wide = last - i + len(distinct[m])
                span = wide if span is None or wide < span else span
                seen[n] -= 1
                missing += seen[n] == 0
            return coverage, span, (at[-1][0] - at[0][0]) / (len(at) - 1), clusters, len(value or "")

        rows = [one(value) for value in texts]
        return pd.DataFrame(rows, columns=["coverage", "min_span", "avg_distance", "clusters", "n_chars"])

    def scored(p: Column) -> Column:
        spread = F.when(p["min_span"] > 0, F.greatest(F.lit(0.0), 1 - p["min_span"] / p["n_chars"])).otherwise(0.0)
        distance = 1 - F.least(p["avg_distance"] / window, F.lit(1.0))
        bonus = F.least(p["clusters"] / 5, F.lit(1.0)) * 0.2
        total = F.greatest(F.lit(0.0), F.least(p["coverage"] * 0.4 + spread * 0.3 + distance * 0.2 + bonus, F.lit(1.0)))
        return F.struct(p["coverage"].alias("coverage"), p["min_span"].alias("min_span"), p["avg_distance"].alias("avg_distance"), p["clusters"].alias("clusters"), F.when(p["coverage"] > 0, total).otherwise(0.0).alias("nearness"))

    return text.let(places(content), scored)


def rank_by_nearness(hits: DataFrame, query: str, weight: float = 0.3, window: int = 50, content: str = "content") -> DataFrame:
    """hits with a score of (1 - weight) * score + weight * nearness, and the nearness; without terms both stay as they are, nearness 0."""
    if not 0 <= weight <= 1:
        raise ValueError("weight must lie between 0 and 1")
    terms = nearness_terms(query)
    if not terms:
        return hits.withColumn("nearness", F.lit(0.0))
    near = hits.withColumn("nearness", nearness(F.col(content), terms, window)["nearness"])
    return near.withColumn("score", F.col("score") * (1 - weight) + F.col("nearness") * weight)


def estimated_tokens(content: Column, per_word: float = 1.3) -> Column:
    """Blank-separated words times 1.3, whole; 0 for null and empty texts."""
    return F.floor(F.coalesce(F.size(text.blank_split(content)), F.lit(0)) * per_word).cast("long")


def windows(rows: DataFrame, by: str, unique: str, document: str, score: str = "score", content: str = "content", budget: int = 8000, each: int = 1, most: int = 100) -> DataFrame:
    """For every query (`by`) the rows that its model is given: by, unique, document, tokens, rank (from 1, best score first), used (tokens of all).

    Of rows with equal texts (lower-cased, blanks as one) the best stays. Of the `most` best, first come up to `each` of every
    document, documents in the order of their best row, then the rest, each if it still fits the budget; if nothing fits, the
    best row alone. Ties go to the smaller `unique`; a null score is the worst, a null text is empty, a null `by` is a query
    and a null document a document. Other columns may have any names.
    """
    low = F.lower(F.coalesce(F.col(content), F.lit("")))
    taken = rows.select(F.col(by).alias("by"), F.col(unique).alias("id"), F.col(document).alias("doc"), F.col(score).cast("double").alias("score"), estimated_tokens(F.col(content)).alias("tokens"), F.sha2(F.concat_ws(" ", text.blank_split(low)), 256).alias("text"))
    # the best of copies: the least struct by falling score, then id
    order = F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("o"), F.col("id").alias("id"), F.col("doc").alias("doc"), F.col("tokens").alias("tokens"))
    single = taken.groupBy("by", "text").agg(F.min(order).alias("r")).select("by", "r.*")
    best = single.withColumn("rank", F.row_number().over(Window.partitionBy("by").orderBy("o", "id"))).where(F.col("rank") <= most)
    of_document = Window.partitionBy("by", "doc").orderBy("rank")
    placed = best.withColumn("nth", F.row_number().over(of_document)).withColumn("first", F.first("rank").over(of_document))
    early = F.col("nth") <= each
    key = F.struct(F.when(early, 0).otherwise(1).alias("a"), F.when(early, F.col("first")).otherwise(F.col("rank")).alias("b"), F.col("rank").alias("rank"), "id", "doc", "tokens")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("ranks"))
    fits = lambda s, x: F.when(s["used"] + x["tokens"] <= budget, F.struct((s["used"] + x["tokens"]).alias("used"), F.array_append(s["ranks"], x["rank"]).alias("ranks"))).otherwise(s)
    folded = placed.groupBy("by").agg(F.array_sort(F.collect_list(key)).alias("items")).withColumn("t", F.aggregate("items", start, fits))
    kept = F.when(F.size("t.ranks") > 0, F.filter("items", lambda x: F.array_contains(F.col("t.ranks"), x["rank"]))).otherwise(F.filter("items", lambda x: x["rank"] == 1))
    chosen = folded.select("by", F.array_sort(F.transform(kept, lambda x: F.struct(x["rank"].alias("place"), x["id"].alias("id"), x["doc"].alias("doc"), x["tokens"].alias("tokens")))).alias("kept"))
    used = F.aggregate("kept", F.lit(0).cast("long"), lambda s, x: s + x["tokens"])
    out = chosen.select("by", used.alias("used"), F.posexplode("kept").alias("n", "x"))
    return out.select(F.col("by").alias(by), F.col("x.id").alias(unique), F.col("x.doc").alias(document), F.col("x.tokens").alias("tokens"), (F.col("n") + 1).alias("rank"), "used")


def factors(domains: Column) -> Column:
    """Struct (keyword, vector) of an array of domains: the mean factors that `strategy` gives, for many queries at once. Null: 1 and 1."""
    names = F.array(*[F.lit(n) for n in STRATEGIES])
    known = F.filter(F.coalesce(domains, F.array().cast("array<string>")), lambda x: F.array_contains(names, x))

    def mean(i: int) -> Column:
        table = F.map_from_arrays(names, F.array(*[F.lit(float(s[i])) for s in STRATEGIES.values()]))
        total = F.aggregate(known, F.lit(0.0), lambda s, x: s + F.element_at(table, x))
        return F.when(F.size(known) > 0, total / F.size(known)).otherwise(1.0)

    return F.struct(mean(0).alias("keyword"), mean(1).alias("vector"))
