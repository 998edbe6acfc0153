"""Lexical, vector and hybrid retrieval over a chunk table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text, vectors

#: Fusion weights (keyword, vector) by intent.
PROFILES = {"factual": (0.65, 0.35), "procedural": (0.55, 0.45), "conceptual": (0.50, 0.50), "comparative": (0.45, 0.55), "exploratory": (0.40, 0.60), "literary": (0.35, 0.65), "default": (0.40, 0.60)}
#: Score factors of authority levels.
AUTHORITY = {1: 1.25, 2: 1.15, 3: 1.05, 4: 1.00, 5: 0.90}


def postings(chunks: DataFrame, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    """Inverted index: (term, id, tf). One explode and one aggregate; write it once and search it many times."""
    return chunks.select(F.col(id_col).alias("id"), F.explode(text.search_tokens(F.col(content))).alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def lengths(chunks: DataFrame, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    """Tokens of each chunk, 0 included."""
    return chunks.select(F.col(id_col).alias("id"), F.size(text.search_tokens(F.coalesce(F.col(content), F.lit("")))).alias("dl"))


def _score_terms(chunks: DataFrame, query: list[str], tokens: Column, id_col: str, predicate: Column | None) -> DataFrame:
    """id, ok (the predicate), dl and one tf column for each query term; a projection without shuffle."""
    ok = F.lit(True) if predicate is None else F.coalesce(predicate, F.lit(False))
    counted = chunks.select(F.col(id_col).alias("id"), ok.alias("ok"), tokens.alias("t"))
    return counted.select("id", "ok", F.size("t").alias("dl"), *[F.size(F.filter("t", (lambda q: lambda w: w == q)(q))).alias(f"tf{i}") for i, q in enumerate(query)])


def bm25(chunks: DataFrame, query: str, top_k: int = 10, predicate: Column | None = None, id_col: str = "doc_id", content: str = "content", k1: float = 1.5, b: float = 0.75, delta: float = 0.5) -> DataFrame:
    """BM25+ scores over all chunks; (id, score), best first, ties by id.

    Statistics are one aggregate over the scan, then one broadcast row; the terms are counted where the
    chunk is read. The predicate acts before the cut to top_k. Repeated query terms count again.
    """
    terms = _query_terms(query)
    if not terms:
        return chunks.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    base = _score_terms(chunks, terms, text.search_tokens(F.coalesce(F.col(content), F.lit(""))), id_col, predicate)
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    joined = base.where(reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(terms))])).crossJoin(F.broadcast(stats))

    def part(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        return F.when(tf > 0, idf * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))) + delta)).otherwise(0.0)

    score = F.round(reduce(lambda x, y: x + y, [part(i) for i in range(len(terms))]), 6)
    return top(joined.where("ok").select("id", score.alias("score")).where("score > 0"), top_k)


def _query_terms(query: str) -> list[str]:
    import re

    return [w for w in re.findall(r"\w+", query.lower()) if len(w) > 1 and w not in text.SEARCH_STOPWORDS]


def top(scored: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def tfidf(chunks: DataFrame, query: str, top_k: int = 10, predicate: Column | None = None, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    """sum of tf * (1 + N / (1 + df)), tf = count / length; words of more than two characters, no stop words."""
    import re

    terms = list(dict.fromkeys(w for w in re.findall(r"\w+", query.lower()) if len(w) > 2))
    if not terms:
        return chunks.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    tokens = F.filter(text.words(F.coalesce(F.col(content), F.lit(""))), lambda w: F.length(w) > 2)
    base = _score_terms(chunks, terms, tokens, id_col, predicate)
    stats = base.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    joined = base.where("dl > 0").crossJoin(F.broadcast(stats))
    score = reduce(lambda x, y: x + y, [F.col(f"tf{i}") / F.col("dl") * (1 + F.col("n") / (1 + F.col(f"df{i}"))) for i in range(len(terms))])
    return top(joined.where("ok").select("id", F.round(score, 6).alias("score")).where("score > 0"), top_k)


def vector_top(rows: DataFrame, query, top_k: int = 10, predicate: Column | None = None, id_col: str = "vec_id", vector: str = "embedding", threshold: float | None = None) -> DataFrame:
    """Cosine top-k. Rows without a vector are left out; the predicate acts before the cut."""
    found = rows.where(F.col(vector).isNotNull())
    if predicate is not None:
        found = found.where(predicate)
    scored = found.select(F.col(id_col).alias("id"), F.round(vectors.cosine(F.col(vector), vectors.query_vector(query)), 6).alias("score"))
    return top(scored if threshold is None else scored.where(F.col("score") >= threshold), top_k)


def ranked(lists: dict[str, DataFrame]) -> DataFrame:
    """Union of scored lists with their ranks: source, priority, id, score, rank (from 1)."""
    parts = [df.select(F.lit(name).alias("source"), F.lit(i).alias("priority"), "id", "score") for i, (name, df) in enumerate(lists.items())]
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "id")))


def fuse_rrf(lists: dict[str, DataFrame], k: int = 60, top_k: int = 10, weights: dict[str, float] | None = None, most: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (k + rank)."""
    every = ranked(lists) if most is None else ranked(lists).where(F.col("rank") <= most)
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source") == name, F.lit(w)).otherwise(weight)
    return top(every.groupBy("id").agg(F.round(F.sum(weight / (k + F.col("rank"))), 6).alias("score")), top_k)


def scaled_by_max(df: DataFrame) -> DataFrame:
    """score / largest score; no rows if that isn't positive."""
    most = df.agg(F.max("score").alias("most"))
    return df.crossJoin(F.broadcast(most)).where("most > 0").select("id", (F.col("score") / F.col("most")).alias("score"))


def fuse_weighted(lexical: DataFrame, semantic: DataFrame, weights: tuple[float, float] = PROFILES["default"], top_k: int = 10) -> DataFrame:
    """Weighted sum of both lists' scores over their maxima; a missing score counts 0."""
    a, b = (scaled_by_max(df).withColumnRenamed("score", s) for df, s in ((lexical, "a"), (semantic, "b")))
    both = a.join(b, "id", "full_outer")
    return top(both.select("id", F.round(weights[0] * F.coalesce("a", F.lit(0.0)) + weights[1] * F.coalesce("b", F.lit(0.0)), 6).alias("score")), top_k)


def normalize_min_max(scores: DataFrame, by: str = "provider") -> DataFrame:
    """(score - min) / (max - min) of the provider; without a range 1 for positive scores, else 0."""
    w = Window.partitionBy(by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn("normalized", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise((F.col("score") > 0).cast("double")))


def normalize_z(scores: DataFrame, by: str = "provider") -> DataFrame:
    """Logistic of the population z-score; 0.5 without spread."""
    w = Window.partitionBy(by)
    mean, spread = F.avg("score").over(w), F.stddev_pop("score").over(w)
    return scores.withColumn("normalized", F.when(spread > 0, 1 / (1 + F.exp(-(F.col("score") - mean) / spread))).otherwise(0.5))


def fuse_providers(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of min-max scores by id; equal weights by default."""
    norm = normalize_min_max(scores)
    if weights is None:
        n = scores.select("provider").distinct().count()
        weight = F.lit(1.0 / max(n, 1))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("provider") == name, F.lit(w)).otherwise(weight)
    return norm.groupBy("id").agg(F.round(F.sum(weight * F.col("normalized")), 6).alias("score"))


def first_hits(lists: dict[str, DataFrame]) -> DataFrame:
    """First-wins union: one row per id, from the first list that has it."""
    every = ranked(lists)
    return every.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("priority", "rank"))).where("__n = 1").drop("__n")


def authority_boost(document: Column, level: Column | None = None, rules: list[tuple[str, int]] = ()) -> Column:
    """Factor of an explicit level, else of the first glob rule that fits, else 1."""
    out = F.lit(1.0)
    for glob, rule_level in reversed(list(rules)):
        pattern = "(?i)" + glob.replace("*", ".*").replace("?", ".")
        out = F.when(document.rlike(pattern), F.lit(AUTHORITY.get(rule_level, 1.0))).otherwise(out)
    if level is not None:
        table = F.create_map(*[F.lit(x) for pair in AUTHORITY.items() for x in pair])
        given = F.expr("try_cast(NULL AS int)") if level is None else level.try_cast("int")
        out = F.when(given.isNotNull(), F.coalesce(F.try_element_at(table, given), F.lit(1.0))).otherwise(out)
    return out


def metadata_boost(score: Column, metadata: Column, query: str, boosts: dict[str, float]) -> Column:
    """score times each field's weight whose value is contained in the query."""
    low = F.lit(query.lower())
    for name, weight in boosts.items():
        value = F.lower(F.try_element_at(metadata, F.lit(name)))
        score = F.when(F.coalesce((value != "") & F.contains(low, value), F.lit(False)), score * weight).otherwise(score)
    return score


def term_rerank(hits: DataFrame, query: str, top_k: int = 10, content: str = "content", title: str = "section_title") -> DataFrame:
    """0.4 coverage + 0.3 title + 0.2 phrase + 0.1 score over terms of three letters or more; hits: id, score, content, title."""
    terms = [t for t in query.lower().split() if len(t) >= 3]
    if not terms:
        return top(hits, top_k)
    low, head = F.lower(F.col(content)), F.lower(F.coalesce(F.col(title), F.lit("")))
    share = lambda where: reduce(lambda x, y: x + y, [F.contains(where, F.lit(t)).cast("int") for t in terms]) / len(terms)
    score = 0.4 * share(low) + 0.3 * share(head) + 0.2 * F.contains(low, F.lit(query.lower())).cast("int") + 0.1 * F.col("score")
    return top(hits.withColumn("score", F.round(score, 6)), top_k)


def blended_weights(intent: str, modifiers: tuple[float, float] = (1.0, 1.0)) -> tuple[float, float]:
    """The intent's profile times domain modifiers, scaled to a sum of 1."""
    a, b = PROFILES.get((intent or "default").lower(), PROFILES["default"])
    a, b = a * modifiers[0], b * modifiers[1]
    return (a / (a + b), b / (a + b)) if a + b > 0 else PROFILES["default"]


def hybrid(chunks: DataFrame, query: str, vector_hits: DataFrame, intent: str = "default", top_k: int = 10, fusion: str = "weighted", predicate: Column | None = None, rules: list[tuple[str, int]] = (), source: str = "source_file", lexical: DataFrame | None = None) -> DataFrame:
    """Keyword and vector hits (5 * top_k each), fused, boosted by authority of the source, cut to top_k.
    lexical: keyword hits from an index; without them the chunks are scanned."""
    lexical = bm25(chunks, query, 5 * top_k, predicate) if lexical is None else lexical
    fused = fuse_weighted(lexical, vector_hits, blended_weights(intent), 5 * top_k) if fusion == "weighted" else fuse_rrf({"lexical": lexical, "semantic": vector_hits}, top_k=5 * top_k)
    named = fused.join(chunks.select(F.col("doc_id").alias("id"), F.col(source).alias("__source")), "id", "left")
    boosted = named.select("id", F.round(F.col("score") * authority_boost(F.col("__source"), rules=rules), 6).alias("score"))
    return top(boosted, top_k)


def expand_parents(hits: DataFrame, mapping: DataFrame) -> DataFrame:
    """Hits (id, score) replaced by their parents, the first hit of each; hits without a parent stay."""
    joined = hits.join(mapping, hits["id"] == mapping["child_id"], "left").select(F.coalesce("parent_id", "id").alias("result_id"), "id", "score")
    w = Window.partitionBy("result_id").orderBy(F.desc("score"), "id")
    return joined.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def minimum_span(content: Column, terms: list[str]) -> Column:
    """Arrow UDF: characters of the shortest stretch that holds every term found, 0 if fewer than two are."""

    @F.pandas_udf("long")
    def span(texts):
        def one(value):
            if value is None:
                return 0
            low, events = value.lower(), []
            for n, term in enumerate(terms):
                at = low.find(term)
                while at >= 0:
                    events.append((at, n))
                    at = low.find(term, at + 1)
            events.sort()
            need = len({n for _, n in events})
            if need < 2:
                return 0
            seen, left, best = {}, 0, None
            for at, n in events:
                seen[n] = seen.get(n, 0) + 1
                while len(seen) == need:
                    width = at - events[left][0]
                    best = width if best is None or width < best else best
                    m = events[left][1]
                    seen[m] -= 1
                    if not seen[m]:
                        del seen[m]
                    left += 1
            return best

        return texts.map(one)

    return span(content)


def multi_vector(content_hits: DataFrame, question_hits: DataFrame, parents: DataFrame, top_k: int = 10, weights: tuple[float, float] = (1.0, 0.8), k: int = 60) -> DataFrame:
    """Fusion by ranks of hits (id, score) on contents and on the questions made for them: parents (question, id) names each
    question's chunk, every question of a chunk adds weight / (k + rank); questions without a chunk keep their rank and add nothing.
    """
    every = ranked({"content": content_hits, "question": question_hits})
    content = every.where("source = 'content'").select("id", (weights[0] / (k + F.col("rank"))).alias("part"))
    asked = every.where("source = 'question'").select(F.col("id").alias("question"), (weights[1] / (k + F.col("rank"))).alias("part")).join(parents, "question").where("id IS NOT NULL")
    return top(content.unionByName(asked.select("id", "part")).groupBy("id").agg(F.round(F.sum("part"), 6).alias("score")), top_k)


def expanded(find, queries: list[str], top_k: int = 10) -> DataFrame:
    """Hits of the query and its first two expansions (find: query and number -> id, score), twice top_k of each, every id once by its
    first list."""
    lists = {f"{i}": find(q, 2 * top_k) for i, q in enumerate(queries[:3])}
    return first_hits(lists).select("id", "score", F.col("source").cast("int").alias("list"))
