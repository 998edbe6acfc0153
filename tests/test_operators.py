"""Hand-made cases for operators whose results have no plain SQL form."""

import math
import random

import pytest

from pyspark.sql import functions as F

from quillspark.functions import refiners, text, vectors
from quillspark.operators import analytics, chunking, dedup, graph, search, tables, timeline
from quillspark.sources import pages
from quillspark.streaming import ingest


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, content string")


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


def test_packing_keeps_all_text_and_the_limit(spark):
    body = "\n\n".join(f"paragraph {i} " + "word " * (i % 7) for i in range(40))
    rows = chunking.by_paragraph(docs(spark, body, "", "x" * 500), 120).orderBy("document_id", "chunk_index").collect()
    mine = [r for r in rows if r["document_id"] == 0]
    assert "\n\n".join(r["content"] for r in mine).split() == body.split()
    assert all(r["char_count"] <= 120 for r in mine) and [r["chunk_index"] for r in mine] == list(range(len(mine)))
    assert [r["content"] for r in rows if r["document_id"] == 2] == ["x" * 500]


def test_sections(spark):
    rows = chunking.sections(docs(spark, "head\n# One\na\n## Two\nb\n### Three\nc")).orderBy("section_no").collect()
    assert [(r["title"], r["content"]) for r in rows] == [("", "head"), ("One", "a"), ("Two", "b\n### Three\nc")]
    assert chunking.sections(docs(spark, "head\n# One\na"), keep_head=False).count() == 1


def test_merge_small(spark):
    parts = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a b c", "d", "e f", "g h i j", "k"])], "document_id long, chunk_index int, content string")
    rows = chunking.merge_small(parts, 3).orderBy("chunk_index").collect()
    assert [r["content"] for r in rows] == ["a b c", "d\n\ne f", "g h i j\n\nk"]


def test_similarity_chunks_respect_bounds(spark):
    body = " ".join(f"Sentence {i} talks about topic{i // 5} and more." for i in range(60))
    rows = chunking.by_similarity(docs(spark, body), 0.3, 80, 300).collect()
    assert len(rows) > 3 and all(r["char_count"] <= 300 for r in rows)
    assert " ".join(r["content"] for r in sorted(rows, key=lambda r: r["chunk_index"])) == body


def test_quality_and_sentiment(spark):
    row = docs(spark, "However, this is a good test. It is short! Yes.", "").select("doc_id", analytics.quality(F.col("content")).alias("q"), analytics.sentiment(F.col("content")).alias("s")).select("doc_id", "q.*", "s.*").orderBy("doc_id").collect()
    assert row[0]["coherence"] == 1.0 and math.isclose(row[0]["completeness"], 2.5 / 3, abs_tol=1e-6) and row[0]["sentiment"] == "positive"
    assert row[1]["quality"] == 0.0 and row[1]["sentiment"] == "neutral"


def test_similar_pairs_are_exact(spark):
    import random

    rng = random.Random(1)
    sets = {i: sorted({rng.randrange(40) for _ in range(rng.randrange(1, 15))}) for i in range(120)}
    sets |= {200 + i: sets[i] + [99 + i] for i in range(20)}
    rows = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "id long, items array<string>")
    for threshold in (0.5, 0.8, 1.0):
        want = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= threshold * len(set(sets[a]) | set(sets[b]))}
        assert {(r["a"], r["b"]) for r in dedup.similar_pairs(rows, threshold).collect()} == want


def test_greedy_groups_are_seed_anchored(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a long, b long")
    ids = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    got = {r["id"]: r["kept_id"] for r in dedup.greedy_groups(pairs, ids).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}


@pytest.mark.parametrize("few", [0, 1000])
def test_greedy_classes_equal_the_quadratic_pass(spark, few):
    import random

    rng = random.Random(2)
    sets = {i: {str(rng.randrange(12)) for _ in range(rng.randrange(0, 9))} for i in range(80)}
    sets |= {100 + i: {"a", "b", "c"} for i in range(400)} | {3: {"a", "b", "c", "d"}, 90: set(), 91: set()}
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, items array<string>").union(spark.sql("SELECT 600L, CAST(null AS array<string>)"))
    want, kept = {600: 600}, []
    for i in sorted(sets):
        seed = next((k for k in kept if sets[i] and len(sets[i] & sets[k]) >= 0.6 * len(sets[i] | sets[k])), i)
        want[i] = seed
        if seed == i:
            kept.append(i)
    assert {r["id"]: r["kept_id"] for r in dedup.greedy_classes(rows, 0.6, few=few).collect()} == want and want[499] == 3
    pairs, members = dedup.similar_classes(rows, 0.6)
    assert pairs.where("b >= 100").count() < 80 and members.where("class_id = 100").count() == 400 and members.count() == len(want)


def test_pagerank_and_hits(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1), (4, 3)], "src long, dst long")
    ranks = {1: 0.25, 2: 0.25, 3: 0.25, 4: 0.25}
    for _ in range(30):
        ranks = {1: 0.0375 + 0.85 * ranks[3], 2: 0.0375 + 0.85 * ranks[1] / 2, 3: 0.0375 + 0.85 * (ranks[1] / 2 + ranks[2] + ranks[4]), 4: 0.0375}
    got = {r["node"]: r["rank"] for r in graph.pagerank(edges, rounds=30).collect()}
    assert all(math.isclose(got[n], ranks[n], abs_tol=1e-4) for n in ranks)
    rows = graph.hits(edges, 5).collect()
    assert math.isclose(sum(r["hub"] for r in rows), 1) and max(rows, key=lambda r: r["authority"])["node"] == 3


def test_anchored_groups_count_from_the_first(spark):
    e = spark.createDataFrame([(i, 1, t) for i, t in enumerate([0, 200, 290, 310, 600, 611])], "event_id long, user long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event_id"]: r["group_no"] for r in timeline.anchored_groups(e, "user", 300).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2}


def test_budget_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 7, 3, 2, 9])], "q long, id long, cost long")
    assert sorted(r["id"] for r in timeline.budget(rows, "q", [F.col("id")], "cost", 10, "id").collect()) == [0, 2, 3]


def test_proximity_span(spark):
    got = docs(spark, "alpha x beta", "beta", "alpha alpha beta", None).select(search.minimum_span(F.col("content"), ["alpha", "beta"]).alias("s")).collect()
    assert [r["s"] for r in got] == [8, 0, 6, 0]


def test_html(spark):
    html = "<html><head><title>A  T</title><style>x{}</style></head><body><p>One &amp; two</p><script>no</script><a href='/x'>link</a><ul><li>i</li></ul></body></html>"
    assert pages.parse_html(html) == ("A T", "One & two\nlink\ni", ["/x"])
    assert pages.parse_html(None) == ("", "", [])


def test_text_functions(spark):
    assert one(spark, text.redact(F.col("x")), x="a@b.co 123-45-6789 10.0.0.1 4111 1111 1111 1111") == "[EMAIL] [SSN] [IP_ADDRESS] [CREDIT_CARD]"
    assert one(spark, text.ocr_cleanup(F.col("x")), x="ﬁrst broken-\nword.....end") == "first brokenword...end"
    assert one(spark, text.normalize_address(F.col("x")), x="12 North Main Street, Apartment 4.") == "12 N MAIN ST APT 4"
    assert one(spark, text.drop_page_numbers(F.col("x")), x="a\n- 12 -\nPage 3 of 9\nb").split() == ["a", "b"]
    assert one(spark, text.fuzzy_ratio(F.lit("Smith John"), F.lit("john smith")), x=1) == 1.0


def test_refiners(spark):
    row = docs(spark, "CVE-2020-1111 and cve-2019-22222").select(*refiners.domain(F.col("content"), "cyber")).first()
    assert row["cyber_all_cves"] == ["CVE-2019-22222", "CVE-2020-1111"] and row["cyber_cvss_score"] is None
    macros = lambda t: docs(spark, t).select(refiners.macros(F.col("content"))).first()[0]
    assert macros("5 g fat, 6g Fat") == {"Fat": 6.0}
    assert macros("Protein: 12g, Fat: 5.5g, Carbs: 45g") == {"Protein": 12.0, "Fat": 5.5, "Carbs": 45.0}
    assert macros("Protein: 12 g and Fat 3g; 4 g protein; carbohydrates:\t7g") == {"Protein": 4.0, "Fat": 3.0, "Carbs": 7.0}
    assert macros("fat 1234 g, 5.25 g fat, ٣ g Fat, 7 grams fat") == {"Fat": 3.0} and macros("") == {}
    allergens = lambda t: docs(spark, t).select(refiners.allergens(F.col("content"))).first()[0]
    assert allergens("Contains NUTS, soy-milk and eggs; peanutsé") == ["Nuts", "Soy", "Eggs"] and allergens("coconuts") == []


def test_validation_and_upsert(spark):
    rows = spark.createDataFrame([(1, 5.0), (None, 99.0)], "id long, v double")
    errors = tables.validation_errors({"id": {"required": True}, "v": {"high": 50}})
    assert [r[0] for r in rows.select(errors).collect()] == [[], ["id: required", "v: above 50"]]
    new = spark.createDataFrame([(1, 7.0), (2, 8.0)], "id long, v double")
    assert sorted(tuple(r) for r in tables.upsert(rows.where("id = 1"), new, "id").collect()) == [(1, 7.0), (2, 8.0)]


def test_stream_takes_up_new_files(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    first = docs(spark, "a", "b", "a")
    first.write.parquet(folder)
    run = lambda: ingest.run_once(ingest.stream_table(spark, folder, first.schema), ingest.new_contents, out, checkpoint)
    run()
    assert spark.read.parquet(out).count() == 2
    docs(spark, "b", "c").write.mode("append").parquet(folder)
    run()
    assert sorted(r["content"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_pipeline_takes_up_where_it_stopped(spark, tmp_path):
    from quillspark.operators import pipeline

    calls = []

    def stage(name, fail=False):
        def apply(df):
            calls.append(name)
            if fail:
                raise RuntimeError(name)
            return df.withColumn(name, F.lit(1))

        return apply

    df = spark.range(3)
    try:
        pipeline.run_saved(df, [pipeline.Stage("a", stage("a")), pipeline.Stage("b", stage("b", True))], str(tmp_path / "p"))
    except RuntimeError:
        pass
    out = pipeline.run_saved(df, [pipeline.Stage("a", stage("a")), pipeline.Stage("b", stage("b"))], str(tmp_path / "p"))
    assert calls == ["a", "b", "b"] and set(out.columns) == {"id", "a", "b"} and out.count() == 3


def test_pipeline_is_checked_before_it_runs(spark):
    from quillspark.operators import pipeline

    pipeline.register("t_len", needs=("content",), gives=("n",))(lambda df: df.withColumn("n", F.length("content")))
    pipeline.register("t_big", needs=("n",), gives=())(lambda df: df.where("n > 1"))
    assert pipeline.problems(pipeline.from_blueprint({"stages": ["t_big", "t_len"]}), ["content"]) == ["t_big: needs n"]
    assert pipeline.run(docs(spark, "a", "bb"), pipeline.from_blueprint({"stages": ["t_len", "t_big"]})).count() == 1


def test_connector_as_data_source(spark):
    from quillspark.sources import adapters

    spark.dataSource.register(adapters.data_source("memory_docs", adapters.Memory({"a": ("A", "one"), "b": ("B", "two")})))
    assert sorted(tuple(r) for r in spark.read.format("memory_docs").load().collect()) == [("a", "A", "one"), ("b", "B", "two")]


def test_query_language(spark):
    from quillspark.operators import query_lang

    p = query_lang.parse('big "red fox" lang:en NOT dog -cat source:"a b"')
    assert (p.words, p.phrases, p.excluded, p.filters) == (["big"], ["red fox"], ["dog", "cat"], [("lang", "en"), ("source", "a b")])
    rows = docs(spark, "A big red fox", "big red fox and dog", "big fox", None)
    q = query_lang.parse('big "red fox" NOT dog')
    assert [r["doc_id"] for r in rows.where(query_lang.predicate(q, F.col("content"), {})).collect()] == [0]


def test_summary(spark):
    from quillspark.operators import enrich

    got = enrich.extract(docs(spark, "Cats eat fish. Birds sing. Cats like fish and cats sleep."), 1).first()
    assert got["summary"] == "Cats eat fish."


def test_vector_pairs_by_blocks(spark):
    rng = random.Random(9)
    unit = lambda: [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i, rng.choice([1, 1, 1, 2, None]), unit()) for i in range(130)]
    rows += [(200, 1, [0.0] * 6), (201, 1, [None, *unit()[:5]]), (202, 1, None), (203, 1, []), (204, 1, unit()[:5]), (205, 1, [float("nan")] * 6), (206, 1, rows[0][2]), (None, 1, unit())]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    a, b = df.alias("a"), df.alias("b")
    joined = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.vec_id") < F.col("b.vec_id")))
    every = joined.select("a.vec_id", F.col("b.vec_id").alias("b"), F.round(vectors.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("s")).collect()
    assert any(r.s != r.s for r in every)
    for threshold in (0.6, -0.5):
        want = sorted((*r[:2], str(r.s)) for r in every if not r.s < threshold)
        for size in (7, 2000):
            found = dedup.vector_pairs(df, threshold, per_block=size)
            assert sorted((r.a, r.b, str(r.similarity)) for r in found.collect()) == want
            # two rows of a label do not meet in a join of the label with itself
            assert threshold < 0 or "id#" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)


def test_sets_move_only_where_they_are_near(spark):
    """Sets that share their rarest items but are far apart are told apart before a set is moved, whatever order items have."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(90)]
    rows = [(i, rng.sample(base, 60) + [f"own{i}_{k}" for k in range(rng.choice([0, 5, 60]))]) for i in range(60)]
    rows += [(100 + i, rows[i][1][::-1]) for i in range(5)] + [(200 + i, rows[i][1][:-3] + ["x", "y"]) for i in range(5)] + [(300, []), (301, None)]
    df = spark.createDataFrame(rows, "id long, items array<string>").repartition(4)
    for threshold in (0.8, 0.55):
        sets = {i: set(x) for i, x in rows if x}
        want = {(i, j): round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 9) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12}
        found = dedup.similar_pairs(df, threshold)
        assert {(r.a, r.b): round(r.similarity, 9) for r in found.collect()} == want and len(want) >= 10 and found.count() == len(want)
    pairs, _ = dedup.similar_classes(df, 0.8)
    moved = [f for f in pairs.inputFiles() if "/near-" in f]
    near = spark.read.parquet(*moved).count()
    assert len([1 for p in want if p[0] < p[1]]) > near >= 1


def test_windows_meet_on_rare_words(spark):
    """All matches by brute force, texts of frequent words too; what is shuffled are matches, not shared words."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60) for _ in range(1 + 60 // (i + 1))]
    texts = {i: rng.choices(words, k=rng.choice([0, 3, 12, 40, 90])) for i in range(80)}
    items = {i: rng.choices(words, k=rng.choice([0, 4, 8, 25])) for i in range(25)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()] + [(99, None)], "doc_id long, content string").repartition(3)
    corpus = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(99, None)], "item_id long, text string")
    for threshold, least in ((0.3, 5), (0.5, 2)):
        want = set()
        for i, w in texts.items():
            for s in range(0, max(len(w) - 1, 0) + 1, 10):
                win = set(w[s : s + 20])
                hits = [(j, len(win & set(x)), round(len(win & set(x)) / len(win | set(x)), 6)) for j, x in items.items() if len(w[s : s + 20]) >= 5 and len(win & set(x)) >= least]
                want |= {(i, s // 10, *h) for h in sorted((h for h in hits if h[2] >= threshold), key=lambda h: (-h[2], h[0]))[:3]}
        found = dedup.window_matches(docs, corpus, 20, 10, threshold, least)
        assert {tuple(r) for r in found.collect()} == want and len(want) > 5
        assert "count(1)" not in found._jdf.queryExecution().optimizedPlan().toString()
