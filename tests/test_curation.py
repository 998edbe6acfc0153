"""Tags, filters, merges, entity names, links, wordings and number formats, with values worked out by hand or by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import entities, refiners
from quillspark.operators import curation, query_lang, search
from quillspark.plans import registry


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_tags(spark):
    rows = [(1, ["a", "b", "a"]), (2, None), (3, [])]
    tags, odd = F.col("tags"), F.col("id") % 2 == 1
    assert values(spark, rows, "id int, tags array<string>", curation.add_tag(tags, " B! ")) == [(["a", "b", "a"],), (["b"],), (["b"],)]
    assert values(spark, rows, "id int, tags array<string>", curation.add_tag(tags, "c", odd)) == [(["a", "b", "a", "c"],), (None,), (["c"],)]
    assert values(spark, rows, "id int, tags array<string>", curation.remove_tag(tags, "A")) == [(["b", "a"],), (None,), ([],)]
    assert [r.tag for r in curation.all_tags(spark.createDataFrame(rows, "id int, tags array<string>")).collect()] == ["a", "b"]
    full = [(1, [f"t{i}" for i in range(50)])]
    assert values(spark, full, "id int, tags array<string>", F.size(curation.add_tag(tags, "t7"))) == [(50,)]
    with pytest.raises(Exception, match="50 tags"):
        values(spark, full, "id int, tags array<string>", curation.add_tag(tags, "new"))
    with pytest.raises(ValueError, match="no letters"):
        curation.clean_tag("!?")
    assert len(curation.clean_tag("x" * 40)) == 32


def test_filters(spark):
    rows = [(1, "x" * 50, ["PERSON: Ann"], "en"), (2, " " * 60, [], "en"), (3, None, None, None), (4, "x" * 49, ["org"], "de")]
    df = spark.createDataFrame(rows, "id int, content string, entities array<string>, library string")
    ids = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert ids(curation.valid_chunk(F.col("content"))) == [1]
    assert ids(curation.has_entity(F.col("entities"))) == [1, 4] and ids(curation.has_entity(F.col("entities"), "person")) == [1]
    assert [r.id for r in curation.delete_library(df, "en").orderBy("id").collect()] == [3, 4]
    chain = {"long": F.length("content") >= 50, "english": F.col("library") == "en", "valid": curation.valid_chunk(F.col("content"))}
    assert [tuple(r) for r in curation.retention(df, chain).collect()] == [(1, "long", 2, 2), (2, "english", 2, 0), (3, "valid", 1, 1)]
    assert [tuple(r) for r in curation.retention(df.limit(0), chain).collect()] == [(1, "long", 0, 0), (2, "english", 0, 0), (3, "valid", 0, 0)]
    assert tuple(curation.validation_counts(df.limit(0), curation.valid_chunk(F.col("content"))).first()) == (0, 0, 0, 0.0)


def test_fuzzy_merge(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[a : a + 20]) for a in range(0, 12)] + ["", None, "A b c", "a B  c\n", " ".join(words[3:23]).upper()]
    sets = [set((t or "").lower().split()) for t in texts]
    kept: list[int] = []
    want = {}
    for i, s in enumerate(sets):
        seeds = [j for j in kept if s and sets[j] and len(s & sets[j]) / len(s | sets[j]) >= 0.8]
        want[i] = min(seeds) if seeds else i
        kept += [] if seeds else [i]
    got = curation.fuzzy_merge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string"), 0.8)
    assert {r.id: r.kept_id for r in got.collect()} == want and len(kept) < len(texts)
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    assert {r.id: r.kept_id for r in registry.queries()["fuzzy_merge"](spark, folder).collect()} == want


NAMES = [
    ("Microsoft Corp.", "ORG", "microsoft", "Microsoft Corporation"),
    ("microsoft corporation", "organization", "microsoft", "microsoft corporation"),
    ("Acme Co Ltd", "org", "acme company", "Acme Company Limited"),
    ("Coca Cola Co.;", "org", "coca cola", "Coca Cola Company"),
    ("Corp", "org", "", "Corporation"),
    ("Prof. Dr. José Núñez", "Person", "josé núñez", "José Núñez"),
    ("nasa", "person", "nasa", "National Aeronautics and Space Administration"),
    ("  Some Place ", "LOC", "some place", "Some Place"),
    ("", "org", "", ""),
]


def test_names(spark):
    rows = [(n, k) for n, k, *_ in NAMES] + [(None, "org"), ("x", None)]
    got = values(spark, rows, "name string, kind string", entities.normalized(F.col("name"), F.col("kind")).alias("n"))
    assert [g[0] and tuple(g[0]) for g in got] == [(k, c) for _, _, k, c in NAMES] + [None, ("x", "x")]
    keys = {"Acme Inc": "acme", "Acme Co. LLC": "acme", "Acme LLC Co.": "acme llc", "Acme Corp Ltd": "acme corp", " Acme Ltd Co ": "acme ltd", "Acme, Inc.": "acme,", None: ""}
    assert dict(values(spark, [(k,) for k in keys], "name string", "name", entities.link_key(F.col("name")))) == keys


def test_entity_index(spark):
    rows = [(1, 1, 0, "Acme Corp", "ORG"), (1, 2, 0, "Acme Corporation", "ORG"), (2, 2, 0, "Acme Corp", "ORG"), (2, 3, 0, "Dr. Roe", "PERSON"), (2, 3, 1, None, "ORG")]
    index = curation.entity_index(spark.createDataFrame(rows, "document int, chunk int, place int, name string, kind string"))
    assert sorted(tuple(r) for r in index.collect()) == [("acme", "Acme Corporation", "ORG", ["Acme Corp", "Acme Corporation"], 2, 3, 3), ("roe", "Roe", "PERSON", ["Dr. Roe"], 1, 1, 1)]
    assert sorted(tuple(r) for r in curation.entity_statistics(index).collect()) == [("ORG", 1, 3, 3.0), ("PERSON", 1, 1, 1.0)]


def test_citations(spark):
    rows = [("a", 1, "k1", None, 0.4), ("a", 2, "", "t2", None), ("a", 3, None, "t1", None), ("a", 4, "ka", None, None), ("b", 1, None, None, None), ("b", 2, "none", None, None), *[("c", i, "k1" if i == 101 else "x", None, None) for i in range(1, 102)]]
    known = spark.createDataFrame([("k1", "p"), ("t1", "p"), ("t2", "q"), ("ka", "a"), ("t2", "q")], "citation_key string, target string")
    links = curation.by_citation(spark.createDataFrame(rows, "artifact string, place int, key string, title string, confidence double"), known)
    assert sorted(tuple(r) for r in links.collect()) == [("a", "p", "k1", 0.4), ("a", "q", "t2", 0.9)]
    assert sorted(tuple(r) for r in curation.all_links(links).collect()) == [("a", "out", "p"), ("a", "out", "q"), ("p", "in", "a"), ("q", "in", "a")]


def test_identifiers(spark):
    assert values(spark, [("CVE-2021-1234",), ("cve-2021-1234",), ("CVE-2021-12345678",), (None,)], "c string", entities.cve_valid(F.col("c"))) == [(True,), (False,), (False,), (False,)]
    assert values(spark, [(0.0,), (10.5,), (None,)], "s double", entities.cvss_error(F.col("s"))) == [(None,), ("CVSS score 10.5 out of bounds (0.0-10.0)",), ("CVSS score none out of bounds (0.0-10.0)",)]
    assert values(spark, [("See 410 U.S. 113 and 5 F. 2",), ("none",)], "c string", entities.legal_citations(F.col("c"))) == [(["410 U.S. 113"],), ([],)]


def test_expand():
    assert query_lang.expand("How to submit the document?", "procedural") == ["how do I submit the document?", "steps to submit the document?", "process for submit the document?"]
    assert query_lang.expand("what is an FAQ") == ["what is an frequently asked questions"]
    assert query_lang.expand("explain trees", "conceptual") == ["what is trees", "trees overview"] and query_lang.expand("Trees") == []


def test_searches(spark):
    hits = lambda ids: spark.createDataFrame([(i, 1.0 - n / 10) for n, i in enumerate(ids)], "id long, score double")
    parents = spark.createDataFrame([(11, 1), (12, 3), (13, None), (14, 3)], "question long, id long")
    got = {r.id: r.score for r in search.multi_vector(hits([1, 2]), hits([13, 12, 14, 11]), parents).collect()}
    assert got == {1: round(1 / 61 + 0.8 / 64, 6), 2: round(1 / 62, 6), 3: round(0.8 / 62 + 0.8 / 63, 6)}
    found = {"q": [1, 2], "r": [2, 3], "s": [4, 1], "t": [9]}
    rows = search.expanded(lambda q, k: hits(found[q][:k]), list("qrst"), 10).collect()
    assert {(r.id, r.list) for r in rows} == {(1, 0), (2, 0), (3, 1), (4, 2)}


def test_half_precision(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=500), rng.normal(size=200) * 1e-5, rng.normal(size=100) * 1e-8, 2.0 ** np.arange(-26, 17), [0.0, 65504, 65519, 65520, -7e4, 1 - 2**-24, 2049, 2051, np.inf, np.nan]]).astype(np.float32)
    got = spark.createDataFrame([([float(v) for v in x],), (None,)], "v array<float>").select(curation.half_precision(F.col("v"))).collect()
    with np.errstate(over="ignore"):
        np.testing.assert_array_equal(np.array(got[0][0], dtype=np.float32), x.astype(np.float16).astype(np.float32))
    assert got[1][0] is None


def test_refiners(spark):
    assert values(spark, [(["K8s", "Go", "ML", "Machine Learning"],), (None,)], "s array<string>", refiners.skills(F.col("s"))) == [(["Go", "Kubernetes", "Machine Learning"],), (None,)]
    assert values(spark, [(None, "#a, b  ##c"), (["#x"], "y"), (None, None)], "l array<string>, s string", refiners.note_tags(F.col("l"), F.col("s"))) == [(["a", "b", "c"],), (["x"],), ([],)]
    got = values(spark, [("The dungeon boss. HP: 45, AC 13, CR 1/2",), ("He was a level 9 mage in a town",), ("nothing",), (None,)], "c string", refiners.game_type(F.col("c")), *refiners.game_stats(F.col("c")))
    assert got == [("Location", 45, 13, "1/2"), ("NPC", None, None, None), (None, None, None, None), (None, None, None, None)]
    assert values(spark, [("Deep Learning and trees",), (None,)], "c string", curation.chunk_topics(F.col("c"), ["tree", "deep", "x"])) == [(["tree", "deep"],), ([],)]
