import re

import corpus_pipeline
from quillspark.llm import toxicity
from test_minhash_dedup import sets_of


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    left = [r for r in rows if model.score((r[1] or "").encode()) < 0.7]
    best = {}
    for i, t in left:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        if key not in best or (-len(t), i) < (-len(best[key][1]), best[key][0]):
            best[key] = (i, t)
    left = sorted(best.values())
    sets, low = sets_of(left, 5), {i: i for i, _ in left}
    links = [(left[i][0], left[j][0]) for i in range(len(left)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    want = {i for i, c in low.items() if i == c}
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in found} == want
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == want


def test_odd_tables(spark, tmp_path):
    """Nulls, repeated rows and ids, clashing columns, empty tables: no clean document is lost, no copy stays."""
    import random

    rng = random.Random(2)
    words = "the river runs past a quiet mill and you reading books is good way to rest at night markets open early".split()
    text = lambda: " ".join(rng.choices(words, k=60))
    base = [(i, text() + (" idiot idiot" if i % 6 == 0 else "")) for i in range(300)]
    first = base[1][1]
    odd = [(1000, None), (1001, ""), (None, text()), (1002, text()), (1002, text()), (1, first), (1003, first + "  "), (1004, first + " more"), (1005, "long " * 5_000)]
    rows = [(i, t, 9, 1, "x", 0) for i, t in base + odd]
    spark.createDataFrame(rows, "doc_id long, text string, toxic int, rep long, sha string, run int").write.parquet(f"{tmp_path}/a/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i, _ in base] + [(5, 1, None), (None, None, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/a/labels.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/a").select("doc_id").collect()}
    clean = {i for i, _ in base if i % 6}
    # 1003 is longer than row 1, so it stays of their exact copies; 1004 is its near copy, 1001 and 1000 are both empty
    assert got == clean - {1} | {1000, None, 1002, 1003, 1005} and not got & {i for i, _ in base if i % 6 == 0}
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
