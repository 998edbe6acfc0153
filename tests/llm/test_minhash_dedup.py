import re

import numpy as np
import pytest

from quillspark.llm import minhash_dedup


def sets_of(rows, size):
    out = []
    for _, text, *_ in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        n = min(size, len(words))
        out.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set())
    return out


def brute(rows, size, percent):
    sets = sets_of(rows, size)
    low = [r[0] for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            m = min(low[i], low[j])
            if low[i] != m or low[j] != m:
                low[i] = low[j] = m
                changed = True
    return sorted(((r[0], len(s), c) for r, s, c in zip(rows, sets, low)), key=str)


def corpus(n=160, seed=1):
    """Groups of copies with growing numbers of changed words, a shared passage, chains, and odd rows."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(words, 40))
    rows = []
    for g in range(8):
        base = list(rng.choice(words, 120))
        for k in range(n // 8):
            text = list(base)
            for at in rng.integers(0, 120, k % 9):
                text[at] = str(rng.choice(words))
            rows.append((len(rows) * 2, " ".join(text) + (" " + passage if g % 2 else ""), "clash", 1))
    chain = list(rng.choice(words, 200))
    for k in range(12):
        rows.append((900 - k, " ".join(chain), None, None))
        chain[5 * k] = f"changed{k}"
    odd = [None, "", " \t\n", "one", "ONE", "one two", "One  two", "é É", "a b c", "a b c d", "x " * 20_000]
    return rows + [(1000 + i, t, None, None) for i, t in enumerate(odd)] + [(None, "one two", None, None), (1003, "one", None, None)]


SCHEMA = "doc_id long, text string, digest string, rep long"


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, 1024), (5, 80, 5)])
def test_against_brute_force(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = minhash_dedup.near_groups(docs, size, percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, size, percent)
    kept = minhash_dedup.drop_near_copies(docs, size, percent)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r["doc_id"] for r in got if r["kept"]), key=str)


def test_empty(spark):
    assert minhash_dedup.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert minhash_dedup.drop_near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_an_id_with_several_texts(spark):
    """Each text of a repeated id has its own links; equal sets under many ids are one class."""
    rng = np.random.default_rng(5)
    text = lambda k: " ".join(f"{k}{x}" for x in rng.integers(0, 9999, 60))
    w, v, z = text("w"), text("v"), text("z")
    rows = [(1, w), (1, v), (2, w + " more"), (3, v + " more"), (3, z), (4, z.upper()), (4, "  " + z), (1, w), (5, text("q")), (5, None), (None, w)]
    rows = [(*r, "clash", 9) for r in rows]
    got = minhash_dedup.near_groups(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 3, 85)
    left = minhash_dedup.drop_near_copies(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=str) == sorted([(1, w), (1, w), (1, v), (3, z), rows[8][:2], (5, None), (None, w)], key=str)


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_groups(docs, 3, 85).collect()), key=str)
    assert got == brute([tuple(r) for r in docs.collect()], 3, 85)


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    left = rng.integers(0, 256, (4000, minhash_dedup.HASHES), dtype=np.uint8)
    for similarity, low, high in ((0.85, 0.999, 1.0), (0.6, 0.0, 0.01)):
        right = np.where(rng.random(left.shape) < similarity, left, rng.integers(0, 256, left.shape, dtype=np.uint8))
        at = np.arange(len(left))
        assert low <= len(minhash_dedup.bayes_survivors(left, right, at, at, 85)) / len(left) <= high
    assert minhash_dedup.bands_for(85) == (8, 40) and minhash_dedup.bands_for(80) == (6, 53)
