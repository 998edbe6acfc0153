import numpy as np
import pytest

from quillspark.llm import components, embedding_dedup


def brute(rows, threshold=0.93):
    """Exact links by whole matrices, components by repeated minima."""
    rows = [(i, v, l) for i, v, l, *_ in rows]
    good = [k for k, (_, v, l) in enumerate(rows) if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    low, links = {k: rows[k][0] for k in range(len(rows))}, {k: set() for k in range(len(rows))}
    for label in {(rows[k][2], len(rows[k][1])) for k in good}:
        at = [k for k in good if (rows[k][2], len(rows[k][1])) == label]
        x = np.array([rows[k][1] for k in at], float)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= threshold)):
            if a != b:
                links[at[a]].add(at[b])
    changed = True
    while changed:
        changed = False
        for k, others in links.items():
            m = min([low[k], *(low[o] for o in others)])
            if m < low[k]:
                low[k], changed = m, True
    return sorted((rows[k][0], len(links[k]), low[k]) for k in range(len(rows)))


SCHEMA = "vec_id long, embedding array<float>, label int, rep long, kept boolean"


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(12):
        centre = rng.normal(size=32)
        for _ in range(20):
            v = centre + rng.normal(size=32) * rng.choice([0.05, 0.2, 0.3, 1.0])
            out.append([float(np.float32(x)) for x in v])
    rows = [(i * 3, v, int(rng.integers(0, 2)), 1, None) for i, v in enumerate(out)]
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, [1.0, 2.0], [1.0, 2.0], [1e-30, 2e-30], [3e38, 3e38]]
    rows += [(1000 + i, v, 1, 1, None) for i, v in enumerate(odd)]
    rows += [(2000, out[0], None, 1, None), (2001, out[0], 0, 1, None), (2002, out[0], 0, 1, None), (2003, [2 * x for x in out[0]], 0, 1, None)]
    return rows


@pytest.mark.parametrize("block", [2048, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors()
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)
    mine = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got)
    assert mine == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_table_and_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(table).collect())
    assert got == brute([tuple(r) for r in table.select("vec_id", "embedding", "label").collect()])


def test_repeats_and_empty(spark):
    one = [(5, [1.0, 2.0, 3.0], 1, 0, None)] * 3
    got = [tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(one, SCHEMA)).collect()]
    assert got == [(5, 2, 5, True)] * 3
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(500, 500), (1, 2), (2, 1)]
    low = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    got = {r["u"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {u: c for u, c in low.items() if u != c}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_recall_at_the_threshold():
    """Pairs at a cosine of exactly 0.93, where misses are likeliest."""
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(2, 20_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    hashes = embedding_dedup.CrossPolytope(64, 8, 4)
    left, right = hashes.codes(a.astype(np.float32)), hashes.codes(b.astype(np.float32))
    met = (left[:, :, :, None] == right[:, :, None, :]).any(axis=(2, 3))
    assert met.mean(axis=0).min() > 0.8 and met.any(axis=1).mean() > 0.9999


def test_an_id_with_several_vectors(spark):
    """Each vector of a repeated id has its own links."""
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(2, 16)).astype(np.float32)
    near = lambda v: [float(x) for x in v + np.float32(0.02)]
    rows = [(1, a.tolist(), 1), (1, b.tolist(), 1), (2, near(a), 1), (3, near(b), 1), (3, a.tolist(), 1), (1, a.tolist(), 1), (4, near(b), 2)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(*r, 0, None) for r in rows], SCHEMA)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows)
