import math
import random

import pytest

from quillspark.operators import coherence


def cosine(a, b):
    if not a or not b or len(a) != len(b) or None in a + b:
        return 0.0
    p, q = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / (p * q) if p and q else 0.0


def mean_of_pairs(vectors):
    pairs = [cosine(a, b) for i, a in enumerate(vectors) for b in vectors[i + 1 :]]
    return sum(pairs) / len(pairs) if pairs else 1.0


def all_pairs(vectors, threshold):
    """Runs by comparing all pairs anew at each step."""
    groups = []
    for i, v in enumerate(vectors):
        mine = [vectors[k] for k in groups[-1]] if groups else []
        if groups and mean_of_pairs(mine) - mean_of_pairs([*mine, v]) <= 1 - threshold:
            groups[-1].append(i)
        else:
            groups.append([i])
    return groups


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.95])
def test_equals_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 100))
    rows = []
    for key in ["a", "b", None, "one"]:
        base = [rng.gauss(0, 1) for _ in range(4)]
        for i in range(1 if key == "one" else 60):
            if rng.random() < 0.15:
                base = [rng.gauss(0, 1) for _ in range(4)]
            v = [x + rng.gauss(0, 0.2) for x in base]
            rows.append((key, i * 3, rng.choice([v] * 12 + [None, [0.0] * 4, v[:3], []]), "x"))
    df = spark.createDataFrame(rows, "label string, place int, v array<double>, n string").repartition(5)
    got = {}
    for r in coherence.semantic_runs(df, "label", "place", "v", threshold).orderBy("label", "run").collect():
        got.setdefault(r.label, []).append(r)
    for key in {r[0] for r in rows}:
        mine = [r[2] for r in rows if r[0] == key]
        want = all_pairs(mine, threshold)
        found = got.pop(key)
        assert [(r.run, r["first"], r["last"], r.n) for r in found] == [(g, w[0] * 3, w[-1] * 3, len(w)) for g, w in enumerate(want)]
        for r, w in zip(found, want, strict=True):
            assert r.coherence == pytest.approx(mean_of_pairs([mine[i] for i in w]), abs=1e-9)
            whole = [mine[i] for i in w if mine[i] is not None]
            whole = [v for v in whole if len(v) == len(whole[0])]
            assert r.centroid == (pytest.approx([sum(c) / len(whole) for c in zip(*whole, strict=True)], abs=1e-9) if whole else None)
    assert not got


def test_odd_vectors(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [float("nan"), 1.0]), ("a", 3, [None, 1.0]), ("a", 4, [1.0, 0.0])]
    got = coherence.semantic_runs(spark.createDataFrame(rows, "k string, place long, v array<double>"), "k", "place", "v", 0.5).orderBy("run").collect()
    assert [(r["first"], r.n) for r in got] == [(1, 1), (2, 1), (3, 1), (4, 1)] and got[1].centroid is None and got[3].centroid == [1.0, 0.0]
    assert coherence.semantic_runs(spark.createDataFrame([], "k string, place long, v array<double>"), "k", "place", "v").count() == 0
