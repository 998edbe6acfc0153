"""Routing, nearness and context windows against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import context


def test_strategy():
    assert context.strategy([]) == context.Strategy() == context.strategy(["nothing"])
    one = context.strategy(["Legal"])
    assert (one.name, one.modifiers, one.boosts) == ("legal", (1.2, 1.0), {"citation": 2.0, "court": 1.5})
    both = context.strategy(["legal", "cyber", "unknown"])
    assert both.name == "merged" and both.modifiers == pytest.approx((1.25, 1.0))
    assert both.required == sorted({"docket_number", "jurisdiction", "citation", "src_ip", "event_id", "cve_id"})
    assert both.tools == ["attack_mapper", "legal_citation_resolver", "timeline_builder"]


def test_factors(spark):
    sets = [[], ["legal"], ["legal", "cyber"], ["tech", "pkm", "none"], None, [None, "rpg"]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, d array<string>")
    for r in df.select("i", context.factors(F.col("d")).alias("f")).collect():
        assert tuple(r["f"]) == pytest.approx(context.strategy([d for d in sets[r["i"]] or [] if d]).modifiers)


def near(text, terms, window=50):
    """Every start against every end."""
    low = (text or "").lower()
    places = {t: [i for i in range(len(low)) if low.startswith(t, i)] for t in terms}
    places = {t: p for t, p in places.items() if p}
    if not places:
        return (0.0, 0, 0.0, 0, 0.0)
    at = sorted((i, terms.index(t), t) for t, p in places.items() for i in p)
    clusters, first = 0, -(10**9)
    for i, _, _ in at:
        if i - first > window:
            clusters, first = clusters + 1, i
    span = apart = 0
    if len(places) > 1:
        spans = []
        for a in range(len(at)):
            for b in range(a, len(at)):
                if {t for _, _, t in at[a : b + 1]} == set(places):
                    spans.append(at[b][0] - at[a][0] + len(at[b][2]))
                    break
        span = min(spans)
        gaps = [y[0] - x[0] for x, y in zip(at, at[1:], strict=False)]
        apart = sum(gaps) / len(gaps)
    coverage = len(places) / len(terms)
    spread = max(0.0, 1 - span / len(text)) if span else 0.0
    total = coverage * 0.4 + spread * 0.3 + (1 - min(apart / window, 1.0)) * 0.2 + min(clusters / 5, 1.0) * 0.2
    return (coverage, span, apart, clusters, min(max(total, 0.0), 1.0))


def test_nearness(spark):
    rng = random.Random(2)
    words = ["river", "mill", "milling", "stone", "a", "Mill", "RIVER", "and", "long", "é"]
    texts = [None, "", "river", "mill river", "millmill", "x" * 300, *(" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)), "river " + "y " * 50_000 + "mill"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for terms in (["river", "mill"], ["river", "mill", "stone"], ["mill", "milling"], ["mill"], ["mill", "mill", "river"]):
        got = {r["i"]: tuple(r["n"]) for r in df.select("i", context.nearness(F.col("t"), terms).alias("n")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == pytest.approx(near(t, terms)), (terms, t)


def test_rank_by_nearness(spark):
    assert context.nearness_terms("How would the River-mill run? I x2 mill") == ["how", "river", "mill", "run", "mill"]
    hits = spark.createDataFrame([(1, 0.5, "river far " + "z " * 90 + "mill"), (2, 0.5, "the river mill"), (3, 0.6, None)], "id long, score double, content string")
    got = {r["id"]: r["score"] for r in context.rank_by_nearness(hits, "river mill", 0.5).collect()}
    assert got[2] > got[1] > got[3] == pytest.approx(0.3)
    assert [r["score"] for r in context.rank_by_nearness(hits, "the of").orderBy("id").collect()] == [0.5, 0.5, 0.6]
    assert context.rank_by_nearness(hits.limit(0), "river").count() == 0
    with pytest.raises(ValueError):
        context.rank_by_nearness(hits, "river", 1.5)


def choose(rows, budget, each, most):
    """One query's rows (id, doc, score, text): two passes over the best first."""
    worst = float("inf")
    ranked, met = [], set()
    for i, doc, score, text in sorted(rows, key=lambda r: (worst if r[2] is None else -r[2], r[0])):
        form = " ".join((text or "").lower().split())
        if form not in met:
            met.add(form)
            ranked.append((i, doc, int(len(form.split()) * 1.3)))
    ranked, taken, used = ranked[:most], [], 0
    documents = list(dict.fromkeys(d for _, d, _ in ranked))
    first = [r for d in documents for r in [x for x in ranked if x[1] == d][:each]]
    for r in first + [x for x in ranked if x not in first]:
        if used + r[2] <= budget:
            taken.append(r)
            used += r[2]
    taken = taken or ranked[:1]
    return [(*r, n) for n, r in enumerate([x for x in ranked if x in taken], 1)], sum(r[2] for r in taken)


@pytest.mark.parametrize(("budget", "each", "most"), [(8000, 1, 100), (20, 1, 100), (20, 2, 100), (20, 0, 100), (1, 1, 100), (30, 1, 4)])
def test_windows(spark, budget, each, most):
    rng = random.Random(budget + each)
    words = ["river", "Mill", "mill", "stone"]
    rows = [(q, i, rng.choice(["a", "b", "c", None]), rng.choice([None, 0.5, 0.7, 0.9, 1.0]), rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 12)))])) for q in [1, 2, 3, None] for i in range(25)]
    rows.append((4, 1, "a", 0.5, "river " * 40_000))
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "q int, i int, d string, score double, content string, o string, text int")
    got = {}
    for r in context.windows(df, "q", "i", "d", budget=budget, each=each, most=most).collect():
        got.setdefault(r["q"], []).append((r["i"], r["d"], r["tokens"], r["rank"], r["used"]))
    for q in [1, 2, 3, None, 4]:
        want, used = choose([r[1:] for r in rows if r[0] == q], budget, each, most)
        assert sorted(got[q], key=lambda r: r[3]) == [(*w, used) for w in want]
    assert context.windows(df.limit(0), "q", "i", "d").count() == 0
