import random

from pyspark.sql import functions as F

from quillspark.operators import layout


def test_intervals(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["p", "q", None]), rng.randint(-50, 3000), rng.choice([0, 1, 7, 600, 1500])) for i in range(120)]
    a = [(k, i, x, x + n) for i, k, x, n in rows[:60]] + [("p", 900, None, 5), ("p", 901, 9, 2)]
    b = [(k, i, x, x + n) for i, k, x, n in rows[60:]] + [("p", 902, 5, None)]
    want = sorted((k, i, j, max(x, u), min(y, v)) for k, i, x, y in a for kk, j, u, v in b if k and k == kk and None not in (x, y, u, v) and max(x, u) < min(y, v))
    df = [spark.createDataFrame(r, "doc string, id int, low long, high long").withColumn("cell", F.lit("x")) for r in (a, b)]
    assert want
    for cell in (1, 64, 100_000):
        found = layout.overlapping(*df, "doc", cell)
        assert sorted(tuple(r) for r in found.collect()) == want
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_boxes(spark):
    rng = random.Random(2)
    boxes = [(rng.choice([1, 2]), i, x, y, x + rng.choice([0, 3, 40, 300]), y + rng.choice([1, 9, 200])) for i in range(90) for x, y in [(rng.randint(-20, 500), rng.randint(0, 400))]] + [(1, 99, None, 0, 5, 5)]
    df = spark.createDataFrame(boxes, "page int, id int, x1 int, y1 int, x2 int, y2 int")
    want = []
    for p, i, *s in boxes:
        for q, j, *t in boxes:
            if p == q and None not in s + t:
                both = (max(s[0], t[0]), max(s[1], t[1]), min(s[2], t[2]), min(s[3], t[3]))
                if both[0] < both[2] and both[1] < both[3]:
                    want.append((p, i, j, *both))
    for cell in (16, 128, 10_000):
        assert sorted(tuple(r) for r in layout.overlapping_boxes(df, df, cell=cell).collect()) == sorted(want)
    around = {r.page: tuple(r)[1:] for r in layout.enclosing_boxes(df, ["page"]).collect()}
    for p in (1, 2):
        mine = [b[2:] for b in boxes if b[0] == p and b[2] is not None]
        assert around[p] == (min(b[0] for b in mine), min(b[1] for b in mine), max(b[2] for b in mine), max(b[3] for b in mine), len(mine))


def one_text(elements, text, low, high):
    """Elements of a range, looked for one after the other."""
    out, at = [], 0
    for no, e in elements:
        start = text.find(e, at) if e else -1
        if start >= 0:
            if start < high and start + len(e) > low:
                out.append(no)
            at = start + 1
    return out


def test_ranges_of_texts(spark):
    rng = random.Random(3)
    texts = {i: "".join(rng.choice("ab é𝒳") for _ in range(rng.randint(0, 1500))) for i in range(12)}
    elements = [(i, n, t[x : x + rng.randint(0, 6)] if rng.random() < 0.9 else "zz") for i, t in texts.items() for n, x in enumerate(sorted(rng.choices(range(len(t) + 1), k=40)))]
    ranges = [(i, r, x, x + rng.randint(0, 300)) for i in texts for r, x in enumerate(rng.choices(range(1500), k=5))]
    want = sorted((i, r, n) for i, r, x, y in ranges if x < y for n in one_text([(n, e) for k, n, e in elements if k == i], texts[i], x, y))
    el = spark.createDataFrame([(i, n, n, e) for i, n, e in elements] + [(1, 77, 77, None), (99, 1, 1, "a")], "doc int, id int, no int, text string")
    got = layout.elements_in_ranges(el, spark.createDataFrame([*texts.items(), (50, None)], "doc int, text string"), spark.createDataFrame(ranges, "doc int, id int, low int, high int"), "doc")
    assert sorted(tuple(r) for r in got.collect()) == want and want


def test_linked(spark):
    boxes = spark.createDataFrame([(1, "Acme", "k"), (2, "ACME INC", "k"), (3, "", "k"), (4, None, "k"), (5, "other", "k"), (6, "shared", "k")], "id int, label string, place string")
    entities = spark.createDataFrame([("e1", 2, "acme", ["Acme Inc", "shared"]), ("e2", 1, "Beta", ["SHARED"]), ("e3", 3, None, None), ("e4", 4, "ACME", [])], "entity string, place int, label string, variations array<string>")
    got = layout.linked_boxes(boxes, entities)
    assert got.columns == ["id", "label", "place", "entity"]
    assert {(r.id, r.entity) for r in got.collect()} == {(1, "e1"), (2, "e1"), (6, "e2")}


def test_ranges_in_a_row(spark):
    """Lists that lie beside their text: nulls and empty ranges, and the query moves no word between tasks."""
    from quillspark.plans import registry

    text = "a bb a ccc é𝒳 bb"
    words = [(n, 10 + n, w) for n, w in enumerate(["a", "bb", "", None, "zz", "ccc", "a", "bb"])]
    rows = [(1, text, words, [(0, 0, 3), (1, 3, 9), (2, 5, 5), (3, None, 4), (4, 2, 99)]), (2, None, words, [(0, 0, 9)]), (3, "x", None, [(0, 0, 9)]), (4, "x", words, None), (5, "", [], [(0, 0, 9)])]
    df = spark.createDataFrame(rows, "doc long, text string, elements array<struct<no:int,id:int,text:string>>, ranges array<struct<id:long,low:long,high:long>>")
    want = [(1, r, 10 + n) for r, x, y in [(0, 0, 3), (1, 3, 9), (4, 2, 99)] for n in one_text([(n, w) for n, _, w in words], text, x, y)]
    assert sorted(tuple(r) for r in layout.in_ranges(df.coalesce(1), "doc").collect()) == want and len(want) == 7
    plan = registry.queries()["elements_in_ranges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "MapInPandas" not in plan
