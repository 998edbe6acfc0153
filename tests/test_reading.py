import random

from quillspark.operators import reading
from quillspark.sources import hocr

PAGE = """<html><head><meta charset="utf-8"></head><body>
<div class='ocr_page' id='p1' title='image "a.png"; bbox 0 0 1000 1400'>
 <div class='ocr_carea' id='b1' title="bbox 50 60 400 200"> head
  <p class='ocr_par' title="bbox 50 60 400 100"><span class='ocr_line' title="bbox 50 60 400 80; baseline 0"> a &amp;
   <span class='ocrx_word' id='w1' title='bbox 50 60 90 80; x_wconf 93'>One</span> tail<br>more <span class='ocrx_word' title='bbox 95 60 120 80'><strong>Two</strong></span></span></p>
 </div>
 <section><div class='ocr_carea' title='bbox 1 1 2 2'>hidden</div></section>
 <div class='ocr_carea'>no box<span class='ocrx_word' title='bbox 3 3 4 4'>x</span></div>
 <div class='ocr_block' id='b2' title='bbox 500 60 900 200'>right</div>
</div>
<div class='ocr_page'><div class='ocr_carea' title='bbox 1 1 2 2'>lost</div></div>
<div class='ocr_page' title='bbox 0 0 10 20'><span class='ocr_textfloat' title='bbox 1 2 3 4'>t</span></div></body></html>"""


def test_hocr(spark):
    rows = hocr.parse_hocr(PAGE)
    short = [(r["page"], r["no"], r["parent"], r["depth"], r["kind"], r["element_id"], r["text"], r["confidence"]) for r in rows]
    assert short == [
        (1, 0, None, 0, "block", "b1", "head", 0.0), (1, 1, 0, 1, "paragraph", "", "", 0.0), (1, 2, 1, 2, "line", "", "a & tail more", 0.0),
        (1, 3, 2, 3, "word", "w1", "One", 0.93), (1, 4, 2, 3, "word", "", "", 0.0), (1, 5, None, 0, "block", "b2", "right", 0.0), (3, 6, None, 0, "line", "", "t", 0.0),
    ]
    assert (rows[0]["width"], rows[0]["height"], rows[5]["x1"], rows[5]["y2"]) == (1000, 1400, 500, 200)
    df = spark.createDataFrame([(1, PAGE, "x"), (2, None, "x"), (3, "", "x"), (4, "<div class='ocr_page' title='bbox 0 0 5 5'><span class=ocrx_word title='bbox 1 1 2 2'>open", "x")], "doc_id long, content string, page string")
    got = hocr.hocr_elements(df).collect()
    assert [(r.no, r.text) for r in sorted(got, key=lambda r: (r.doc_id, r.no))] == [(r["no"], r["text"]) for r in rows] + [(0, "open")]


def by_gaps(page, width):
    """Reading order by merged spans, gaps and columns between gaps, step by step."""
    merged = []
    for a, b in sorted((e[1], e[3]) for e in page):
        if merged and a <= merged[-1][1] + 50:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
        else:
            merged.append((a, b))
    gaps, end = [], 0
    for a, b in merged:
        if a - end > 50:
            gaps.append((end, a))
        end = max(end, b)
    columns, end = [], 0
    for a, b in gaps:
        if a > end:
            columns.append((end, a))
        end = b
    if end < width or not gaps:
        columns.append((end, width))
    held = [[] for _ in columns]
    for e in page:
        middle = (e[1] + e[3]) // 2
        at = next((k for k, (a, b) in enumerate(columns) if a <= middle <= b), None)
        if at is None and columns:
            at = min(range(len(columns)), key=lambda k: abs((columns[k][0] + columns[k][1]) // 2 - middle))
        if at is not None:
            held[at].append(e)
    return [(e[0], k) for k, es in enumerate(held) for e in sorted(es, key=lambda e: e[2])], len(columns)


def test_reading_order(spark):
    rng = random.Random(4)
    rows = []
    for p in range(40):
        lefts = rng.choice([[20], [60, 520], [0, 350, 700], [10, 210, 420, 640], [90, 140]])
        for no in range(rng.randint(1, 12)):
            x, y = rng.choice(lefts) + rng.randint(-5, 5), rng.randint(0, 9) * 40
            rows.append((p, no, rng.choice([900, 1000]) if p % 7 else 500, max(x, 0), y, max(x, 0) + rng.choice([80, 130, 0]), y + 30))
    widths = {p: next(r[2] for r in rows if r[0] == p) for p in range(40)}
    rows = [(p, no, widths[p], *rest) for p, no, _, *rest in rows] + [(99, 0, 100, None, 1, 2, 3)]
    got = {}
    for r in reading.reading_order(spark.createDataFrame(rows, "page int, no int, width int, x1 int, y1 int, x2 int, y2 int").repartition(3), ["page"]).orderBy("page", "place").collect():
        got.setdefault(r.page, []).append((r.no, r.column, r.layout))
    names = {1: "single_column", 2: "two_column", 3: "three_column"}
    for p, width in widths.items():
        order, many = by_gaps([(r[1], *r[3:]) for r in rows if r[0] == p], width)
        assert got.pop(p) == [(no, k, names.get(many, "multi_column")) for no, k in order], p
    assert not got


def test_grids(spark):
    cells = [(0, 10, 12, 60, 22, "Name"), (1, 205, 10, 260, 20, "Age"), (2, 8, 50, 60, 80, "Ann"), (3, 200, 58, 230, 84, "41"), (4, 400, 52, 430, 80, "x"), (5, 12, 100, 60, 130, "Bob"), (6, 0, 300, 700, 500, "a paragraph")]
    assert reading.grid_of(cells) == ([["Name", "Age", ""], ["Ann", "41", "x"], ["Bob", "", ""]], True)
    assert reading.grid_of(cells[:3]) == ([], False) and reading.grid_of([(i, 10, 40 * i, 20, 40 * i + 9, "a") for i in range(6)]) == ([], False)
    assert reading.grid_of([(i, 100 * i, 3 * i, 100 * i + 20, 30, "a") for i in range(5)]) == ([], False)
    # rows are measured from their first box: edges may not drift on
    drift = [(i, 100 * (i % 2), 10 * i, 100 * (i % 2) + 50, 10 * i + 9, str(i)) for i in range(6)]
    assert reading.grid_of(drift)[0] == [["0", "1"], ["2", "3"], ["4", "5"]]
    df = spark.createDataFrame([("p", *c) for c in cells] + [("q", *c) for c in cells[:2]] + [("p", 9, None, 1, 1, 1, "z")], "page string, no int, x1 int, y1 int, x2 int, y2 int, text string")
    got = {(r.page, r.row, r.col): (r.text, r.is_header) for r in reading.grid_tables(df, ["page"]).collect()}
    assert len(got) == 9 and got["p", 1, 1] == ("41", False) and got["p", 0, 0] == ("Name", True)


def test_plain_files_are_read_alike(monkeypatch):
    """Files of plain tags never reach the general parser, and nothing else is read without it."""
    rng = random.Random(5)
    pieces = ["<div class='ocr_page' title='bbox 0 0 9 9'>", "<div class=\"ocr_carea\" title='bbox 1 1 2 2'>", "<span class='ocrx_word' id='w' title=\"bbox 1 2 3 4; x_wconf 9\">", "</div>", "</span>", "</p>", "<p>", " a b ", "é > x", "\n"]
    odd = ["&amp;", "<br>", "<DIV>", "<!-- x -->", "< 3", "<p hidden>", "<span class=ocrx_word>", "</div >", "<", "<script>", "</p class='x'>", "<p title='a\nb'>", "&"]

    def general(content):
        parser = hocr._Elements()
        parser.feed(content)
        parser.close()
        return [{**r, "text": " ".join(r["text"])} for r in parser.rows]

    plain = [pieces[0] + "".join(rng.choices(pieces[1:], k=rng.randint(0, 25))) for _ in range(300)]
    mixed = [pieces[0] + "".join(rng.choices(pieces + odd, k=rng.randint(0, 25))) for _ in range(600)]
    for content in [*plain, *mixed, PAGE]:
        assert hocr.parse_hocr(content) == general(content)
    want = [hocr.parse_hocr(p) for p in plain]
    monkeypatch.setattr(hocr._Elements, "feed", None)
    assert [hocr.parse_hocr(p) for p in plain] == want and any(want)
