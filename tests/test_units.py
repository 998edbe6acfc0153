"""Legal sections and code units on hand-worked texts, and spans that hold every line once."""

import math

from quillspark.functions import vectors
from quillspark.operators import units

CONTRACT = """Between A and B.

ARTICLE II - Scope
1. Terms
Text of one.
1.1 First
(a) letter
1.1.2: Deep
2.1 Orphan
Sec. 3.1
IV. Roman
§ 4.2 – Mark
¶7
"""


def sections(spark, texts, **kw):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, content string, number string")
    return sorted(units.legal_sections(docs, **kw).collect(), key=lambda r: (int(r["document_id"]), r["chunk_index"]))


def test_headings_and_parents(spark):
    got = [(r["number"], r["title"], r["level"], r["hierarchy"], r["line_start"], r["line_end"]) for r in sections(spark, [CONTRACT], preamble=True)]
    assert got == [
        ("", "", 0, [], 0, 1),
        ("Article II", "Scope", 1, [], 2, 2),
        ("1", "Terms", 1, [], 3, 4),
        ("1.1", "First", 2, ["1"], 5, 5),
        ("(a)", "letter", 3, [], 6, 6),
        ("1.1.2", "Deep", 3, ["1", "1.1"], 7, 7),
        ("2.1", "Orphan", 2, [], 8, 8),
        ("3.1", "", 2, [], 9, 9),
        ("IV", "Roman", 1, [], 10, 10),
        ("§4.2", "Mark", 2, [], 11, 11),
        ("§7", "", 1, [], 12, 13),
    ]
    assert [r["number"] for r in sections(spark, [CONTRACT])][0] == "Article II"


def test_texts_without_headings_and_without_rows(spark):
    got = sections(spark, ["plain\ntext ", None, "", " \n\t", "1. " + "x" * 200])
    assert [(r["document_id"], r["number"], r["content"], r["line_end"]) for r in got] == [("0", "1", "plain\ntext", 1), ("4", "1", "1. " + "x" * 200, 0)]


def test_long_sections_are_cut_and_lose_nothing(spark):
    paragraphs = ["1. Long", "a" * 30, "One sentence here. And another one there. " + "b" * 50 + " end.", "c" * 10, "d" * 10]
    got = sections(spark, ["\n\n".join(paragraphs)], most=40)
    assert [r["content"] for r in got] == ["1. Long\n\n" + "a" * 30, "One sentence here.", "And another one there.", "b" * 50 + " end.", "c" * 10 + "\n\n" + "d" * 10]
    assert [(r["section_no"], r["part_no"], r["chunk_index"]) for r in got] == [(0, i, i) for i in range(5)]


def test_spans_of_sections_hold_every_line_once(spark):
    many = "\n".join(f"{i % 7}.{i % 3} h\ntext {i}\n" for i in range(3000))
    got = sections(spark, ["lead\n" + many, CONTRACT], preamble=True)
    for no, text in enumerate(["lead\n" + many, CONTRACT]):
        assert [i for r in got if r["document_id"] == str(no) for i in range(r["line_start"], r["line_end"] + 1)] == list(range(text.count("\n") + 1))


PYTHON = '''"""Doc."""
import os, sys
from a import (
    b,
)

X = 1

@wrap(1)
@more
async def one(a):
    def inner(): pass
    return a

@final
class Small:
    def m(self): pass

class Big(Small):
    """%s"""
    y = 2

    @property
    def p(self):
        return 1
    z = 3
    def q(self): return 2
print(X)
''' % ("x" * 300)


def code(spark, files, **kw):
    rows = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(files)], "doc_id long, source_file string, content string")
    return sorted(units.code_units(rows, **kw).collect(), key=lambda r: (int(r["document_id"]), r["chunk_index"]))


def brief(rows):
    return [(r["kind"], r["name"], r["parent"], r["line_start"], r["line_end"]) for r in rows]


def test_python_by_its_tree(spark):
    want = [("imports", "imports", None, 1, 5), ("function", "one", None, 9, 13), ("class", "Small", None, 15, 17), ("class_header", "Big (header)", None, 19, 22), ("method", "p", "Big", 23, 25), ("method", "q", "Big", 27, 27)]
    got = code(spark, [("a/b.PY", PYTHON)], most=300)
    assert brief(got) == want
    assert got[0]["content"] == "import os, sys\nfrom a import (\n    b,\n)" and [r["section_title"] for r in got[1:]] == ["one()", "class Small", "Big (header)", "Big.p()", "Big.q()"]
    whole = code(spark, [("b.py", PYTHON)], most=300, rest=True)
    assert brief(whole)[6:] == [("module", "module", None, 1, 1), ("module", "module", None, 6, 8), ("module", "module", None, 26, 26), ("module", "module", None, 28, 29)]
    held = [line for r in whole for line in r["content"].split("\n") if line.strip()]
    assert sorted(held) == sorted(line for line in PYTHON.split("\n") if line.strip())


JAVA = """package p;
// class Not {
public class A {
  String s = "}";
  public int f(int x) {
    return 1;
  }
  class B {
    private void g() { }
  }
}
interface C;
}
class D {
  int h() {
"""


def test_scopes_of_other_languages(spark):
    got = code(spark, [("A.java", JAVA), ("x.rs", "struct S;\nimpl<'a> S {\n  pub fn f(&'a self) {}\n}\nfn g() {}"), ("n.go", "// nothing"), ("t.rb", "def a\nend"), (None, "x"), ("bad.py", "def ("), ("e.py", " "), ("n.py", None)])
    by = lambda i: brief(r for r in got if r["document_id"] == str(i))
    assert by(0) == [("imports", "header", None, 1, 2), ("class", "A", None, 3, 4), ("function", "f", "A", 5, 7), ("class", "B", "A", 8, 8), ("function", "g", "B", 9, 11), ("class", "C", None, 12, 13), ("class", "D", None, 14, 14), ("function", "h", "D", 15, 16)]
    assert by(1) == [("class", "S", None, 1, 1), ("class", "S", None, 2, 2), ("function", "f", "S", 3, 4), ("function", "g", None, 5, 5)]
    assert [by(i) for i in range(2, 6)] == [[("module", "module", None, 1, n)] for n in (1, 2, 1, 1)] and not by(6) and not by(7)
    spans = [i for r in by(0) for i in range(r[3], r[4] + 1)]
    assert spans == list(range(1, JAVA.count("\n") + 2))


def test_chapter_markers(spark):
    text = "\n\nCHAPTER 1\n\nIntroduction\nch. iv: Sea\nPart of it\nSection 2.1 x\n3. Title here\n### Deep\n# A\nNASA\nRESULTS\n- LIST ITEM\n\t LOUD WORDS 12\n" + "X" * 101
    docs = spark.createDataFrame([(1, text, 9), (2, None, 9), (3, "", 9), (4, "none here", 9)], "doc_id long, content string, level int")
    got = [(r["document_id"], r["position"], r["level"], r["title"]) for r in units.chapter_markers(docs).orderBy("position").collect()]
    want = [("CHAPTER 1", 1, "CHAPTER 1"), ("ch. iv", 1, "ch. iv: Sea"), ("Section", 2, "Section 2.1 x"), ("3. T", 2, "3. Title here"), ("###", 3, "Deep"), ("# A", 2, "# A"), ("RESULTS", 2, "RESULTS"), ("LOUD", 2, "LOUD WORDS 12")]
    assert got == [("1", text.index(at), level, title) for at, level, title in want]


def test_joined_lines(spark):
    long = "x" * 60
    cases = [
        ("a b\nc d\nE f", "a b c d\nE f"),
        ("Ends here.\nlower", "Ends here.\nlower"),
        (f"{long}\nAnd more", f"{long}\nAnd more"),
        ("  short\nAnd more\nBut no", "short And more But no"),
        ("  short \nNext", "short\nNext"),
        ("a\nb\nc\nd\ne\nf\ng", "a b c d e\nf g"),
        ("a\n\nb", "a\n\nb"),
        ("a\n1b", "a\n1b"),
        ("", ""),
        (None, None),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r[0] for r in rows.orderBy("i").select(units.joined_lines("t")).collect()] == [w for _, w in cases]


def test_packed_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, -2.5, 1e-8, 70000.0, None]), (2, None), (3, []), (4, [0.1, 2049.0])], "i int, v array<float>")
    got = {r["i"]: (r["p"], r["u"]) for r in rows.select("i", vectors.packed_half("v").alias("p")).select("i", "p", vectors.unpacked_half("p").alias("u")).collect()}
    assert len(got[1][0]) == 10 and got[1][1][:4] == [1.0, -2.5, 0.0, math.inf] and math.isnan(got[1][1][4])
    assert got[2] == (None, None) and got[3] == (b"", []) and got[4][1] == [0.0999755859375, 2048.0]
