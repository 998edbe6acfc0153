import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.functions.term_patterns import TABLE, TOLD, TermPattern
from quillspark.operators import terms
from quillspark.schema import chunks


def brute(text, domain, most, table=TABLE):
    """Every pattern over the whole text, span by span."""
    if not text or not text.strip():
        return []
    hits = [(p, m) for p in table for m in re.finditer(p.pattern, text, re.IGNORECASE)]
    if domain is None:
        counts = [sum(p.domain == d for p, _ in hits) for d in TOLD]
        domain = TOLD[counts.index(max(counts))] if max(counts) else "general"
    spans = {}
    for wanted in [domain] if domain == "general" else [domain, "general"]:
        for p, m in hits:
            if p.domain == wanted and p.confidence > spans.get(m.span(), (0, 0))[0]:
                spans[m.span()] = (p.confidence, p)
    ranked = sorted(spans.items(), key=lambda x: -x[1][0])
    return [(*s, text[s[0] : s[1]], p.domain, p.category, c) for s, (c, p) in ranked[:most]]


CASES = [
    "The Renaissance followed the Middle Ages; World War II and world  war 2, WORLD WAR",
    "Treaty of Versailles, treaty of  x and Battle of Hastings in the 11th century, 3RD CENTURY",
    "Newton's Laws, Charles' law, ohm's Principle; photosynthesis of an atom, ion and ions, 12.5 km, 3 meters 7litres",
    "Freud's theory and cognitive dissonance; PTSD ptsd OCDs; prefrontal cortex hypothalamus thalamus",
    "An Atom is  small. Gravity refers to mass. Mass Means More Than Weight is what",
    "ſilver and K 5 ١ seconds, goldİron, Mİtosis silver-gold gold_",
    "revolutionary war civil war of the Revolution of Paris, Industrial Revolution of Lyon",
    "", "   ", "12", "Treaty of",
]


@pytest.mark.parametrize("domain", [None, "history", "science", "psychology", "general", "law"])
def test_one_text(domain):
    finder = terms.Finder()
    for text in CASES:
        assert finder.terms(text, domain, None) == brute(text, domain, None)
        assert finder.terms(text, domain, 2) == brute(text, domain, 2)


WORDS = [w for p in TABLE for w in p.heads[:3] + p.anchors[:2]] + ["II", "4", "is", "Rome", "century", "Law", "st", "1", "'s", "x"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from([" ", "  ", "", "\n", ". ", "ſ", "İ"]), st.sampled_from([str.lower, str.upper, str])), max_size=12), st.sampled_from([None, *TOLD]))
def test_any_text(parts, domain):
    text = "".join(f(w) + s for w, s, f in parts)
    assert terms.Finder().terms(text, domain, None) == brute(text, domain, None)


def test_all_documents(spark, sf_dir):
    docs = chunks(spark, sf_dir)
    got = {}
    for r in terms.find_terms(docs, None, None).orderBy("doc_id", "rank").collect():
        got.setdefault(r[0], []).append(tuple(r)[2:])
    rows = docs.select("doc_id", "content").collect()
    assert got == {i: t for i, text in rows if (t := brute(text, None, None))}
    told = dict(terms.domains(docs).collect())
    assert set(told) == {i for i, _ in rows} and set(told.values()) <= {*TOLD, "general"}


def test_rows(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*CASES, None])], "k int, body string, rank string")
    own = (TermPattern(r"\bgold\w*", "law", "metal", 2.0, ("gold",)), *TABLE)
    got = [tuple(r) for r in terms.find_terms(docs, "law", 3, "k", "body", own).orderBy("k", "rank").collect()]
    assert got == [(k, n, *t) for k, text in enumerate(CASES) for n, t in enumerate(brute(text, "law", 3, own))]
    assert {r.term for r in terms.term_counts(terms.find_terms(docs, "science", None, "k", "body")).collect()} >= {"atom", "photosynthesis"}
    assert terms.find_terms(docs.limit(0), None, 5, "k", "body").count() == 0
