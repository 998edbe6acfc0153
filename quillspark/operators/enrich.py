"""Row enrichment: metadata of a chunk, element kinds, techniques of log events, contradictions, extracts, questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text

#: Forms of dates, numbers, links and addresses.
DATES = r"(?i)\b([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+[0-9]{1,2},?\s+[0-9]{4}|[0-9]{4}[/-][0-9]{2}[/-][0-9]{2})\b"
NUMBERS = r"\b([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?%?)"
URLS = r"(https?://[^\s<>\"{}|\\^`\[\]]+)"
EMAILS = r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b"
#: Techniques by words of an event's name.
TECHNIQUES = {"runinstances": "T1578", "createuser": "T1136", "deleteuser": "T1531", "putobject": "T1537", "getobject": "T1530", "login": "T1078", "password": "T1110", "execute": "T1059"}
#: Pairs of opposites.
ANTONYMS = [("hot", "cold"), ("true", "false"), ("yes", "no"), ("increase", "decrease"), ("rise", "fall"), ("up", "down"), ("more", "less"), ("greater", "fewer"), ("higher", "lower"), ("gain", "loss"), ("success", "failure"), ("win", "lose"), ("start", "stop"), ("begin", "end"), ("open", "close"), ("alive", "dead"), ("present", "absent"), ("before", "after")]
#: Words that negate. Those of two words are never met, as texts are compared word by word.
NEGATIONS = [
    "not", "no", "never", "none", "nothing", "neither", "nor", "cannot", "can not", "won not", "wouldn not", "shouldn not", "couldn not", "isn not", "aren not", "wasn not", "weren not", "hasn not", "haven not",
    "hadn not", "doesn not", "don not", "didn not", "without", "lacks", "absent", "missing", "false", "incorrect", "untrue", "deny", "denies", "denied", "refuse", "refuses", "refused", "opposite",
]


def metadata(content: Column) -> list[Column]:
    """dates, numbers, urls, emails, has_list, has_headers, paragraph_count."""
    every = lambda p: F.regexp_extract_all(content, F.lit(p), F.lit(1))
    return [
        every(DATES).alias("dates"),
        every(NUMBERS).alias("numbers"),
        every(URLS).alias("urls"),
        every(EMAILS).alias("emails"),
        content.rlike(r"(?m)^\s*(?:[-*•]|[0-9]+[.)])\s+").alias("has_list"),
        content.rlike(r"(?m)^#{1,6}\s+").alias("has_headers"),
        (F.size(F.split(content, "\n\n"))).alias("paragraph_count"),
    ]


def element_type(content: Column) -> Column:
    """Code, Table, Image, ListItem, Header, Title or NarrativeText, by the first form that fits; Uncategorized if empty."""
    kinds = [
        ("Code", r"(?m)^```[\s\S]*?```$|^    .+$|(?:def \w+\s*\(|class \w+\s*[:(]|function \w+\s*\()"),
        ("Table", r"(?m)^\|.+\|$"),
        ("Image", r"(?i)!\[.*?\]\(.*?\)|\[Figure\s+[0-9]+\]|\[Image\s*:?\s*.*?\]"),
        ("ListItem", r"(?m)^\s*(?:[-•●○▪▸]|[0-9]+[.)]|[a-z][.)]|[ivxIVX]+[.)])\s+"),
        ("Header", r"^#{1,6} "),
        ("Title", r"^[A-Z][^\n.!?]{0,80}$"),
    ]
    out = F.lit("NarrativeText")
    for name, pattern in reversed(kinds):
        out = F.when(content.rlike(pattern), name).otherwise(out)
    return F.when(content == "", "Uncategorized").otherwise(out)


def techniques(event: Column) -> Column:
    """Distinct technique ids whose word the event's name contains, in order."""
    low = F.lower(event)
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(t)) for w, t in TECHNIQUES.items()])))


def contradiction(a: Column, b: Column, gate: float = 0.7) -> Column:
    """Similarity times the sum of 0.3, if one side alone negates, and 0.2, if the sides hold opposites; 0 for
    unrelated claims (similarity below the gate). Words are runs of non-blanks in lower case; their Jaccard
    similarity stands in for that of embeddings, which need a model."""
    x, y = F.array_distinct(text.blank_split(F.lower(a))), F.array_distinct(text.blank_split(F.lower(b)))
    negs, similar = text.literal_array(NEGATIONS), text.jaccard(x, y)
    negated = F.arrays_overlap(x, negs) != F.arrays_overlap(y, negs)
    has = F.array_contains
    opposite = F.greatest(*[(has(x, p) & has(y, q)) | (has(x, q) & has(y, p)) for p, q in ANTONYMS])
    score = similar * (F.when(negated, 0.3).otherwise(0.0) + F.when(opposite, 0.2).otherwise(0.0))
    return F.when(similar >= gate, F.round(score, 6)).otherwise(0.0)


def support(claim: Column, evidence: Column, refute: float = 0.5, agree: float = 0.5, gate: float = 0.7) -> Column:
    """REFUTES, SUPPORTS or NEUTRAL, tested in that order."""
    similar = text.jaccard(F.array_distinct(text.blank_split(F.lower(claim))), F.array_distinct(text.blank_split(F.lower(evidence))))
    return F.when(contradiction(claim, evidence, gate) >= refute, "REFUTES").when(similar >= agree, "SUPPORTS").otherwise("NEUTRAL")


def extract(chunks: DataFrame, sentences: int = 2, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    """The sentences with the largest mean word frequency within their text, in their order: id, summary."""
    rows = chunks.select(F.col(id_col).alias("id"), F.posexplode(text.sentences(F.col(content))).alias("place", "sentence"))
    w = rows.select("id", "place", F.explode(text.search_tokens(F.col("sentence"))).alias("word"))
    counts = w.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    scored = w.join(counts, ["id", "word"]).groupBy("id", "place").agg(F.avg("n").alias("score"))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("score", 9)), "place"))).where(F.col("r") <= sentences)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence"))), lambda p: p["sentence"])
    return rows.join(best, ["id", "place"]).groupBy("id").agg(F.array_join(parts, " ").alias("summary"))


def questions(content: Column) -> Column:
    """Template questions for 'X is a Y' statements of a text."""
    found = F.regexp_extract_all(content, F.lit(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)*) (?:is|are|was|were) (?:an?|the) "), F.lit(1))
    return F.transform(F.array_distinct(found), lambda x: F.concat(F.lit("What is "), x, F.lit("?")))


def clozes(content: Column) -> Column:
    """Sentences with a number, the first number blanked: array of (question, answer)."""
    number = r"\b([0-9]+(?:\.[0-9]+)?)\b"
    return F.transform(F.filter(text.sentences(content), lambda s: s.rlike(number)), lambda s: F.struct(F.regexp_replace(s, r"^(.*?)\b[0-9]+(?:\.[0-9]+)?\b", "$1____").alias("question"), F.regexp_extract(s, number, 1).alias("answer")))


def grounding(answer: Column, context: Column) -> Column:
    """Share of an answer's words that its context holds."""
    a = F.array_distinct(text.search_tokens(answer))
    return F.when(F.size(a) > 0, F.round(F.size(F.array_intersect(a, F.array_distinct(text.search_tokens(context)))) / F.size(a), 6)).otherwise(0.0)
