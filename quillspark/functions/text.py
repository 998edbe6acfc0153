"""Text functions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"

#: Stop words of keyword search.
SEARCH_STOPWORDS = """the a an is are was were be been being have has had do does did will would could should may might must
shall can to of in for on with at by from as into through during before after and or but if than that this these those it its
they them their we us our you your he him his she her not""".split()
#: Stop words of quality scoring, beyond those of search.
QUALITY_STOPWORDS = [*SEARCH_STOPWORDS, *"which what who whom when where why how no".split()]
#: Stop words of corpus statistics.
CORPUS_STOPWORDS = "the and for with this that from are was has have been will can may also their which".split()


def let(value: Column, f) -> Column:
    """f(value) with value worked out once, however often f uses it."""
    return F.transform(F.array(value), f).getItem(0)


def literal_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def words(text: Column) -> Column:
    """Lower-cased Unicode words, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def search_tokens(text: Column, stopwords=SEARCH_STOPWORDS) -> Column:
    """Words of more than one character that are no stop words."""
    stop = literal_array(stopwords)
    return F.filter(words(text), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def blank_split(text: Column) -> Column:
    """Runs of non-blank characters, in order."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def normalize_whitespace(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_text(text: Column, remove_urls: bool = False) -> Column:
    """At most one empty line, single blanks, no white space at the ends; URLs removed on request."""
    out = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), " {2,}", " ")
    if remove_urls:
        out = F.regexp_replace(out, r"https?://[^\s]+", "")
    return strip(out)


def truncate(text: Column, most: int, suffix: str = "...") -> Column:
    """At most `most` characters, the suffix included."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(suffix)), F.lit(suffix))).otherwise(text)


def sentences(text: Column) -> Column:
    """Split behind . ! ? followed by white space; a mark is put at each boundary, then split at."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), strip), lambda s: s != "")


def dedup_normalized(text: Column) -> Column:
    """Lower case, letters, digits and underscores only, single blanks."""
    return normalize_whitespace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", ""))


def shingles(text: Column, size: int = 3) -> Column:
    """Distinct runs of `size` blank-separated words of the normalised text; the whole text if it is shorter."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
    return let(dedup_normalized(text), lambda norm: let(blank_split(norm), lambda w: F.when(F.size(w) >= size, F.array_distinct(runs(w))).otherwise(F.array(norm))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def sanitize_tag(tag: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(tag), "[^a-z0-9]", ""), 1, 32)


def content_hash(text: Column) -> Column:
    return F.sha2(strip(text), 256)


def token_sort(name: Column) -> Column:
    return F.array_join(F.array_sort(blank_split(F.lower(name))), " ")


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance of the sorted tokens / the longer length."""
    x, y = token_sort(a), token_sort(b)
    return F.when(F.greatest(F.length(x), F.length(y)) == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


#: Address words and their short forms.
ADDRESS_WORDS = {"STREET": "ST", "AVENUE": "AVE", "BOULEVARD": "BLVD", "DRIVE": "DR", "ROAD": "RD", "LANE": "LN", "APARTMENT": "APT", "SUITE": "STE", "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W"}


def normalize_address(address: Column) -> Column:
    """Upper case, without full stops and commas, street words and directions shortened."""
    out = F.regexp_replace(F.upper(address), "[.,]", "")
    for long, short in ADDRESS_WORDS.items():
        out = F.regexp_replace(out, rf"\b{long}\b", short)
    return normalize_whitespace(out)


#: Bullet characters that become a hyphen.
BULLETS = "\u2022\u2023\u2043\u25aa\u25ab\u25cf\u25cb\u25e6\u2219\u00b7\u2013\u2014\u27a2\u2192\u25ba\u25b6"


def clean_bullets(text: Column) -> Column:
    return F.translate(text, BULLETS, "-" * len(BULLETS))


#: Line forms of page numbers.
PAGE_LINES = [r"(?m)^\s*-?\s*[0-9]{1,4}\s*-?\s*$", r"(?mi)^\s*page\s+[0-9]+(?:\s+of\s+[0-9]+)?\s*$"]


def drop_page_numbers(text: Column) -> Column:
    for pattern in PAGE_LINES:
        text = F.regexp_replace(text, pattern, "")
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


#: Personal data by type, in the order of replacement.
PII = {
    "EMAIL": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "CREDIT_CARD": r"\b[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}\b",
    "SSN": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "PHONE": r"\b[0-9]{3}[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b|\([0-9]{3}\)\s*[0-9]{3}[-.\s]?[0-9]{4}",
    "IP_ADDRESS": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "DATE_OF_BIRTH": r"\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}\b",
}


def redact(text: Column, types=tuple(PII)) -> Column:
    """Each match becomes [TYPE]; types in order, whole texts."""
    for name in types:
        text = F.regexp_replace(text, PII[name], f"[{name}]")
    return text


def pii_counts(text: Column) -> list[Column]:
    return [F.regexp_count(text, F.lit(p)).cast("long").alias(f"n_{n.lower()}") for n, p in PII.items()]


#: Ligatures that optical recognition leaves.
LIGATURES = {"\ufb01": "fi", "\ufb02": "fl", "\ufb00": "ff", "\ufb03": "ffi", "\ufb04": "ffl", "\u0132": "IJ", "\u0133": "ij", "\u0152": "OE", "\u0153": "oe", "\u00c6": "AE", "\u00e6": "ae"}


def ocr_cleanup(text: Column) -> Column:
    """Ligatures spelled out, words split at a line end rejoined, runs of points, hyphens and blanks shortened."""
    for one, two in LIGATURES.items():
        text = F.replace(text, F.lit(one), F.lit(two))
    text = F.regexp_replace(text, r"([a-z])-\n([a-z])", "$1$2")
    text = F.regexp_replace(text, r"\.{4,}", "...")
    text = F.regexp_replace(text, r"-{3,}", "--")
    return F.regexp_replace(text, r"[ \t]{2,}", " ")


def syllables(word: Column, guard: bool = True) -> Column:
    """Vowel groups; words of up to three letters have one; a last e is silent (guard: only beside another group)."""
    w = F.lower(word)
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    silent = w.endswith("e") & (groups > 1) if guard else w.endswith("e")
    return F.when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), groups - silent.cast("int")))
