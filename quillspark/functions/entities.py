"""Names of organisations and persons brought to one form; checks of identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text

#: Abbreviations and their full names.
ABBREVIATIONS = {
    "MIT": "Massachusetts Institute of Technology",
    "IBM": "International Business Machines",
    "NASA": "National Aeronautics and Space Administration",
    "FBI": "Federal Bureau of Investigation",
    "CIA": "Central Intelligence Agency",
    "UN": "United Nations",
    "EU": "European Union",
    "USA": "United States of America",
    "UK": "United Kingdom",
}
#: Short and full forms of organisations, applied in this order.
ORGANISATIONS = {"Corp": "Corporation", "Inc": "Incorporated", "Ltd": "Limited", "Co": "Company", "LLC": "Limited Liability Company"}
#: Titles of persons, removed in this order.
TITLES = ["Dr", "Mr", "Mrs", "Ms", "Prof", "Professor"]
#: Endings that linking leaves out, one after another.
ENDINGS = [" inc", " inc.", " incorporated", " corp", " corp.", " corporation", " llc", " ltd", " limited", " co", " co.", " company"]
#: Forms of identifiers.
CVE = r"^CVE-[0-9]{4}-[0-9]{4,7}$"
CITATION = r"[0-9]+\s+[A-Z]\.\s*[A-Z]\.?\s*[0-9]+"


def _organisation(name: Column) -> Column:
    full = reduce(lambda x, s: F.regexp_replace(x, rf"(?iU)\b{s[0]}\.?\b", s[1]), ORGANISATIONS.items(), name)
    return text.strip(F.regexp_replace(full, r"[.,;:]+\z", ""))


def _without_form(canonical: Column) -> Column:
    """The lower-cased name without the first full form, in their order, that it ends with."""
    low = F.lower(canonical)
    cut = low
    for form in reversed([f.lower() for f in ORGANISATIONS.values()]):
        cut = F.when(low.endswith(form), text.strip(F.substr(low, F.lit(1), F.length(low) - len(form)))).otherwise(cut)
    return cut


def normalized(name: Column, kind: Column) -> Column:
    """Struct of key (for lookups) and canonical (the full name) of a name of the given kind; null for a null name.

    Abbreviations stand for their full names and keep themselves as keys; organisations (kind org or organization)
    get their full form, which the key leaves out; persons lose their titles; other kinds only their outer blanks.
    """

    def made(plain: Column) -> Column:
        known = F.element_at(F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair]), F.upper(plain))
        kinds, person = F.lower(kind), text.strip(reduce(lambda x, t: F.regexp_replace(x, rf"(?iU)\b{t}\.?\s+", ""), TITLES, plain))
        pair = lambda key, canonical: F.struct(key.alias("key"), canonical.alias("canonical"))
        found = F.when(known.isNotNull(), pair(F.lower(plain), known))
        found = found.when(kinds.isin("org", "organization"), text.let(_organisation(plain), lambda c: pair(_without_form(c), c)))
        found = found.when(kinds == "person", pair(F.lower(person), person))
        return found.otherwise(pair(F.lower(plain), plain))

    return F.when(name.isNotNull(), text.let(text.strip(name), made))


def link_key(name: Column) -> Column:
    """Lower-cased name without the endings of organisations; empty for a null name."""
    low = text.strip(F.lower(F.coalesce(name, F.lit(""))))
    return text.strip(reduce(lambda x, e: F.regexp_replace(x, e.replace(".", r"\.") + r"\z", ""), ENDINGS, low))


def cve_valid(name: Column) -> Column:
    return F.coalesce(name.rlike(CVE), F.lit(False))


def cvss_error(score: Column) -> Column:
    """Null for a score of 0 to 10, else what is wrong with it."""
    return F.when(~F.coalesce(score.between(0.0, 10.0), F.lit(False)), F.concat(F.lit("CVSS score "), F.coalesce(score.cast("string"), F.lit("none")), F.lit(" out of bounds (0.0-10.0)")))


def legal_citations(content: Column) -> Column:
    """Reporter citations such as `410 U.S. 113`, in order; null for a null text."""
    return F.regexp_extract_all(content, F.lit(f"({CITATION})"), F.lit(1))
