"""A small query language and rule-based classification of queries and chunks.

Language: words, "phrases", field:value filters, NOT word or -word, OR between words. It is parsed on the
driver into one predicate Column, which Catalyst pushes to the scan where it can.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of query intents, in the order in which ties are settled.
INTENTS = {
    "factual": [r"^what (?:is|are|was|were)", r"^when (?:is|was|did|does)", r"^where (?:is|are|was|were|do|does)", r"^who (?:is|are|was|were)", r"^which ", r"\?$"],
    "procedural": [r"^how (?:do|does|can|to|would)", r"^how (?:is|are) .+ (?:done|performed|executed)", r"steps to", r"process for", r"procedure", r"guide to"],
    "conceptual": [r"^what (?:is|are) (?:a |an |the )?(?:definition|meaning)", r"^define ", r"^explain ", r"^describe ", r"concept of", r"understanding"],
    "comparative": [r"difference between", r"compare ", r"vs\.?", r"versus", r"better than", r"worse than", r"similar to"],
    "exploratory": [r"^tell me about", r"^what do you know about", r"^information about", r"overview of", r"summary of"],
    "literary": ["character", "theme", "motif", "symbol(?:ism)?", "narrative", "protagonist", "antagonist", "literary", "metaphor", "allegory", "foreshadow", "irony"],
}
#: What marks a domain, wherever it stands in the text.
DOMAINS = {
    "legal": ["statute", "jurisdiction", "judge", "docket", "court", "legal", "opinion", "ruling", "citation", "bluebook", "case law", "precedent", "plaintiff", "defendant", "lawsuit", "litigation"],
    "tech": ["code", "function", "method", "class", "api", "implementation", "tree-sitter", "language", "import", "export", "dependency", "software", "develop", "debug", "refactor", "algorithm"],
    "pkm": ["vault", "obsidian", "wikilink", "backlink", "frontmatter", "alias", "tag", "daily note", "logseq", "roam", "knowledge base"],
    "genealogy": ["family", "tree", "ancestor", "descendant", "parent", "child", "birth", "death", "marriage", "gedcom", "genealogy", "lineage", "grandfather", "grandmother", "relative"],
    "rpg": ["npc", "character sheet", "stat block", "armor class", "hit points", "dungeon", "campaign", "adventure", "d&d", "tabletop", "dm", "game master", "monster", "item", "rarity"],
    "cyber": ["log", "cve", "vulnerability", "attack", "tactic", "technique", "mitre", "security", "threat", "ip address", "source ip", "firewall", "cloudtrail", "syslog", "incident", "breach"],
}


@dataclass
class Parsed:
    words: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    filters: list[tuple[str, str]] = field(default_factory=list)
    any_of: bool = False


def parse(query: str) -> Parsed:
    out, negate = Parsed(), False
    for phrase, name, value, quoted, word in re.findall(r'"([^"]+)"|(\w+):(?:"([^"]+)"|(\S+))|(\S+)', query):
        value = value or quoted
        if name:
            out.filters.append((name.lower(), value))
        elif phrase:
            (out.excluded if negate else out.phrases).append(phrase.lower())
        elif word == "NOT":
            negate = True
            continue
        elif word == "OR":
            out.any_of = True
        elif word != "AND":
            bare = word.lstrip("-").lower()
            if bare:
                (out.excluded if negate or word.startswith("-") else out.words).append(bare)
        negate = False
    return out


def predicate(parsed: Parsed, content: Column, fields: dict[str, Column]) -> Column:
    """True where filters hold (without regard to case; arrays by membership), no excluded term and the words and phrases occur."""
    low, tests = F.lower(content), []
    for name, value in parsed.filters:
        if name in fields:
            tests.append(F.lower(fields[name].cast("string")) == value.lower())
    tests += [~F.contains(low, F.lit(t)) for t in parsed.excluded]
    tests += [F.contains(low, F.lit(t)) for t in parsed.phrases]
    found = [F.contains(low, F.lit(t)) for t in parsed.words]
    if found:
        tests.append(reduce((lambda a, b: a | b) if parsed.any_of else (lambda a, b: a & b), found))
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def intent(query: Column) -> Column:
    """The intent with most patterns found; the first of equals; without any, factual for questions, else exploratory."""
    q = F.lower(F.trim(query))
    scores = F.array(*[reduce(lambda a, b: a + b, [q.rlike(p).cast("int") for p in patterns]) for patterns in INTENTS.values()])
    names = F.array(*[F.lit(n) for n in INTENTS])
    best = F.array_max(scores)
    return F.when(best > 0, F.element_at(names, F.array_position(scores, best).cast("int"))).when(q.endswith("?"), "factual").otherwise("exploratory")


def domains(text: Column) -> Column:
    """All domains of which a mark occurs, also within a word, in order; without regard to case."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in marks]), F.lit(name)) for name, marks in DOMAINS.items()]))


def domain_scores(text: Column) -> Column:
    """Map of domain to the number of its marks' occurrences; overlapping marks count each."""
    low = F.lower(text)
    many = lambda m: (F.length(low) - F.length(F.replace(low, F.lit(m), F.lit("")))) / len(m)
    return F.map_from_arrays(F.array(*[F.lit(n) for n in DOMAINS]), F.array(*[reduce(lambda a, b: a + b, [many(m) for m in marks]).cast("int") for marks in DOMAINS.values()]))


def citations_valid(answer: Column, known: Column) -> list[Column]:
    """Bracketed ids of an answer against the known ids: cited, invalid, coverage (ids per sentence over ten characters, at most 1), valid."""
    cited = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[([A-Za-z0-9_-]+)\]"), F.lit(1)))
    invalid = F.array_except(cited, known)
    good = F.size(cited) - F.size(invalid)
    many = F.size(F.filter(F.split(answer, r"[.!?]+"), lambda s: F.length(F.trim(s)) > 10))
    coverage = F.when(many > 0, F.round(F.least(F.lit(1.0), F.size(cited) / many), 2)).otherwise(0.0)
    return [F.size(cited).alias("cited"), F.size(invalid).alias("invalid"), coverage.alias("coverage"), ((F.size(invalid) == 0) & (good > 0) & (coverage >= 0.5)).alias("valid")]


#: Terms and what stands in for them, the first that occurs holds.
SYNONYMS = {
    "requirements": "prerequisites",
    "process": "procedure",
    "how to": "how do I",
    "maximum": "max",
    "minimum": "min",
    "obtain": "get",
    "submit": "send",
    "document": "documentation",
    "eligible": "qualify",
    "deadline": "due date",
}
#: Acronyms, the first that occurs holds.
ACRONYMS = {
    "FAQ": "frequently asked questions",
    "ETA": "estimated time of arrival",
    "ASAP": "as soon as possible",
    "TBD": "to be determined",
    "N/A": "not applicable",
    "FYI": "for your information",
}
#: Openings of a query by its type and the wordings that replace them.
WORDINGS = {
    "procedural": {"how to ": ["steps to {}", "process for {}"], "how do i ": ["how to {}", "steps to {}"]},
    "factual": {"what is ": ["define {}", "{} definition"], "what are ": ["list of {}"]},
    "conceptual": {"explain ": ["what is {}", "{} overview"]},
}


def expand(query: str, kind: str | None = None, most: int = 3) -> list[str]:
    """Other wordings of a query, each once, at most `most`: a synonym, an acronym in full, then those of its type."""
    low = query.lower()
    synonym = next((low.replace(t, s) for t, s in SYNONYMS.items() if t in low), low)
    acronym = next((re.sub(p, full, query, flags=re.IGNORECASE) for a, full in ACRONYMS.items() if re.search(p := rf"\b{re.escape(a)}\b", query, re.IGNORECASE)), query)
    base, mark = low.strip().rstrip("?"), "?" if query.endswith("?") else ""
    opening = next((o for o in WORDINGS.get(kind, {}) if base.startswith(o)), None)
    worded = [w.format(base[len(opening) :]) + mark for w in WORDINGS[kind][opening]] if opening else []
    found = [synonym] * (synonym != query) + [acronym] * (acronym != query) + worded
    return [q for q in dict.fromkeys(found) if q != low][:most]
