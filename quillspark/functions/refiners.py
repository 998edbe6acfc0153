"""Domain metadata from text: tables of patterns, each applied as one expression.

Kinds: first, upper (first, upper case), spaced (first, upper case, single blanks), capital (first, first
letter upper case, the rest lower case), pair and words (the first match's two groups, with a comma or a blank between), every
(distinct, upper case, sorted), names (distinct, as written, sorted), number (first, as double), dollars
(first or largest amount). Letters, blanks and word ends are Unicode's. In the patterns, end of text is
\\z, as Java's \\Z would also stand before a last line end; all else is spelled as it is. Wellness macros, spiritual themes and status words have functions of their own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns by domain and column.
PATTERNS = {
    "auto": {
        "auto_vin": ("upper", r"\b([A-HJ-NPR-Z0-9]{17})\b"),
        "auto_part_numbers": ("every", r"(?i)\b(?:Part|P/N|Ref)(?:\s+(?:Ref|ID|Number))?[:\s\-#]+([A-Z0-9]+(?:\-[A-Z0-9]+)*)\b"),
    },
    "bio": {
        "bio_exp_id": ("upper", r"(?i)\b(?:EXP|Project|Lab|Experiment)(?:\s+(?:ID|Ref))?[:\s\-#]+([A-Z0-9]{2,15}(?:\-[A-Z0-9]+)*)\b"),
        "bio_formulas": ("names", r"\b([A-Z][a-z]?\d*(?:[A-Z][a-z]?\d*)+)\b"),
        "bio_protocol": ("first", r"(?i)\b(?:Protocol|Method|SOP)[:\s]+([\w\s]{3,40})(?=\n|\.|\z)"),
    },
    "cyber": {
        "cyber_cve_id": ("upper", r"(?i)\b(CVE-\d{4}-\d{4,7})\b"),
        "cyber_all_cves": ("every", r"(?i)\b(CVE-\d{4}-\d{4,7})\b"),
        "cyber_cvss_score": ("number", r"(?i)(?:CVSS|Score)[:\s]*(\d\.\d)\b"),
        "cyber_affected_sw": ("list", r"(?i)(?:Affected|Vulnerable|Software|Version):\s+([^:\n]+?)(?=\n|\z)"),
    },
    "disaster": {
        "disaster_incident_type": ("capital", r"(?i)\b(?:Incident|Type|Nature)[:\s]+([\w\s]{3,25})(?=\n|\.)"),
        "disaster_coordinates": ("pair", r"(\-?\d{1,3}\.\d{4,8}),\s*(\-?\d{1,3}\.\d{4,8})"),
        "disaster_urgency": ("capital", r"(?i)\b(?:Urgency|Priority|Severity)[:\s]*(Immediate|High|Medium|Low|Critical)\b"),
    },
    "edu": {
        "edu_grade_level": ("capital", r"(?i)\b(?:Grade|Level)[:\s]+(\d{1,2}|[Kk]|Kindergarten|Primary|Secondary|Higher Ed)\b"),
        "edu_subject": ("first", r"(?i)\b(?:Subject|Topic|Course)[:\s]+([\w\s\-]{3,40})(?=\n|\.|\z)"),
        "edu_standards": ("every", r"(?i)\b((?:CCSS|NGSS|ISTE|TEKS)[A-Z0-9\.\-]+)\b"),
    },
    "gaming": {
        "gaming_patch_version": ("first", r"(?i)\b(?:Patch|v|Version)[:\s]*(\d+\.\d+(?:\.\d+)*[a-z]?)\b"),
        "gaming_characters": ("names", r"\b(?:Hero|Champion|Character|Agent)[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*?)(?=[.,\n]|\z)"),
    },
    "grant": {
        "grant_id": ("first", r"(?i)(?:FON|Opportunity|Solicitation|ID|Number)[:\s\-#]+([A-Z0-9\-]{7,25})\b"),
        "grant_amount": ("dollars_first", r"\$\s*(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)"),
        "grant_deadline": ("first", r"(?i)\b(?:Deadline|Due|Submission)[:\s]+([\w\s\d,]{5,30})(?=\n|\z)"),
    },
    "mfg": {
        "mfg_part_number": ("upper", r"(?i)(?:Part|P/N|Ref|Number)[:\s\-#]+([A-Z0-9\-]{7,25})\b"),
        "mfg_maintenance_cycle": ("first", r"(?i)\b(?:Maintenance|Service|Cycle)[:\s]+(every\s+\d+\s+(?:hours|days|months|cycles))\b"),
        "mfg_error_codes": ("every", r"(?i)\b(?:Error|Fault|Code)[:\s\-#]*([A-Z0-9]{2,5}-\d{2,5})\b"),
    },
    "museum": {
        "museum_accession_id": ("first", r"(?i)\b(?:Accession|ID|Ref)(?:\s+Number)?[:\s\-#]*(\d{4}\.\d{1,5}\.\d{1,5})\b"),
        "museum_artist": ("first", r"\b(?:Artist|Creator|Maker|Contributor)[:\s]+([A-Z][a-z]+(?:\s+[a-z]+)?(?:\s+[A-Z][a-z]+)*?)(?=[.,\n]|\z)"),
        "museum_era": ("capital", r"(?i)\b(?:Era|Period|Date)[:\s]+([\w\s\-]{3,20})(?=\n|\.|\z)"),
        "museum_medium": ("first", r"(?i)\b(?:Medium|Material)[:\s]+([\w\s,]{3,30})(?=\n|\.|\z)"),
    },
    "political": {
        "political_candidate": ("first", r"(?i)\b(?:Candidate|Senator|Rep|Representative|Mayor)[:\s]+([\w\s\.]{3,25}?)(?=[.,\n]|\z)"),
        "political_vote": ("capital", r"(?i)\b(?:Vote|Result|Action)[:\s]*(Yea|Nay|Aye|No|Present|Abstain)\b"),
        "political_donors": ("names", r"(?i)\b(?:Donor|Contributor|PAC|Entity)[:\s]+([\w\s\&]{3,40})(?=\n|\.|\,)"),
        "political_contribution": ("dollars_most", r"\$\s*(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)"),
    },
    "spiritual": {
        "spiritual_book": ("first", r"\b((?:\d\s+)?(?:[A-Z][a-z]+))\s+\d+[:\.]\d+(?:\-\d+)?\b"),
        "spiritual_citation": ("words", r"\b((?:\d\s+)?(?:[A-Z][a-z]+))\s+(\d+[:\.]\d+(?:\-\d+)?)\b"),
    },
    "urban": {
        "urban_zoning_code": ("upper", r"\b([RCM][\-\s]?\d[A-Z]?)\b"),
        "urban_far_ratio": ("number", r"(?i)\b(?:FAR|Floor Area Ratio)(?:\s+of)?[:\s]*(\d+(?:\.\d+)?)\b"),
        "urban_density_target": ("first", r"(?i)\b(?:Density|Target)(?:\s+is)?[:\s]+([\w\s\/]{3,20})(?=[.,\n]|\z)"),
    },
    "wellness": {"wellness_calories": ("number", r"(?i)\b(\d{1,4})\s*(?:kcal|calories|cal)\b")},
    "ai": {
        "ai_model_name": ("first", r"\b(?:Model|LLM|System)[:\s]+([A-Z][\w\-\.]{2,25}?(?:\s\d+)?)(?=[.,\s]|\z)"),
        "ai_param_count": ("spaced", r"(?i)(\d+(?:\.\d+)?\s*(?:Trillion|Billion|Million|[BMT]))"),
    },
}
#: Status words, the first in this order holds.
STATUS = ["Original", "Replaced", "Restored", "Pending", "Damaged", "Missing"]
#: Themes by their words.
THEMES = {"Grace": ["grace", "mercy", "favor"], "Judgment": ["judge", "judgment", "accountability"], "Compassion": ["compassion", "kindness", "love"], "Wisdom": ["wisdom", "knowledge", "understanding"], "Covenant": ["covenant", "promise", "oath"]}


def _all(content: Column, pattern: str) -> Column:
    return F.regexp_extract_all(content, F.lit("(?U)" + pattern), F.lit(1))


#: All decimal digits but 0-9, in tens: \d is Unicode's here, as in the patterns' source.
_DIGITS = "".join(chr(c) for c in range(128, 0x20000) if chr(c).isdecimal())


def plain_digits(text: Column) -> Column:
    return F.translate(text, _DIGITS, "0123456789" * (len(_DIGITS) // 10))


def _amount(text: Column) -> Column:
    return plain_digits(F.replace(text, F.lit(","), F.lit(""))).try_cast("double")


def rule(content: Column, kind: str, pattern: str) -> Column:
    """One pattern as a column; null (or an empty array) where nothing matches."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    first = strip(F.try_element_at(_all(content, pattern), F.lit(1)))
    two = lambda sep: F.when(first.isNotNull(), F.concat_ws(sep, F.regexp_extract(content, "(?U)" + pattern, 1), F.regexp_extract(content, "(?U)" + pattern, 2)))
    trimmed = F.filter(F.transform(_all(content, pattern), strip), lambda x: x != "")
    return {
        "first": lambda: first,
        "upper": lambda: F.upper(first),
        "spaced": lambda: F.upper(F.regexp_replace(first, r"\s+", " ")),
        "capital": lambda: F.concat(F.upper(F.substring(first, 1, 1)), F.lower(F.substr(first, F.lit(2)))),
        "pair": lambda: two(", "),
        "words": lambda: two(" "),
        "every": lambda: F.array_sort(F.array_distinct(F.transform(trimmed, lambda x: F.upper(x)))),
        "names": lambda: F.array_sort(F.array_distinct(trimmed)),
        "list": lambda: F.filter(F.transform(F.split(first, ","), strip), lambda x: x != ""),
        "number": lambda: plain_digits(first).try_cast("double"),
        "dollars_first": lambda: _amount(first),
        "dollars_most": lambda: F.array_max(F.transform(_all(content, pattern), lambda x: _amount(x))),
    }[kind]()


def domain(content: Column, name: str) -> list[Column]:
    return [rule(content, kind, pattern).alias(column) for column, (kind, pattern) in PATTERNS[name].items()]


def status_word(content: Column) -> Column:
    return F.coalesce(*[F.when(content.rlike(rf"(?i)\b{w}\b"), F.lit(w)) for w in STATUS])


def themes(content: Column) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(content.rlike(r"(?i)\b(" + "|".join(ws) + r")\b"), F.lit(name)) for name, ws in THEMES.items()])))


#: Macros in either order, and allergens.
MACRO = r"\b(\d{1,3}(?:\.\d)?)\s*g\s*(Protein|Fat|Carbs|Carbohydrates)\b|\b(Protein|Fat|Carbs|Carbohydrates)[:\s]*(\d{1,3}(?:\.\d)?)\s*g\b"
ALLERGENS = ["Gluten", "Dairy", "Nuts", "Peanuts", "Soy", "Shellfish", "Eggs"]


def macros(content: Column) -> Column:
    """Grams by macro name, written in either order; the last match of a name holds; carbohydrates count as carbs."""
    found = F.regexp_extract_all(content, F.lit("(?iU)" + MACRO), F.lit(0))
    name = lambda x: F.initcap(F.regexp_replace(F.lower(F.regexp_extract(x, r"(?i)(carbohydrates|protein|fat|carbs)", 1)), "carbohydrates", "carbs"))
    grams = lambda x: plain_digits(F.regexp_extract(x, r"(?U)(\d{1,3}(?:\.\d)?)", 1)).cast("double")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return F.aggregate(found, empty, lambda m, x: F.map_from_entries(F.array_append(F.filter(F.map_entries(m), lambda e: e["key"] != name(x)), F.struct(name(x).alias("key"), grams(x).alias("value")))))


def allergens(content: Column) -> Column:
    """Allergens that a text names as words, in the order of the table."""
    return F.array_compact(F.array(*[F.when(content.rlike(rf"(?iU)\b{a}\b"), F.lit(a)) for a in ALLERGENS]))


#: Skills by what stands for them.
SKILLS = {
    "JS": "Javascript",
    "TS": "Typescript",
    "ML": "Machine Learning",
    "K8s": "Kubernetes",
    "AWS": "Amazon Web Services",
    "GCP": "Google Cloud Platform",
    "Azure": "Microsoft Azure",
    "React.js": "React",
    "Node": "Node.js",
}
#: Signs of game entities by type, in the order of their standing, and statistics of stat blocks.
GAME_TYPES = {
    "NPC": r"(?iU)\b(?:NPC|character|person)\b|\b(?:he|she|they)\s+(?:is|was)\s+a\s+(?:level|lvl)\s+\d+",
    "Location": r"(?iU)\b(?:Location|Place|City|Town|Village|Dungeon|Room|Area)\b",
    "Item": r"Magic Item|Rarity:",
}
GAME_STATS = {
    "hp": r"(?iU)\b(?:Hit\s+Points|HP)[:\s]+(\d+)\b",
    "ac": r"(?iU)\b(?:Armor\s+Class|AC)[:\s]+(\d+)\b",
    "cr": r"(?iU)\b(?:Challenge\s+Rating|CR)[:\s]+(\d+(?:/\d+)?)\b",
}


def skills(found: Column) -> Column:
    """Skills under their full names, distinct and in order."""
    full = F.create_map(*[F.lit(x) for pair in SKILLS.items() for x in pair])
    return F.array_sort(F.array_distinct(F.transform(found, lambda s: F.coalesce(F.element_at(full, s), s))))


def front_matter_list(listed: Column, single: Column, separator: str) -> Column:
    """Entries of a list, else of a text cut at the separators (a pattern), without outer blanks; empty where both are missing."""
    entry = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    cut = F.filter(F.transform(F.split(single, separator), entry), lambda x: x != "")
    return F.coalesce(listed, cut, F.array().cast("array<string>"))


def note_tags(listed: Column, single: Column) -> Column:
    """Tags of a note's front matter without leading #."""
    return F.transform(front_matter_list(listed, single, r"[,\s]+"), lambda t: F.regexp_replace(t, "^#+", ""))


def game_type(content: Column) -> Column:
    return F.coalesce(*[F.when(content.rlike(p), F.lit(name)) for name, p in GAME_TYPES.items()])


def game_stats(content: Column) -> list[Column]:
    """Hit points and armour class as numbers, the challenge rating as text; null where missing."""
    first = {n: F.nullif(F.regexp_extract(content, p, 1), F.lit("")) for n, p in GAME_STATS.items()}
    return [first["hp"].try_cast("long").alias("hp"), first["ac"].try_cast("long").alias("ac"), first["cr"].alias("cr")]
