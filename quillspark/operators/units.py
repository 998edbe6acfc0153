"""Numbered sections of legal texts, and definitions of source files, as chunks with their lines; markers of chapters; broken lines.

All are folds over the lines of one text with a state (numbers met so far, open scopes), so each text is read
once where it lies: no shuffle, and rows leave in bounded batches however many a text gives.
"""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Forms of section headings, in the order in which they are tried.
HEADINGS = [
    ("article", r"^(ARTICLE|Article)\s+(\d+|[IVXLCDM]+)\.?\s*[-–—:]?\s*(.*?)$"),
    ("section", r"^(SECTION|Section|Sec\.?)\s+(\d+(?:\.\d+)*)\s*[-–—:]?\s*(.*?)$"),
    ("paragraph", r"^[§¶]\s*(\d+(?:\.\d+)*)\s*[-–—:]?\s*(.*?)$"),
    ("numbered", r"^(\d+(?:\.\d+)+)\s*[-–—:]?\s*(.*?)$"),
    ("numbered_single", r"^(\d+)\.\s+(.*?)$"),
    ("roman", r"^([IVXLCDM]+)\.\s*(.*?)$"),
    ("letter_lower", r"^\(([a-z])\)\s*(.*?)$"),
    ("roman_lower", r"^\(([ivx]+)\)\s*(.*?)$"),
    ("number_paren", r"^\((\d+)\)\s*(.*?)$"),
]
# Languages by file ending, and forms of definitions at the start of a line.
LANGUAGES = {".py": "python", ".pyw": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".kt": "kotlin", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".cs": "csharp", ".cpp": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp"}
FUNCTIONS = {
    "javascript": [
        r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\([^)]*\)",
        r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>",
        r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?function",
    ],
    "typescript": [
        r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*(?:<[^>]*>)?\s*\([^)]*\)",
        r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>",
    ],
    "java": [r"^\s*(?:public|private|protected)?\s*(?:static)?\s*\w+(?:<[^>]*>)?\s+(\w+)\s*\([^)]*\)"],
    "go": [r"^func\s+(?:\([^)]+\)\s+)?(\w+)\s*\([^)]*\)"],
    "rust": [r"^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"],
}
CLASSES = {
    "javascript": [r"^(?:export\s+)?class\s+(\w+)"],
    "typescript": [r"^(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", r"^(?:export\s+)?interface\s+(\w+)"],
    "java": [r"^(?:public\s+)?(?:abstract\s+)?class\s+(\w+)", r"^(?:public\s+)?interface\s+(\w+)"],
    "go": [r"^type\s+(\w+)\s+struct", r"^type\s+(\w+)\s+interface"],
    "rust": [r"^(?:pub\s+)?struct\s+(\w+)", r"^(?:pub\s+)?enum\s+(\w+)", r"^(?:pub\s+)?trait\s+(\w+)", r"^impl(?:<[^>]*>)?\s+(?:\w+\s+for\s+)?(\w+)"],
}
# Forms of chapter markers with their level (None: the number of #), in the order in which they are tried.
ROMAN = r"(?:I{1,3}|IV|V|VI{0,3}|IX|X{1,3}|XL|L|LX{0,3}|XC|C{1,3})"
ORDINAL = rf"(?:\d+|{ROMAN}|(?:One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten))\b[^\n]*"
MARKERS = [
    (1, rf"(?im)^(?:Chapter|CHAPTER|Ch\.?)\s+{ORDINAL}"),
    (1, rf"(?im)^(?:Part|PART)\s+{ORDINAL}"),
    (2, r"(?im)^(?:Section|SECTION|Sec\.?)\s+[\d.]+\b[^\n]*"),
    (2, r"(?m)^(\d+\.\d+(?:\.\d+)?)\s+[A-Z][^\n]{3,60}$"),
    (2, r"(?m)^(\d+)\.\s+[A-Z][^\n]{3,60}$"),
    (None, r"(?m)^(#{1,6})\s+(.+)$"),
]
# Line ends that close a sentence, and words that begin a continuing line.
CLOSING = (".", "!", "?", ":", ";", '"', "'", ")")
CONTINUING = ("and", "or", "but", "so", "yet", "nor", "for")

MARKER = "document_id string, position int, level int, title string"
SECTION = "document_id string, chunk_id string, chunk_index int, section_no int, part_no int, number string, title string, level int, hierarchy array<string>, line_start int, line_end int, content string"
UNIT = "document_id string, chunk_id string, chunk_index int, kind string, name string, parent string, section_title string, line_start int, line_end int, content string"
ROWS_A_BATCH, CHARS_A_BATCH = 2000, 8 << 20


def legal_sections(docs: DataFrame, most: int = 2000, preamble: bool = False, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    """Texts cut at numbered headings (articles, sections, paragraphs, clauses, letters in brackets).

    A section runs from its heading to the line before the next; lines count from 0. `hierarchy` holds the numbers of
    its parents, each the nearest one before. Sections of over `most` characters are cut at empty lines, and a paragraph
    of over `most` at sentence ends, into parts 0, 1, ...; a longer sentence stays whole. A text without headings is one
    section "1". Lines before the first heading are left out, or with preamble are a section with number "" and level 0.
    Null and blank texts give no row; a heading has at most 200 characters.
    """
    return _spread(docs.select(F.col(id_col).cast("string").alias("id"), F.lit("").alias("file"), F.col(content).alias("text")), SECTION, lambda key, _, text: _section_rows(key, text, most, preamble))


def code_units(files: DataFrame, most: int = 3000, rest: bool = False, id_col: str = "doc_id", file_col: str = "source_file", content: str = "content") -> DataFrame:
    """Source files cut into imports, classes, methods and functions; lines count from 1.

    Python is cut by its syntax tree: one unit of all imports, functions with their decorators, classes whole or, with
    over `most` characters, as a header (up to the first method) and methods. With `rest`, the lines that no unit holds
    are units of kind "module", so every line that isn't blank lies in exactly one unit. Other languages are cut at each
    line that begins a definition; lines before the first are a unit "header"; `parent` is the class whose braces are
    open there. Braces in strings and comments don't count, a closing brace too many is passed over, and scopes left
    open end with the text. Files of other languages, and Python that doesn't parse, are one unit "module". Null and blank texts
    give no row; a null file name has no known language.
    """
    return _spread(files.select(F.col(id_col).cast("string").alias("id"), F.col(file_col).alias("file"), F.col(content).alias("text")), UNIT, lambda key, file, text: _unit_rows(key, file, text, most, rest))


def chapter_markers(docs: DataFrame, least: int = 3, most: int = 100, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    """Headings of chapters, parts, sections, numbers, # signs, and lines in capitals: position (in code points from 0),
    level, title, of `least` to `most` characters. Of markers at one place the one with the lowest level stays, then the first
    form. Null and blank texts give no row.
    """
    return _spread(docs.select(F.col(id_col).cast("string").alias("id"), F.lit("").alias("file"), F.col(content).alias("text")), MARKER, lambda key, _, text: ((key, *m) for m in _markers(text, least, most)))


@F.pandas_udf(T.StringType())
def joined_lines(texts: pd.Series) -> pd.Series:
    """Texts with broken lines joined: a line that doesn't end a sentence takes the lines that go on in lower case or with
    a continuing word, five lines at most in one. Null stays null."""
    return texts.map(_joined, na_action="ignore")


def _spread(texts: DataFrame, schema: str, rows_of: Callable[[str, str, str], Iterable[tuple]]) -> DataFrame:
    """The rows of every text that isn't blank, in batches bounded by rows and characters."""

    def run(batches):
        names = [c.split()[0] for c in schema.split(", ")]
        held, chars = [], 0
        for batch in batches:
            for key, file, text in zip(batch["id"], batch["file"], batch["text"], strict=True):
                if not text or not text.strip():
                    continue
                for row in rows_of(key, file or "", text):
                    held.append(row)
                    chars += len(row[-1])
                    if len(held) >= ROWS_A_BATCH or chars >= CHARS_A_BATCH:
                        yield pd.DataFrame(held, columns=names)
                        held, chars = [], 0
        if held:
            yield pd.DataFrame(held, columns=names)

    return texts.mapInPandas(run, schema)


def _mark(content: str) -> str:
    return hashlib.md5(content.encode("utf-8", "surrogatepass")).hexdigest()[:8]


def heading(line: str) -> tuple[str, str, int, str | None] | None:
    """(number, title, level, parent) of a stripped line that is a heading."""
    if not line or len(line) > 200:
        return None
    for kind, pattern in HEADINGS:
        found = re.match(pattern, line)
        if found:
            break
    else:
        return None
    number, title = found.groups()[-2:]
    depth = number.count(".") + 1
    above = number.rpartition(".")[0] or None
    title = title.strip()
    if kind == "article":
        return f"Article {number}", title, 1, None
    if kind in ("section", "numbered"):
        return number, title, depth, above
    if kind == "paragraph":
        return f"§{number}", title, depth, None
    if kind in ("numbered_single", "roman"):
        return number, title, 1, None
    return f"({number})", title, 3, None


def _section_rows(key: str, text: str, most: int, preamble: bool) -> Iterator[tuple]:
    lines = text.split("\n")
    heads = [(i, h) for i, line in enumerate(lines) if (h := heading(line.strip()))]
    if not heads:
        heads = [(0, ("1", "", 1, None))]
    elif preamble and "".join(lines[: heads[0][0]]).strip():
        heads.insert(0, (0, ("", "", 0, None)))
    parents: dict[str, list[str]] = {}
    ends = [i for i, _ in heads[1:]] + [len(lines)]
    index = 0
    for no, ((first, (number, title, level, above)), end) in enumerate(zip(heads, ends, strict=True)):
        hierarchy = [*parents[above], above] if above in parents else []
        if level:
            parents[number] = hierarchy
        for part, content in enumerate(_within("\n".join(lines[first:end]).strip(), most)):
            yield key, f"{key}_legal_{no:04d}_{part:02d}_{_mark(content)}", index, no, part, number, title, level, hierarchy, first, end - 1, content
            index += 1


def _within(section: str, most: int) -> Iterator[str]:
    """A section in parts of at most `most` characters (blanks between pieces are not counted for paragraphs)."""
    if len(section) <= most:
        yield section
        return
    held: list[str] = []
    for paragraph in re.split(r"\n\s*\n", section):
        if len(paragraph) > most:
            if held:
                yield "\n\n".join(held)
                held = []
            yield from _packed(re.split(r"(?<=[.!?])\s+", paragraph), most)
            continue
        if held and sum(map(len, held)) + len(paragraph) > most:
            yield "\n\n".join(held)
            held = []
        held.append(paragraph)
    if held:
        yield "\n\n".join(held)


def _packed(sentences: list[str], most: int) -> Iterator[str]:
    held, size = [], 0
    for s in sentences:
        if held and size + len(s) + 1 > most:
            yield " ".join(held)
            held, size = [], 0
        if not held and len(s) > most:
            yield s
            continue
        held.append(s)
        size += len(s) + 1
    if held:
        yield " ".join(held)


def _unit_rows(key: str, file: str, text: str, most: int, rest: bool) -> Iterator[tuple]:
    base = re.split(r"[/\\]", file)[-1]
    ending = base[base.rfind(".") :].lower() if base.rfind(".") > 0 else ""
    language = LANGUAGES.get(ending, "unknown")
    found = _python_units(text, most, rest) if language == "python" else _scoped_units(text, language)
    if found is None:
        found = [("module", "module", None, 1, text.count("\n") + 1, text)]
    for i, (kind, name, parent, first, last, content) in enumerate(found):
        title = f"class {name}" if kind == "class" else f"{parent}.{name}()" if kind == "method" else f"{name}()" if kind == "function" else name
        yield key, f"{key}_code_{i:04d}_{_mark(content)}", i, kind, name, parent, title, first, last, content


def _python_units(text: str, most: int, rest: bool) -> list[tuple] | None:
    """Units of a Python file by its syntax tree; None where it doesn't parse."""
    lines = re.split(r"\r\n?|\n", text)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse("\n".join(lines))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    defs = (ast.FunctionDef, ast.AsyncFunctionDef)
    begin = lambda node: min([node.lineno, *(d.lineno for d in node.decorator_list)])
    cut = lambda first, last: "\n".join(lines[first - 1 : last])
    imports = [n for n in tree.body if isinstance(n, ast.Import | ast.ImportFrom)]
    units, own = [], set()
    if imports:
        taken = sorted({i for n in imports for i in range(n.lineno, n.end_lineno + 1)})
        own.update(taken)
        units.append(("imports", "imports", None, 1, taken[-1], "\n".join(lines[i - 1] for i in taken)))

    def add(kind, name, parent, first, last):
        own.update(range(first, last + 1))
        units.append((kind, name, parent, first, last, cut(first, last)))

    for node in tree.body:
        if isinstance(node, defs):
            add("function", node.name, None, begin(node), node.end_lineno)
        elif isinstance(node, ast.ClassDef):
            first, methods = begin(node), [c for c in node.body if isinstance(c, defs)]
            if len(cut(first, node.end_lineno)) <= most or not methods:
                add("class", node.name, None, first, node.end_lineno)
                continue
            if cut(first, begin(methods[0]) - 1).strip():
                add("class_header", f"{node.name} (header)", None, first, begin(methods[0]) - 1)
            for c in methods:
                add("method", c.name, node.name, begin(c), c.end_lineno)
    if rest:
        start = 1
        for i in range(1, len(lines) + 2):
            if i in own or i > len(lines):
                if cut(start, i - 1).strip():
                    units.append(("module", "module", None, start, i - 1, cut(start, i - 1)))
                start = i + 1
    return units


def _scoped_units(text: str, language: str) -> list[tuple] | None:
    """Units from one definition to the next; None where the language has no forms or the text no definition."""
    forms = [("class", re.compile(p)) for p in CLASSES.get(language, [])] + [("function", re.compile(p)) for p in FUNCTIONS.get(language, [])]
    lines, bare = text.split("\n"), _without_quotes(text, language).split("\n")
    starts: list[tuple[int, str, str, str | None]] = []
    depth, scopes = 0, []  # of a scope: kind, name, depth where it began, whether its brace came
    for i, line in enumerate(lines):
        hit = next(((kind, m[1]) for kind, form in forms if (m := form.match(line.strip()))), None)
        if hit:
            while scopes and not scopes[-1][3] and scopes[-1][2] >= depth:
                scopes.pop()
            starts.append((i, *hit, next((s[1] for s in reversed(scopes) if s[0] == "class"), None)))
            scopes.append([*hit, depth, False])
        for brace in re.findall(r"[{}]", bare[i]):
            if brace == "{":
                if scopes and not scopes[-1][3]:
                    scopes[-1][3] = True
                depth += 1
            else:
                depth = max(0, depth - 1)
                while scopes and scopes[-1][3] and scopes[-1][2] >= depth:
                    scopes.pop()
    if not starts:
        return None
    ends = [s[0] for s in starts[1:]] + [len(lines)]
    units = [(kind, name, parent, i + 1, end, "\n".join(lines[i:end]).rstrip()) for (i, kind, name, parent), end in zip(starts, ends, strict=True)]
    head = "\n".join(lines[: starts[0][0]]).rstrip()
    return [("imports", "header", None, 1, starts[0][0], head), *units] if head.strip() else units


def _without_quotes(text: str, language: str) -> str:
    """The text with strings and comments blanked, its lines kept; a quote that isn't closed stays."""
    single = r"'(?:\\.|[^'\\\n])*'" if language in ("javascript", "typescript") else r"'(?:\\.|[^'\\\n])'"
    return re.sub(rf'"(?:\\.|[^"\\\n])*"|{single}|`[^`]*`|//[^\n]*|/\*.*?\*/', lambda m: "\n" * m[0].count("\n"), text, flags=re.S)


def _markers(text: str, least: int, most: int) -> Iterator[tuple[int, int, str]]:
    best: dict[int, tuple[int, str]] = {}

    def offer(position: int, level: int, title: str) -> None:
        if least <= len(title) <= most and (position not in best or level < best[position][0]):
            best[position] = (level, title)

    for level, pattern in MARKERS:
        for m in re.finditer(pattern, text):
            offer(m.start(), level or len(m[1]), (m[0] if level else m[2]).strip())
    position = 0
    for line in text.split("\n"):
        title = line.strip()
        if least <= len(title) <= most and _in_capitals(title):
            offer(position + len(line) - len(line.lstrip()), 2, title)
        position += len(line) + 1
    for position in sorted(best):
        yield position, *best[position]


def _in_capitals(line: str) -> bool:
    """Nine of ten letters are capitals; no list item, no single word of up to five characters."""
    letters = [c for c in line if c.isalpha()]
    if not letters or sum(c.isupper() for c in letters) / len(letters) < 0.9:
        return False
    words = line.split()
    return not (len(words) == 1 and len(words[0]) <= 5) and not line.endswith(".?!") and not line.startswith(("-", "*", "•", "·"))


def _joined(text: str, short: int = 50, most_lines: int = 5) -> str:
    lines = text.split("\n")
    bare = [line.strip() for line in lines]
    goes_on = lambda line: line[:1].islower() or line.split()[:1] and line.split()[0].lower() in CONTINUING
    out, i = [], 0
    while i < len(lines):
        after = bare[i + 1] if i + 1 < len(lines) else ""
        if not bare[i] or not after or bare[i].endswith(CLOSING) or not (after[0].islower() or after[0].isupper() and len(bare[i]) < short):
            out.append(lines[i])
            i += 1
            continue
        end = i + 1
        while end < len(lines) and end - i < most_lines and goes_on(bare[end]):
            end += 1
        out.append(" ".join(bare[i:end]))
        i = end
    return "\n".join(out)
