"""Pages of optical character recognition (hOCR) as a table of elements with their boxes."""

from __future__ import annotations

import functools
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds by what a class holds, the first that fits; forms of boxes and confidences.
KINDS = (("ocr_page", "page"), ("ocr_carea", "block"), ("ocr_block", "block"), ("ocr_par", "paragraph"), ("ocr_line", "line"), ("ocr_textfloat", "line"), ("ocrx_word", "word"))
BOX = re.compile(r"bbox\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)")
CONFIDENCE = re.compile(r"x_wconf\s+(\d+)")
#: Texts, and tags that every parser reads alike: by far most of what recognition writes.
_PLAIN = re.compile(r"""([^<&]+)|<(/?)(div|span|p|strong|em)((?:\s[a-z]+=(?:'[^'<>&]*'|"[^"<>&]*"))*)>""")
_ATTRIBUTE = re.compile(r"""\s([a-z]+)=(?:'([^']*)'|"([^"]*)")""")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ELEMENTS_AT_ONCE = 20_000
COLUMNS = "page int, width int, height int, no int, parent int, depth int, kind string, element_id string, x1 int, y1 int, x2 int, y2 int, text string, confidence double"


@functools.lru_cache(1000)
def _kind_of(name: str) -> str | None:
    return next((kind for part, kind in KINDS if part in name), None)


class _Elements(HTMLParser):
    """A stack of open tags; an element counts if it has a kind and a box and so have all tags between it and its page."""

    def __init__(self):
        super().__init__()
        self.open: list[tuple[str, dict | None]] = []
        self.rows: list[dict] = []
        self.pages = 0

    def handle_starttag(self, tag, attrs):
        known = {k: v or "" for k, v in attrs}
        kind = _kind_of(known.get("class", ""))
        title = known.get("title", "")
        box = BOX.search(title)
        made = None
        if kind == "page":
            self.pages += 1
            if box:
                x1, y1, x2, y2 = map(int, box.groups())
                made = {"page": self.pages, "width": x2, "height": y2, "no": None, "depth": -1}
        elif kind and box and self.open and self.open[-1][1]:
            above = self.open[-1][1]
            x1, y1, x2, y2 = map(int, box.groups())
            sure = CONFIDENCE.search(title)
            made = {"page": above["page"], "width": above["width"], "height": above["height"], "no": len(self.rows), "parent": above["no"], "depth": above["depth"] + 1, "kind": kind, "element_id": known.get("id", "")}
            made |= {"x1": x1, "y1": y1, "x2": x2, "y2": y2, "text": [], "confidence": int(sure[1]) / 100 if sure else 0.0}
            self.rows.append(made)
        if tag not in _VOID:
            self.open.append((tag, made))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        if self.open and self.open[-1][1] and "text" in self.open[-1][1] and data.strip():
            self.open[-1][1]["text"].append(data.strip())


def _read_plain(parser: _Elements, content: str) -> bool:
    """Gives the parser the tags and texts of a file of plain tags only: without references, comments, declarations, single
    attributes or tags whose content is no markup. False, with nothing of use in the parser, for any other file."""
    at = 0
    for part in _PLAIN.finditer(content):
        if part.start() != at:
            return False
        at = part.end()
        text, closing, tag, attributes = part.groups()
        if text is not None:
            parser.handle_data(text)
        elif closing:
            if attributes:
                return False
            parser.handle_endtag(tag)
        else:
            parser.handle_starttag(tag, [(k, a or b) for k, a, b in _ATTRIBUTE.findall(attributes)])
    return at == len(content)


def parse_hocr(content: str | None) -> list[dict]:
    """The elements of all pages in document order: `no` counts through the document, parent is an element's `no` (null on
    the page itself), depth 0 is directly on the page, text what stands in the element but in none below it. Pages,
    elements without a box, and what lies in tags that are no element are left out."""
    parser = _Elements()
    if not _read_plain(parser, content or ""):
        parser = _Elements()
        parser.feed(content or "")
        parser.close()
    return [{**r, "text": " ".join(r["text"])} for r in parser.rows]


def hocr_elements(files: DataFrame, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    """One row per element: id and the columns of COLUMNS. Null and empty files have none."""

    fields = {n: pa.string() if t == "string" else pa.float64() if t == "double" else pa.int32() for n, t in (c.split() for c in COLUMNS.split(", "))}

    def made(keys, rows):
        columns = [pa.array([r[c] for r in rows], t) for c, t in fields.items()]
        return pa.RecordBatch.from_arrays([keys, *columns], names=[id_col, *fields])

    def run(batches):
        for batch in batches:
            ids, at, rows = batch.column("id"), [], []
            for i, text in enumerate(batch.column("content")):
                found = parse_hocr(text.as_py())
                at += [i] * len(found)
                rows += found
                if len(rows) >= ELEMENTS_AT_ONCE:
                    yield made(ids.take(pa.array(at)), rows)
                    at, rows = [], []
            if rows:
                yield made(ids.take(pa.array(at)), rows)

    kind = dict(files.dtypes)[id_col]
    return files.select(F.col(id_col).alias("id"), F.col(content).alias("content")).where("content IS NOT NULL").mapInArrow(run, f"`{id_col}` {kind}, {COLUMNS}")
