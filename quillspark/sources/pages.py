"""Readers of text formats: HTML, URLs, magic bytes, JSON lines, notebooks, genealogy files."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "noscript", "template", "head"}
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "title"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.links, self.title, self.in_title, self.cells = [], 0, [], [], False, []

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag in SKIPPED:
            self.skip += 1
        if tag in BLOCKS:
            self.out.append("\n")
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in SKIPPED and self.skip:
            self.skip -= 1
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skip:
            self.out.append(data)


def parse_html(html: str | None) -> tuple[str, str, list[str]]:
    """(title, text, links) of a page; text has a line for each block."""
    p = _Text()
    p.feed(html or "")
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    return " ".join("".join(p.title).split()), "\n".join(x for x in lines if x), p.links


def html_documents(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, title, content, links of each page, in Arrow batches."""

    def run(batches):
        for pdf in batches:
            made = [parse_html(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "title": [m[0] for m in made], "content": [m[1] for m in made], "links": [m[2] for m in made]})

    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInPandas(run, "page_id long, title string, content string, links array<string>")


#: First bytes (hex) of file types.
MAGIC = {"25504446": "pdf", "504B0304": "zip", "89504E47": "png", "FFD8FF": "jpeg", "47494638": "gif", "1F8B": "gzip", "D0CF11E0": "ole", "7B5C727466": "rtf"}


def type_of_bytes(data: Column) -> Column:
    """File type by first bytes; html, xml and json by the first characters; else text."""
    head, out = F.hex(F.substring(data, 1, 8)), F.lit("text")
    start = F.lower(F.ltrim(F.substring(data, 1, 200).cast("string")))
    out = F.when(start.startswith("<?xml"), "xml").when(start.rlike(r"^<(!doctype html|html)"), "html").when(start.rlike(r"^[\[{]"), "json").otherwise(out)
    for code, name in MAGIC.items():
        out = F.when(head.startswith(code), name).otherwise(out)
    return out


#: File types by suffix.
SUFFIXES = {"pdf": "pdf", "htm": "html", "html": "html", "md": "markdown", "txt": "text", "tex": "latex", "ipynb": "notebook", "epub": "epub", "docx": "word", "pptx": "slides", "json": "json", "csv": "csv"}


def type_of_url(url: Column) -> Column:
    """File type by the suffix of the URL's path; web where there is none that is known."""
    suffix = F.lower(F.regexp_extract(F.regexp_extract(url, r"^[^?#]*", 0), r"/[^/]*\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, suffix), F.lit("web"))


def notebook_cells(books: DataFrame, id_col: str = "id", body: str = "body") -> DataFrame:
    """cell_no, cell_type and source of each notebook's cells."""
    cells = F.from_json(F.col(body), "cells array<struct<cell_type string, source array<string>>>")
    return books.select(F.col(id_col), F.posexplode(cells.getField("cells")).alias("cell_no", "c")).select(id_col, "cell_no", F.col("c.cell_type").alias("cell_type"), F.array_join("c.source", "").alias("source"))


def gedcom_records(lines: DataFrame, file: str = "file", number: str = "line_no", value: str = "value") -> DataFrame:
    """Level-numbered lines into records: file, record id, kind and its first name and sex."""
    from pyspark.sql import Window

    level = F.regexp_extract(value, r"^\s*([0-9]+)", 1).cast("int")
    tag = F.regexp_extract(value, r"^\s*[0-9]+\s+(?:@[^@]+@\s+)?([A-Z_]+)", 1)
    rest = F.trim(F.regexp_extract(value, r"^\s*[0-9]+\s+(?:@[^@]+@\s+)?[A-Z_]+\s*(.*)$", 1))
    w = Window.partitionBy(file).orderBy(number)
    rows = lines.select(file, number, level.alias("level"), tag.alias("tag"), rest.alias("rest"), F.regexp_extract(value, r"^\s*0\s+@([^@]+)@", 1).alias("ref"))
    rows = rows.withColumn("record", F.sum((F.col("level") == 0).cast("int")).over(w))
    first = lambda t: F.min_by(F.when(F.col("tag") == t, F.col("rest")), F.when(F.col("tag") == t, F.col(number)))
    out = rows.groupBy(file, "record").agg(F.max("ref").alias("ref"), F.min_by("tag", number).alias("kind"), first("NAME").alias("name"), first("SEX").alias("sex"))
    return out.where("kind IN ('INDI', 'FAM')").select(file, "ref", "kind", "name", "sex")


def read_jsonl(spark: SparkSession, path: str, schema) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines) of JSON lines, gzip by suffix; blank lines are skipped."""
    full = f"{schema}, _bad string" if isinstance(schema, str) else schema
    raw = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    lines = spark.read.text(path).where("trim(value) <> ''")
    names = [f.name for f in raw.schema if f.name != "_bad"]
    parsed = lines.select("value", F.from_json("value", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in raw.schema if f.name != "_bad") + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r._bad IS NULL").select(*[f"r.{n}" for n in names]), parsed.where("r._bad IS NOT NULL").select("value")


def write_jsonl(df: DataFrame, path: str, gzip: bool = True) -> None:
    df.write.option("compression", "gzip" if gzip else "none").json(path)
