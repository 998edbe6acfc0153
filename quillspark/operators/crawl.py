"""Breadth-first crawls over a table of pages: the table is the web, and every crawl is worked on at once.

A round joins the frontiers of all crawls with the pages, resolves the links that it finds, keeps the first way to
each new address, and drops by an anti-join what a crawl has met before. Each round is written, so its inputs are never
worked out again. A page's place in its crawl is the path of link numbers that led to it; among pages of one depth these
paths sort as a queue would have held them, without any window over a crawl.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.scratch import saved

#: How links stand in pages, links that lead nowhere, the longest address.
HREF = r"""(?i)href=["']([^"']+)["']"""
NOT_FOLLOWED = ("#", "javascript:", "mailto:", "tel:")
MOST_CHARACTERS = 2048
_LINKS = "array<struct<no: int, url: string, address: string>>"


def address(url: str | None) -> str | None:
    """What makes two URLs the same page: scheme, host and path in lower case without last slash; null if it is no web URL."""
    if not url or len(url) > MOST_CHARACTERS:
        return None
    try:
        p = urlparse(url)
    except ValueError:
        return None
    if p.scheme not in ("http", "https") or not p.netloc:
        return None
    return f"{p.scheme}://{p.netloc}{p.path}".removesuffix("/").lower()


def _host(url: str) -> str:
    return urlparse(url).netloc


def links_of(url: str, hrefs: Sequence[str] | None) -> list[str]:
    """Absolute URLs of the links of a page, in order, those that lead nowhere or are too long left out."""
    out = []
    for href in [] if hrefs is None else hrefs:
        if not href.startswith(NOT_FOLLOWED):
            try:
                absolute = urljoin(url, href)
            except ValueError:
                continue
            if len(absolute) <= MOST_CHARACTERS:
                out.append(absolute)
    return out


def _addressed(df: DataFrame, url: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pdf.assign(address=[address(u) for u in pdf[url]])

    return df.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", address string")


def crawl(pages: DataFrame, starts: DataFrame, max_depth: int = 5, max_pages: int | None = 100, include_subdomains: bool = False, include: Sequence[str] = (), exclude: Sequence[str] = (), url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """One row per page of a crawl: start, url, depth, parent_url, status, links_found, place (from 0, as crawled).

    starts: a column `start`; each distinct URL of it is a crawl of its own that keeps to its host (or also to hosts
    below it). include, exclude: regular expressions of which a followed URL must match one, or none. A crawl ends
    beyond max_depth links or, in breadth-first order, max_pages pages (None: no bound); there is no bound on its queue.
    status: success, or failed where the table has no such page. Of pages with one address the least id counts. Starts
    that are no web URL give no row.
    """
    hrefs = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(HREF), F.lit(1))
    web = _addressed(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), hrefs.alias("hrefs")), "url")
    web = saved(web.where("address IS NOT NULL").groupBy("address").agg(F.min_by("hrefs", F.struct("id", "url")).alias("hrefs")), "web")
    followed, left_out = [re.compile(p) for p in include], [re.compile(p) for p in exclude]

    def goes(start: str, url: str) -> bool:
        own, host = _host(start), _host(url)
        if host != own and not (include_subdomains and host.endswith(f".{own}")):
            return False
        return (not followed or any(p.search(url) for p in followed)) and not any(p.search(url) for p in left_out)

    def read(batches):
        for pdf in batches:
            made = []
            for start, url, hrefs in zip(pdf["start"], pdf["url"], pdf["hrefs"], strict=True):
                found = links_of(url, hrefs)
                links = [(no, to, at) for no, to in enumerate(found) if (at := address(to)) and goes(start, to)]
                made.append((len(found), [{"no": no, "url": to, "address": at} for no, to, at in links]))
            yield pdf.drop(columns="hrefs").assign(links_found=[m[0] for m in made], links=[m[1] for m in made])

    frontier = _addressed(starts.select("start", F.col("start").alias("url")).distinct(), "url").where("address IS NOT NULL")
    frontier = saved(frontier.select("start", "url", "address", F.lit("").alias("parent_url"), F.array().cast("array<int>").alias("path")), "frontier")
    seen, done = frontier.select("start", "address"), []
    for depth in range(max_depth + 1):
        held = frontier.join(web.withColumn("there", F.lit(True)), "address", "left")
        held = held.select("start", "url", "parent_url", "path", "hrefs", F.when(F.col("there"), "success").otherwise("failed").alias("status"))
        schema = f"start string, url string, parent_url string, path array<int>, status string, links_found int, links {_LINKS}"
        here = saved(held.mapInPandas(read, schema).withColumn("depth", F.lit(depth)), "crawled")
        done.append(here)
        if depth == max_depth:
            break
        found = here.select("start", F.col("url").alias("parent_url"), "path", F.explode("links").alias("l"))
        found = found.select("start", F.col("l.url").alias("url"), F.col("l.address").alias("address"), "parent_url", F.array_append("path", F.col("l.no")).alias("path"))
        first = found.groupBy("start", "address").agg(F.min_by(F.struct("url", "parent_url", "path"), "path").alias("f"))
        new = first.join(seen, ["start", "address"], "left_anti").select("start", "f.url", "address", "f.parent_url", "f.path")
        if max_pages is not None:  # what comes later in this round comes after that many pages
            new = new.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy("path"))).where(F.col("n") <= max_pages).drop("n")
        frontier = saved(new, "frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier.select("start", "address"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    place = F.row_number().over(Window.partitionBy("start").orderBy("depth", "path")) - 1
    out = out.select("start", "url", "depth", "parent_url", "status", "links_found", place.alias("place"))
    return out if max_pages is None else out.where(F.col("place") < max_pages)


def crawl_totals(crawled: DataFrame) -> DataFrame:
    """Per start: pages, failed, deepest and success_rate."""
    failed = F.count(F.when(F.col("status") == "failed", 1))
    n = F.count(F.lit(1))
    return crawled.groupBy("start").agg(n.alias("pages"), failed.alias("failed"), F.max("depth").alias("deepest"), F.round((n - failed) / n, 6).alias("success_rate"))
