import random
import re
from collections import deque
from urllib.parse import urljoin, urlparse

import pytest

from quillspark.operators import crawl


def norm(url):
    p = urlparse(url)
    out = f"{p.scheme}://{p.netloc}{p.path}"
    return (out[:-1] if out.endswith("/") else out).lower()


def queue_crawl(web, start, max_depth=5, max_pages=100, subdomains=False, include=(), exclude=()):
    """One crawl with a queue, page by page."""
    valid = lambda u: len(u) <= 2048 and urlparse(u).scheme in ("http", "https") and urlparse(u).netloc
    if not start or not valid(start):
        return []
    queue, seen, out = deque([(start, 0, "")]), {norm(start)}, []
    while queue and (max_pages is None or len(out) < max_pages):
        url, depth, parent = queue.popleft()
        if depth > max_depth:
            continue
        html = web.get(norm(url), None)
        links = []
        for href in re.findall(r"""href=["']([^"']+)["']""", html or "", re.I):
            if not href.startswith(("#", "javascript:", "mailto:", "tel:")) and len(urljoin(url, href)) <= 2048:
                links.append(urljoin(url, href))
        out.append((url, depth, parent, "failed" if html is None else "success", len(links), len(out)))
        for to in links:
            host = urlparse(to).netloc
            if valid(to) and norm(to) not in seen and (host == urlparse(start).netloc or (subdomains and host.endswith("." + urlparse(start).netloc))):
                if (not include or any(re.search(p, to) for p in include)) and not any(re.search(p, to) for p in exclude):
                    seen.add(norm(to))
                    queue.append((to, depth + 1, url))
    return out


def site(seed, n=120):
    rng = random.Random(seed)
    hosts = ["a.example", "b.a.example", "c.example"]
    pages = {}
    for i in range(n):
        url = f"http://{rng.choice(hosts)}/{rng.choice(['x', 'Y', 'x/y'])}/{i % 40}"
        links = [rng.choice([f"/x/{rng.randrange(40)}", f"../Y/{rng.randrange(40)}/", f"http://b.a.example/x/{rng.randrange(40)}#t", f"{rng.randrange(40)}?q=1", "#top", "mailto:x@y", "https://c.example/x/1", "javascript:0", "ftp://c.example/z", "/" + "l" * 2100, f"/x/y/{rng.randrange(60)}"]) for _ in range(rng.randrange(6))]
        pages.setdefault(norm(url), (url, " ".join(f"<a {rng.choice(['href', 'HREF'])}={q}{u}{q}>" for u in links for q in [rng.choice("\"'")])))
    return pages


OPTIONS = [{}, {"max_pages": 7}, {"max_pages": None, "max_depth": 9}, {"max_depth": 0}, {"subdomains": True, "max_pages": 30}, {"exclude": [r"/Y/"], "include": [r"x", r"q=1"]}]


@pytest.mark.parametrize("options", OPTIONS)
def test_equals_a_queue(spark, options):
    pages = site(len(str(options)))
    rows = [(i, u, h, "x") for i, (u, h) in enumerate(pages.values())] + [(999, next(iter(pages.values()))[0].upper().replace("HTTP", "http"), "<a href='/never'>", "x"), (1000, None, None, "x"), (1001, "http://a.example/null", None, "x")]
    web = {k: h for k, (u, h) in pages.items()} | {"http://a.example/null": ""}
    starts = [u for u, _ in list(pages.values())[:4]] + ["http://a.example/null", "http://nowhere.example/", "no url", "ftp://a.example/", None, "http://[bad"]
    got = crawl.crawl(spark.createDataFrame(rows, "page_id long, url string, html string, depth string").repartition(3), spark.createDataFrame([(s,) for s in [*starts, starts[0]]], "start string"), include_subdomains=options.get("subdomains", False), **{k: v for k, v in options.items() if k != "subdomains"})
    want = [(s, *r) for s in starts if s != "http://[bad" for r in queue_crawl(web, s, **options)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    if not options:
        totals = {r.start: (r.pages, r.failed) for r in crawl.crawl_totals(got).collect()}
        assert totals == {s: (len(rows), sum(r[4] == "failed" for r in rows)) for s in {w[0] for w in want} for rows in [[w for w in want if w[0] == s]]}


def test_empty(spark):
    assert crawl.crawl(spark.createDataFrame([], "page_id long, url string, html string"), spark.createDataFrame([], "start string")).count() == 0
