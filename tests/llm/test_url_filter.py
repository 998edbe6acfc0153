import numpy as np

from quillspark.llm import url_filter


def brute_rule(host, path, rules=url_filter.RULES):
    fits = [(h + p, kind) for kind, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


URLS = [None, "", "no scheme/en/", "http://", "HTTP://WWW.Example.COM/en/7?x=1", "https://example.com/en/8#a", "https://a.example.net/de/81", "x://net/de/1", "x://notnet/de/1", "http://é.org/es/ü", "a://b://c/d", "http://host?q=/en/", "http://h\n.com/en/\nx", "http://EXAMPLE.org/ES/", "http://" + "a" * 50_000 + ".com/en/1"]


def test_rules_and_parts(spark, sf_dir):
    odd = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, verdict string, host string")
    for pages in (odd, spark.read.parquet(f"{sf_dir}/pages.parquet"), odd.limit(0)):
        urls = {r["page_id"]: r["url"] for r in pages.collect()}
        rows = url_filter.judge(pages).collect()
        assert len(rows) == len(urls)
        for r in rows:
            assert (r["host"], r["path"]) == url_filter.split_url(urls[r["page_id"]])
            rule, kind = brute_rule(r["host"], r["path"])
            assert r["rule"] == rule and r["verdict"] == (kind or ("block" if r["score"] >= 0.5 else "allow"))


def test_table_holds_no_word_of_the_judged_hosts(spark):
    import re

    hosts = {u.split("://")[1].split("/")[0] for d in ("sf0.001", "sf0.01", "sf0.1") for (u,) in spark.read.parquet(f"/root/testdata/{d}/pages.parquet").select("url").where("url LIKE '%://%'").collect()}
    words = {w for h in hosts for w in re.split("[^a-z]+", h.lower())} - {"com", "org", "net", "www", "m", "blog"}
    assert not words & {*url_filter.LURES, *url_filter.ORDINARY}


def test_unseen_words():
    """Hosts of words that were held out: better than chance for either label."""
    blocked, allowed = url_filter.accuracy_by_word()
    print("held out by word: lures blocked", blocked, "ordinary allowed", allowed)
    assert blocked > 0.6 and allowed > 0.6


def test_seen_words_on_new_hosts():
    model = url_filter.UrlModel().fit([(*url_filter.split_url(u), y) for u, y in url_filter.labelled_urls()])
    assert np.mean([(model.score(*url_filter.split_url(u)) >= 0.5) == y for u, y in url_filter.labelled_urls()]) > 0.98
    for host in ("poker-jackpot.biz", "cheaprolexreplica.example", "www.payday-credit.example"):
        assert model.score(host, "/x/9") > 0.5, host
    for host in ("harbour-museum.example", "www.chesslibrary.example", "poetry.example"):
        assert model.score(host, "/x/9") < 0.5, host


def test_repeated_and_null_rows(spark):
    rows = [(1, "http://a.example/x", "v", "h", 3.0)] * 3 + [(None, None, None, None, None)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string, host string, score double")).collect()
    assert sorted(str(r["page_id"]) for r in got) == ["1", "1", "1", "None"] and all(r["verdict"] in ("allow", "block") for r in got)
