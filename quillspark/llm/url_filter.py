"""URL filter: host/path rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled URL table (a parameter) and has a fixed
number of weights, which go to the executors. Only page_id and url are read; there is no shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path prefix)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


#: Words of hosts that sell or lure, and of ordinary hosts: general English, none from a table that is judged.
LURES = (
    "viagra cialis pharmacy meds steroid slimming diet miracle poker roulette blackjack jackpot slots lottery betting bookmaker gambling "
    "loans payday credit debt refinance cashback bitcoin doubler profit millionaire porn xxx escort webcam nude dating singles hookup "
    "replica rolex handbags outlet discount bargain coupon giveaway prize bonus warez keygen torrent crack cheats ringtones clickbait "
    "popup banner adserver tracker pixel beacon analytics affiliate referral"
).split()
ORDINARY = (
    "library museum university college school hospital council weather history science mathematics physics chemistry biology astronomy "
    "geology botany garden kitchen recipes bakery cheese orchard forest mountain river harbour railway station airport bridge cathedral "
    "theatre orchestra opera cinema gallery painting sculpture poetry novel journal newspaper archive encyclopedia dictionary language "
    "grammar philosophy law parliament ministry embassy football cricket cycling hiking sailing chess knitting carpentry pottery"
).split()


def labelled_urls(lures: list[str] = LURES, ordinary: list[str] = ORDINARY) -> list[tuple[str, int]]:
    """A table of URLs: hosts that sell or lure (1), built as such hosts often are, and ordinary hosts (0).

    Both kinds come alone, joined and hyphenated, under the same endings and paths; only hosts of the first
    kind carry sales words and numbers.
    """
    ends, paths = ["com", "org", "net", "info", "co.uk"], ["/", "/index.html", "/2019/05/page", "/about", "/item.php", ""]
    table = []
    for words, label in ((lures, 1), (ordinary, 0)):
        for i, w in enumerate(words):
            other = words[(i + 7) % len(words)]
            sold = [f"best-{w}", f"{w}4u", f"buy{w}now", f"{w}-{other}-24"] if label else [f"the-{w}", f"{w}s", f"my{w}", f"{w}-{other}-club"]
            for j, host in enumerate([w, f"{w}-{other}", f"{w}{other}", *sold]):
                prefix = ("", "www.", "m.", "blog.")[(i + j) % 4]
                table.append((f"https://{prefix}{host}.{ends[(i + j) % len(ends)]}{paths[(i + j) % len(paths)]}", label))
    return table


def accuracy_by_word(folds: int = 5) -> tuple[float, float]:
    """(share of lures blocked, share of ordinary hosts allowed) on hosts whose words the model never saw."""
    right, seen = [0, 0], [0, 0]
    for fold in range(folds):
        side = lambda words, out: [w for i, w in enumerate(words) if (i % folds == fold) == out]
        model = UrlModel().fit([(*split_url(u), y) for u, y in labelled_urls(side(LURES, False), side(ORDINARY, False))])
        for url, label in labelled_urls(side(LURES, True), side(ORDINARY, True)):
            right[label] += (model.score(*split_url(url)) >= 0.5) == label
            seen[label] += 1
    return right[1] / seen[1], right[0] / seen[0]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: from there up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(`__url`, instr(`__url`, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


class UrlModel:
    """Logistic regression over presence of hashed n-grams, scaled to unit length."""

    def __init__(self, bits: int = 14, sizes: tuple[int, ...] = (3, 4, 5)):
        self.bits, self.sizes = bits, sizes
        self.weights, self.bias = np.zeros(1 << bits), 0.0

    def grams(self, host: str, path: str) -> np.ndarray:
        mask, found = (1 << self.bits) - 1, set()
        for field, text in ((b"h", b"^" + host.encode() + b"$"), (b"p", b"^" + path.encode() + b"$")):
            for n in self.sizes:
                found.update(zlib.crc32(field + text[i : i + n]) & mask for i in range(len(text) - n + 1))
        return np.fromiter(found, np.int64, len(found))

    def fit(self, rows: list[tuple[str, str, int]], rounds: int = 400, rate: float = 4.0, shrink: float = 1e-3) -> UrlModel:
        where = [self.grams(h, p) for h, p, _ in rows]
        y = np.array([label for *_, label in rows], dtype=float)
        x = np.zeros((len(rows), 1 << self.bits), dtype=np.float32)
        for i, g in enumerate(where):
            x[i, g] = 1 / np.sqrt(max(len(g), 1))
        used = np.flatnonzero(x.any(axis=0))
        x, w, b = x[:, used].astype(float), np.zeros(len(used)), 0.0
        share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))  # both labels weigh the same
        for _ in range(rounds):
            error = (1 / (1 + np.exp(-(x @ w + b))) - y) * share
            w -= rate * (x.T @ error + shrink * w)
            b -= rate * 0.1 * error.sum()
        self.weights[used], self.bias = w, b
        return self

    def score(self, host: str, path: str) -> float:
        g = self.grams(host, path)
        return float(1 / (1 + np.exp(-(self.weights[g].sum() / np.sqrt(max(len(g), 1)) + self.bias))))


def split_url(url: str | None) -> tuple[str, str]:
    """host_and_path for the driver's labelled table."""
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    path = rest[cut:]
    end = min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))
    return rest[:cut].translate(str.maketrans(UPPER, LOWER)), path[:end]


def judge(pages: DataFrame, rules=RULES, labelled: list[tuple[str, int]] | None = None, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, score. The rule's verdict, else block if score >= threshold.

    A null url, or one without ://, has an empty host and path, fits no rule and is judged by the model.
    Repeated rows are judged each. Other columns are not read.
    """
    table = [(*split_url(u), label) for u, label in (labelled_urls() if labelled is None else labelled)]
    model = pages.sparkSession.sparkContext.broadcast(UrlModel().fit(table))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"))
    host, path = host_and_path(F.col("__url"))
    parts = base.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)

    def scored(batches):
        for batch in batches:
            score = [model.value.score(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield batch.append_column("score", pa.array(score, pa.float64()))

    kind = dict(base.dtypes)["page_id"]
    out = parts.mapInArrow(scored, f"page_id {kind}, host string, path string, score double")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
