"""URL filter: rules on host and path, and logistic regression on hashed character n-grams for the rest.

The regression sees runs of three to five characters of the host and of the path, told apart and hashed to a
fixed number of features, and is trained from a small labelled table of URLs.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lorewell.llm import batches as B

FEATURES = 1 << 14
CACHE_URLS = 200_000

#: Labelled URLs to learn from (1: block). Invented, of the kinds that a crawl meets.
LABELLED = [
    ("https://news.example.org/2024/05/city-council-vote", 0), ("https://docs.example.net/guide/install", 0),
    ("https://blog.example.com/how-to-bake-bread", 0), ("https://www.library.example.edu/catalogue/12345", 0),
    ("https://science.example.org/articles/plate-tectonics", 0), ("https://wiki.example.org/page/History_of_glass", 0),
    ("https://forum.example.net/t/garden-tips/881", 0), ("https://museum.example.org/en/exhibitions", 0),
    ("https://health.example.gov/vaccines/schedule", 0), ("https://weather.example.com/forecast/berlin", 0),
    ("https://recipes.example.net/soup/tomato", 0), ("https://travel.example.com/guides/lisbon", 0),
    ("https://www.example.edu/courses/physics-101", 0), ("https://archive.example.org/details/letters-1890", 0),
    ("https://dev.example.io/tutorials/python-lists", 0), ("https://magazine.example.com/essays/on-reading", 0),
    ("https://m.example.net/fr/actualites/87", 0), ("https://www.example.de/de/artikel/42", 0),
    ("https://example.org/es/noticias/7", 0), ("https://books.example.com/review/the-lighthouse", 0),
    ("http://static.example.net/en/571", 0), ("http://blog.example.org/en/33", 0),
    ("https://free-casino-bonus.example.com/spin-win", 1), ("https://poker-slots.example.net/jackpot", 1),
    ("https://cheap-pills-online.example.com/viagra", 1), ("https://pharmacy-discount.example.net/buy-cialis-cheap", 1),
    ("https://hot-xxx-videos.example.com/adult/cams", 1), ("https://porn-tube.example.net/watch/xxx", 1),
    ("https://sex-cams-live.example.org/girls", 1), ("https://payday-loans-now.example.com/apply-fast", 1),
    ("https://crypto-double-money.example.net/invest-now", 1), ("https://replica-watches.example.com/rolex-cheap", 1),
    ("https://click-track.example.net/redirect?aff=9", 1), ("https://ads.example.com/banner/click/771", 1),
    ("https://win-iphone-free.example.com/prize/claim", 1), ("https://download-crack-keygen.example.net/serial", 1),
    ("https://torrent-movies.example.com/download/free-full", 1), ("https://essay-writing-cheap.example.net/order-now", 1),
    ("https://escort-dating.example.com/meet-singles", 1), ("https://seo-backlinks-buy.example.net/pack", 1),
    ("https://casino.example.org/roulette/bet", 1), ("https://betting-odds.example.com/bonus-code", 1),
    ("https://cheap-jersey-outlet.example.net/sale", 1), ("https://lottery-winner.example.com/claim-prize", 1),
]

#: (host, start of path, verdict); a rule fits its host and all hosts below it.
DEFAULT_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
                 ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty without ``://``. Only A-Z of the host are lower-cased."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[end:]
    cut = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return rest[:end].encode().translate(B.LOWER_TABLE).decode(), path[:cut]


def matching_rule(host: str, path: str, rules: dict[tuple[str, str], str]) -> tuple[str | None, str | None]:
    """(rule, verdict) of the longest rule that fits."""
    best = None
    labels = host.split(".")
    suffixes = {".".join(labels[i:]) for i in range(len(labels))}
    for (rule_host, start), verdict in rules.items():
        if rule_host in suffixes and path.startswith(start) and (best is None or len(rule_host + start) > len(best[0])):
            best = (rule_host + start, verdict)
    return best or (None, None)


def grams(host: str, path: str) -> np.ndarray:
    """Hashed 3- to 5-character runs of both parts, each with a mark of the part and of its ends."""
    out = []
    for mark, value in (("h", host), ("p", path)):
        value = f"^{value}$"
        out += [zlib.crc32(f"{mark}{value[i:i + n]}".encode()) % FEATURES for n in (3, 4, 5) for i in range(len(value) - n + 1)]
    return np.unique(np.array(out, np.int64))


@dataclass
class UrlModel:
    weights: np.ndarray = field(repr=False)
    bias: float = 0.0

    def score(self, host: str, path: str) -> float:
        ids = grams(host, path)
        if not len(ids):
            return 0.0
        return float(1 / (1 + np.exp(-(self.weights[ids].sum() / np.sqrt(len(ids)) + self.bias))))


def train(labelled: list[tuple[str, int]] | None = None, epochs: int = 300, rate: float = 0.5, l2: float = 1e-3) -> UrlModel:
    """Logistic regression by gradient steps over the whole labelled table; without rows everything is allowed."""
    rows = [(grams(*split_url(url)), label) for url, label in (LABELLED if labelled is None else labelled)]
    model = UrlModel(np.zeros(FEATURES), 0.0 if rows else -1.0)
    if not rows:
        return model
    x = np.zeros((len(rows), FEATURES))
    for n, (ids, _) in enumerate(rows):
        x[n, ids] = 1 / np.sqrt(len(ids))
    y = np.array([label for _, label in rows], float)
    for _ in range(epochs):
        error = 1 / (1 + np.exp(-(x @ model.weights + model.bias))) - y
        model.weights -= rate * (x.T @ error + l2 * model.weights)
        model.bias -= rate * error.mean()
    return model


def judge_urls(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str, str]] | None = None, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (the model's probability of block).

    The longest fitting rule decides; without one the model does, block from 0.5 up. A null url or one without ``://``
    has an empty host and path and is judged by the model alone. Repeated rows are judged alike; input columns of the
    result's names are replaced.
    """
    B.prepare(pages.sparkSession)
    table = {(host, start): verdict for host, start, verdict in (DEFAULT_RULES if rules is None else rules)}
    shared = pages.sparkSession.sparkContext.broadcast((model, table))
    seen: dict = {}

    def compute(block):
        model, table = shared.value
        if len(seen) > CACHE_URLS:
            seen.clear()
        out = []
        for value in block.column(url).to_pylist():
            if value not in seen:
                host, path = split_url(value)
                rule, verdict = matching_rule(host, path, table)
                score = model.score(host, path)
                seen[value] = (host, path, rule, verdict or ("block" if score >= 0.5 else "allow"), score)
            out.append(seen[value])
        return [list(c) for c in zip(*out, strict=True)]

    fields = [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")] + [T.StructField("score", T.DoubleType())]
    return B.annotate(pages, url, pages.columns, fields, compute)
