"""Reading fetched pages.

A small Arrow stage walks the markup once and emits raw pieces; choosing the title, cleaning
lines, resolving and normalizing links and finding dates are Catalyst expressions on top.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.functions.dates import published_time
from lorewell.functions.text import clean_lines, fold_blanks
from lorewell.functions.urls import base_of, is_detail_page, normalize_url, resolve_against
from lorewell.scale import in_pieces, let

# Where pages keep their text, title and date, and what is thrown away first.
CONTENT_SELECTORS = (
    "article", ".wp_articlecontent", ".v_news_content", ".article-content", ".article_content",
    ".news-content", ".news_content", ".content-detail", ".content", "main",
)
REMOVED_SELECTORS = (
    "script", "style", "noscript", "iframe", "svg", "form", "nav", "footer", "aside",
    ".nav", ".navbar", ".header", ".footer", ".sidebar", ".breadcrumb", ".share", ".pagination",
    ".related", ".advertisement",
)
TITLE_SELECTORS = ("h1", ".arti_title", ".article-title", ".news-title")
DATE_METAS = (("property", "article:published_time"), ("name", "publishdate"), ("name", "PubDate"), ("name", "date"))
MINIMUM_CONTENT, TITLE_CHARS, UNTITLED = 80, 255, "未命名网页"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_TEXTS = T.ArrayType(T.StringType())
_LINK = T.StructType().add("href", "string").add("anchor", "string").add("in_content", "boolean")
RAW = (
    T.StructType().add("titles", _TEXTS).add("og_title", "string").add("title_tag", "string").add("metas", _TEXTS)
    .add("pieces", _TEXTS).add("selected", "boolean").add("links", T.ArrayType(_LINK)))


class _Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict, parent: "_Node | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def is_a(self, selector: str) -> bool:
        if selector.startswith("."):
            return selector[1:] in (self.attrs.get("class") or "").split()
        return self.tag == selector

    def walk(self) -> Iterator["_Node"]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, _Node))

    def pieces(self) -> list[str]:
        found, stack = [], [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                if item.strip():
                    found.append(item.strip())
            elif item is self or item.tag not in ("script", "style"):
                stack.extend(reversed(item.children))
        return found


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.here = self.here.parent

    def handle_endtag(self, tag):
        node = self.here
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        self.here.children.append(data)


def _read(html: str) -> dict:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    root = builder.root
    anchors = [n for n in root.walk() if n.tag == "a" and "href" in n.attrs]
    texts = [" ".join(n.pieces()) for n in anchors]
    for node in list(root.walk()):
        if any(node.is_a(s) for s in REMOVED_SELECTORS) and node.parent is not None:
            node.parent.children.remove(node)
    nodes = list(root.walk())

    def first(selector: str) -> _Node | None:
        return next((n for n in nodes if n.is_a(selector)), None)

    def meta(key: str, value: str) -> str | None:
        node = next((n for n in nodes if n.tag == "meta" and n.attrs.get(key) == value), None)
        return (node.attrs.get("content") or None) if node else None

    content, selected = first("body") or root, False
    for selector in CONTENT_SELECTORS:
        node = first(selector)
        if node and len(" ".join(node.pieces())) >= MINIMUM_CONTENT:
            content, selected = node, selector != "main"
            break
    inside = {id(n) for n in content.walk()}
    title = first("title")
    return {
        "titles": [" ".join(n.pieces()) if n else "" for n in map(first, TITLE_SELECTORS)],
        "og_title": meta("property", "og:title"),
        "title_tag": " ".join(title.pieces()) if title else None,
        "metas": [meta(*m) for m in DATE_METAS],
        "pieces": content.pieces(), "selected": selected,
        "links": [{"href": a.attrs["href"], "anchor": t, "in_content": id(a) in inside} for a, t in zip(anchors, texts)],
    }


@F.pandas_udf(RAW)
def read_markup(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in in_pieces(batches):
        yield pd.DataFrame([_read(html or "") for html in batch], columns=[
            "titles", "og_title", "title_tag", "metas", "pieces", "selected", "links"])


def page_title(raw: Column) -> Column:
    """Heading, then title classes, then og:title, then the title tag up to a separator."""
    def usable(text: Column) -> Column:
        return F.substring(fold_blanks(text), 1, TITLE_CHARS)

    heading = F.get(F.filter(raw["titles"], lambda t: t != ""), F.lit(0))
    tag = F.regexp_extract(raw["title_tag"], r"(?s)^([^\-|_]*)", 1)
    return F.coalesce(usable(heading), usable(raw["og_title"]), usable(tag), F.lit(UNTITLED))


def page_links(raw: Column, url: Column, content_only: bool = False) -> Column:
    """Ordered array of distinct (url, anchor); the first anchor of a target counts."""
    links = F.filter(raw["links"], lambda k: k["in_content"]) if content_only else raw["links"]
    resolved = F.filter(
        let(base_of(url), lambda base: F.transform(links, lambda k: F.struct(
            normalize_url(resolve_against(base, F.trim(k["href"]))).alias("url"), fold_blanks(k["anchor"]).alias("anchor")))),
        lambda k: k["url"].isNotNull())
    # Keep a link when no earlier one has the same target.
    return let(resolved, lambda every: let(
        F.transform(every, lambda k: k["url"]),
        lambda urls: F.filter(every, lambda k, i: F.array_position(urls, k["url"]) == i + 1)))


def parse_pages(pages: DataFrame, content_chars: int | None = None) -> DataFrame:
    """Add title, content, published_time, links, content_links and is_detail to (url, html) rows."""
    url = F.col("url")
    raw = F.col("__raw")
    parsed = pages.withColumn("__raw", read_markup("html")).withColumns({
        "title": page_title(raw), "content": clean_lines(F.array_join(raw["pieces"], "\n")),
        "links": page_links(raw, url), "content_links": page_links(raw, url, content_only=True),
        "is_detail": is_detail_page(raw["selected"], url)})
    metas = [F.get(raw["metas"], F.lit(i)) for i in range(len(DATE_METAS))]
    return parsed.withColumn(
        "published_time", published_time(metas, F.col("content"), url, content_chars)).drop("__raw")


def edge_table(parsed: DataFrame) -> DataFrame:
    """Edges (src, dst, anchor, pos, in_content) of parsed pages."""
    # The outer explode keeps Spark from testing the array, and so parsing the markup, a second time.
    return parsed.select(
        F.col("url").alias("src"), F.posexplode_outer("links").alias("pos", "link"), "content_links",
    ).where(F.col("link").isNotNull()).select("src", F.col("link")["url"].alias("dst"), F.col("link")["anchor"].alias("anchor"), "pos",
             F.exists("content_links", lambda k: k["url"] == F.col("link")["url"]).alias("in_content"))
