"""URL rules on Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.scale import let

# File endings that are never pages, and tracking parameters.
BLOCKED_EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "svg", "zip", "rar", "7z", "mp4", "mp3",
    "doc", "docx", "xls", "xlsx", "ppt", "pptx", "pdf",
)
TRACKING_PREFIXES = ("utm_", "from", "spm")

_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def host(url: Column) -> Column:
    """Lower-case host name without user and port; empty when there is none."""
    return F.lower(F.regexp_extract(authority(url), r"^(?:.*@)?([^:@]*)", 1))


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def _form_encode(value: Column) -> Column:
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query_item(item: Column) -> Column:
    name = F.regexp_extract(item, r"(?s)^([^=]*)", 1)
    value = F.regexp_extract(item, r"(?s)^[^=]*=(.*)\z", 1)
    decoded = [F.coalesce(F.try_url_decode(part), part) for part in (name, value)]
    return F.struct(decoded[0].alias("name"), decoded[1].alias("value"))


def _parts(url: Column) -> Column:
    return F.struct(*[F.regexp_extract(url, _PARTS, group).alias(name) for group, name in enumerate(
        ("scheme", "authority", "path", "query"), 1)])


def _host_of(authority_text: Column) -> Column:
    return F.lower(F.regexp_extract(authority_text, r"^(?:.*@)?([^:@]*)", 1))


def _clean_query(query: Column) -> Column:
    items = F.transform(F.filter(F.split(query, "&"), lambda item: item != ""), _query_item)
    tracking = "|".join(TRACKING_PREFIXES)
    kept = F.filter(items, lambda item: ~F.lower(item["name"]).rlike(rf"^(?:{tracking})"))
    return F.array_join(
        F.transform(kept, lambda i: F.concat(_form_encode(i["name"]), F.lit("="), _form_encode(i["value"]))), "&")


def normalize_url(url: Column) -> Column:
    """Canonical page address, or null when the address is not a web page."""
    raw = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    blocked = rf"(?i)\.(?:{'|'.join(BLOCKED_EXTENSIONS)})\z"

    def rebuilt(p: Column) -> Column:
        web = F.lower(p["scheme"]).isin("http", "https") & (_host_of(p["authority"]) != "") & ~p["path"].rlike(blocked)
        query = F.when(p["query"] == "", F.lit("")).otherwise(_clean_query(p["query"]))
        return F.when(web, F.concat(
            F.lower(p["scheme"]), F.lit("://"), F.lower(p["authority"]),
            F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]),
            let(query, lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))))

    return let(_parts(raw), rebuilt)


def base_of(base: Column) -> Column:
    """The pieces of a page address its links are resolved against; bind once per page."""
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    directory = F.regexp_extract(path(base), r"(?s)^(.*/)", 1)
    return F.struct(
        base.alias("url"), scheme(base).alias("scheme"), root.alias("root"), path(base).alias("path"),
        F.when(directory == "", F.lit("/")).otherwise(directory).alias("directory"))


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute address of a link on the page ``base``.

    Absolute, protocol-relative, root-relative, query-only, fragment-only and
    directory-relative links are covered; ``.`` and ``..`` segments are folded.
    """
    return let(base_of(base), lambda b: resolve_against(b, href))


def resolve_against(b: Column, href: Column) -> Column:
    tail = F.regexp_extract(href, r"(?s)^[^?#]*(.*)\z", 1)
    relative = F.regexp_extract(href, r"(?s)^([^?#]*)", 1)
    joined = F.when(href.startswith("/"), relative).otherwise(F.concat(b["directory"], relative))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(b["scheme"], F.lit(":"), href))
        .when(href == "", b["url"])
        .when(href.startswith("#"), F.concat(F.regexp_replace(b["url"], r"(?s)#.*\z", ""), href))
        .when(href.startswith("?"), F.concat(b["root"], b["path"], href))
        .otherwise(F.concat(b["root"], let(joined, _fold_dots), tail))
    )


def _fold_dots(value: Column) -> Column:
    """Resolve dot segments; paths without any, the usual case, are left alone."""
    segments = F.split(value, "/")
    folded = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda kept, s: F.when(s == ".", kept)
        .when(s == "..", F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept))
        .otherwise(F.concat(kept, F.array(s))),
    )
    text = F.array_join(folded, "/")
    text = F.when(value.rlike(r"/\.{1,2}\z"), F.concat(text, F.lit("/"))).otherwise(text)
    return F.when(F.contains(value, F.lit("/.")) & value.rlike(r"/\.{1,2}(/|\z)"), text).otherwise(value)


def official_url(url: Column, hosts: Sequence[str] = (), suffixes: Sequence[str] = ()) -> Column:
    """True for https addresses of the given hosts or below the given domain suffixes."""
    name = host(url)
    known = name.isin(*hosts) if hosts else F.lit(False)
    for suffix in suffixes:
        known = known | name.endswith("." + suffix.lstrip("."))
    port = F.regexp_extract(authority(url), r":(\d*)\z", 1)
    plain = ~authority(url).contains("@") & port.isin("", "443")
    return F.coalesce((scheme(url) == "https") & known & plain, F.lit(False))


def keep_official(df: DataFrame, url: str, hosts: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    """Rows with an official address, the host list given as a table with a ``host`` column."""
    listed = hosts.select(F.lower("host").alias("__host")).distinct().withColumn("__listed", F.lit(True))
    marked = df.withColumn("__host", host(F.col(url))).join(listed, "__host", "left")
    below = F.lit(False)
    for suffix in suffixes:
        below = below | F.col("__host").endswith("." + suffix.lstrip("."))
    port = F.regexp_extract(authority(F.col(url)), r":(\d*)\z", 1)
    plain = (scheme(F.col(url)) == "https") & ~authority(F.col(url)).contains("@") & port.isin("", "443")
    return marked.where(plain & (F.coalesce(F.col("__listed"), F.lit(False)) | below)).drop("__host", "__listed")


def is_detail_page(selected: Column, url: Column) -> Column:
    """A content block was found, or the address has the shape of an article."""
    return selected | F.lower(url).contains("/page.htm") | url.rlike(r"/20\d{2}/\d{4}/")


def source_name(df: DataFrame, url: str, names: DataFrame, pattern: str = "官方站点（%s）",
                out: str = "source") -> DataFrame:
    """Site name looked up by host (``names``: host, name), else built from the host."""
    known = names.select(F.lower("host").alias("__host"), F.col("name").alias("__name"))
    return (
        df.withColumn("__host", host(F.col(url))).join(known, "__host", "left")
        .withColumn(out, F.coalesce("__name", F.format_string(pattern, F.col("__host"))))
        .drop("__host", "__name")
    )
