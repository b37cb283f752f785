"""HTML features as column expressions; tags are matched leniently and never raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, strip_markdown


def title(html: Column) -> Column:
    return collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def headings(html: Column, most: int = 12, width: int = 180) -> Column:
    """Texts of h1, then h2, then h3."""
    found = F.concat(*[F.regexp_extract_all(html, F.lit(rf"(?is)<{h}(?:\s[^>]*)?>(.*?)</"), F.lit(1)) for h in ("h1", "h2", "h3")])
    return F.slice(F.filter(F.transform(found, lambda x: F.substring(collapse(F.regexp_replace(x, "<[^>]*>", " ")), 1, width)), lambda x: x != ""), 1, most)


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags."""
    x = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    return strip_markdown(F.regexp_replace(x, r"(?s)<[^>]*>", " "))


def links(html: Column) -> Column:
    """(href, anchor) of every a element, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*?href=[\"']([^\"']*)[\"'][^>]*>.*?</a>"), F.lit(0))
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, r"(?is)href=[\"']([^\"']*)[\"']", 1).alias("href"), collapse(F.regexp_replace(a, r"(?s)<[^>]*>", " ")).alias("anchor")))


def meta_site_name(html: Column) -> Column:
    def meta(attribute: str, name: str) -> Column:
        return F.nullif(collapse(F.regexp_extract(html, rf"(?is)<meta[^>]*{attribute}=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)), F.lit(""))

    return F.coalesce(meta("property", "og:site_name"), meta("name", "application-name"), meta("name", "apple-mobile-web-app-title"))
