"""Rules on pages, titles and links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import collapse, person_like


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def stripped(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", "")


def is_thin(content_type: Column, text: Column, links: Column, pdf_links: Column) -> Column:
    """A PDF with fewer than 40 characters; another page with fewer than 300 and no links."""
    n = F.length(stripped(text))
    return F.when(content_type.eqNullSafe(F.lit("pdf")), n < 40).otherwise((n < 300) & (links == 0) & (pdf_links == 0))


def better_fetch(content_type: Column, static: Column, rendered: Column, least: int = 1200) -> Column:
    """'rendered' where thin HTML has a longer rendering, else 'static'."""
    n, m = F.length(stripped(static)), F.length(stripped(rendered))
    return F.when(content_type.eqNullSafe(F.lit("html")) & (n < least) & (m > n), "rendered").otherwise("static")


def sitemap_locations(xml: Column) -> Column:
    """Trimmed locations of the url elements of a sitemap, in order."""
    found = F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?s)<url>.*?<loc>(.*?)</loc>.*?</url>"), F.lit(1))
    return F.filter(F.transform(found, stripped), lambda u: u != "")


def robots_sitemaps(root: Column, robots: Column, most: int = 5) -> Column:
    """The default sitemap of a site and those its robots.txt names, at most five."""
    named = F.regexp_extract_all(F.coalesce(robots, F.lit("")), F.lit(r"(?im)^[ \t]*sitemap:[ \t]*(\S[^\r\n]*?)[ \t]*\r?$"), F.lit(1))
    return F.slice(F.concat(F.array(F.concat(root, F.lit("/sitemap.xml"))), named), 1, most)


def search_queries(name: Column, year: Column) -> Column:
    """Search phrases for the speakers of an event."""
    quoted = F.concat(F.lit('"'), name, F.lit('" '), year.cast("string"), F.lit(" "))
    return F.array(*[F.concat(quoted, F.lit(s)) for s in K.SEARCH_SUFFIXES])


def title_parts(title: Column) -> Column:
    """Parts of a title between bars, dashes and colons."""
    return F.filter(F.transform(F.split(F.coalesce(title, F.lit("")), r"[|\-–—:]"), collapse), lambda p: p != "")


def file_slug(name: Column) -> Column:
    """A safe file name; 'backup' where nothing is left."""
    s = F.regexp_replace(F.lower(stripped(name)), r"[^\p{L}\p{N}_-]", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^[-_]+|[-_]+$", ""), F.lit("")), F.lit("backup"))


def conference_name(x: Column, most: int = 255) -> Column:
    """The name as it is stored: blanks collapsed, at most as long as its column."""
    return F.substring(collapse(x), 1, most)


def first_last(name: Column) -> Column:
    """First and last word of a name; both null with fewer than two words."""
    t = F.filter(F.split(F.coalesce(name, F.lit("")), r"(?U)\s+"), lambda x: x != "")
    enough = F.size(t) >= 2
    return F.struct(F.when(enough, F.element_at(t, 1)).alias("first"), F.when(enough, F.element_at(t, -1)).alias("last"))


def link_text(text: Column, path: Column, most: int = 120) -> Column:
    """The anchor's text, or the last segment of its path."""
    segments = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    return F.coalesce(F.nullif(stripped(text), F.lit("")), F.substring(F.element_at(segments, -1), 1, most))


def is_pdf_link(url: Column, text: Column) -> Column:
    return _any(F.lower(F.concat_ws(" ", url, text)), K.PDF_HINTS)


def triage(url: Column, title: Column, snippet: Column) -> Column:
    """Category, fetch method and score of a search result without a model's answer."""
    low = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")), url))

    def as_struct(category: str, method: str) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(method).alias("method"), F.lit(0.45).alias("score"))

    return (
        F.when(low.contains("pdf"), as_struct("pdf_program", "pdf_text"))
        .when(_any(low, ["speaker", "faculty"]), as_struct("official_speakers", "http_static"))
        .when(_any(low, ["program", "agenda", "schedule"]), as_struct("official_program", "http_static"))
        .when(_any(low, ["cvent", "swapcard", "whova"]), as_struct("platform", "playwright_dom"))
        .otherwise(as_struct("unknown", "http_static"))
    )


def seed_page_type(content_type: Column, title: Column, text: Column) -> Column:
    low = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    return (
        F.when(_any(low, K.SPEAKER_TERMS), "speakers")
        .when(_any(low, ["agenda", "program", "session"]), "program")
        .when(content_type.eqNullSafe(F.lit("pdf")), "pdf")
        .otherwise("homepage")
    )


def newest_years(years: Column, now: int, most: int = 3) -> Column:
    """The newest years from the last one to two ahead of `now`, else the newest of all; ascending."""
    down = F.reverse(F.array_sort(F.array_distinct(F.filter(years, lambda y: (y >= 1990) & (y <= 2100)))))
    near = F.filter(down, lambda y: (y >= now - 1) & (y <= now + 2))
    return F.array_sort(F.slice(F.when(F.size(near) > 0, near).otherwise(down), 1, most))


def valid_target(name: Column, year: Column) -> Column:
    return F.coalesce((stripped(name) != "") & year.between(1990, 2100), F.lit(False))


def year_hints(known: Column, default_name: Column, years: Column, most: int = 8) -> Column:
    """Distinct (name, year) pairs: the known targets, then the default name with each year of the page.

    Names are equal without regard to case; the first spelling stays.
    """
    good = F.transform(F.filter(known, lambda t: valid_target(t["name"], t["year"])), lambda t: F.struct(stripped(t["name"]).alias("name"), t["year"].cast("int").alias("year")))
    own = F.when(F.coalesce(default_name, F.lit("")) == "", F.slice(good, 1, 0)).otherwise(
        F.transform(F.array_sort(F.array_distinct(F.filter(years, lambda y: (y >= 1990) & (y <= 2100)))), lambda y: F.struct(conference_name(default_name).alias("name"), y.cast("int").alias("year")))
    )
    every = F.concat(good, own)
    key = lambda t: F.struct(F.lower(t["name"]).alias("n"), t["year"].alias("y"))
    keys = F.transform(every, key)
    firsts = F.filter(every, lambda t, i: F.array_position(keys, key(t)) == i + 1)
    return F.slice(firsts, 1, most)


def is_nav_noise(text: Column) -> Column:
    """Site furniture, unless a name with credentials or a time of day is in it."""
    x = F.coalesce(text, F.lit(""))
    return _any(F.lower(x), K.NAV_NOISE) & ~x.rlike(K.BLOCK_CREDENTIAL) & ~x.rlike(K.TIME_MARKER)


def is_linkable(candidate: Column, role: Column, session: Column, confidence: Column, *texts: Column) -> Column:
    """Whether a record may be linked: a marked or person-like one, a speaker's role, or a sure session."""
    speaks = _any(F.lower(F.coalesce(role, F.lit(""))), K.SPEAKING_ROLES)
    sure = (stripped(session) != "") & (F.coalesce(confidence, F.lit(0.0)) >= 0.6)
    return F.coalesce(candidate, F.lit(False)) | person_like(*texts, role, session) | speaks | sure


def expand_decision(enabled: Column, attempted: Column, intent: Column, candidates: Column, normalized: Column, blob: Column, least: int = 3) -> Column:
    """Whether a page's folded parts are worth opening, and the first reason that decides; `blob` is read whole."""
    dynamic = _any(F.lower(F.coalesce(blob, F.lit(""))), K.DYNAMIC_HINTS)
    aimed = F.coalesce(intent.isin(K.EXPANDABLE_INTENTS), F.lit(False))
    reason = (
        F.when(~enabled, "disabled")
        .when(attempted, "already_attempted")
        .when(~aimed, F.concat(F.lit("intent_"), F.coalesce(intent, F.lit("")), F.lit("_not_targeted")))
        .when(~dynamic, "no_dynamic_signal")
        .when((candidates >= max(1, least)) | (normalized > 0), "baseline_yield_sufficient")
        .otherwise("low_yield_dynamic_page")
    )
    return F.struct((reason == "low_yield_dynamic_page").alias("attempt"), reason.alias("reason"))


def block_priority(block: Column) -> Column:
    low = F.lower(F.coalesce(block, F.lit("")))
    return F.when(low.contains("[block person_span]"), 3).when(low.contains("[block session_span]"), 2).when(low.contains("[block dom_card]"), 1).otherwise(0)


def block_limit(segments: Column, most: int = 20) -> Column:
    """Blocks to keep beside a page's segments."""
    return F.when(segments >= 6, min(most, 8)).when(segments >= 3, min(most, 12)).otherwise(most)
