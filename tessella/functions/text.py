"""Text and token features as column expressions."""

from __future__ import annotations

from html import unescape as unescape_entities

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import constants as K


def collapse(x: Column) -> Column:
    """White space (any Unicode) to single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def keep_lines(x: Column) -> Column:
    """NUL dropped, CRLF and CR to LF, blanks and tabs collapsed, at most one empty line in a row."""
    x = F.translate(F.coalesce(x, F.lit("")), "\x00", "")
    x = F.regexp_replace(x, "\r\n?", "\n")
    x = F.regexp_replace(x, "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def strip_markdown(x: Column) -> Column:
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"\[([^\]]+)\]\([^)]+\)", "$1")
    x = F.translate(x, "*_•", "   ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return collapse(x)


def years(x: Column) -> Column:
    """Distinct four-digit years 1990 to 2100, ascending."""
    found = F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\b(19\d{2}|20\d{2}|21\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda y: (y >= 1990) & (y <= 2100))))


def _set(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def nav_tokens(x: Column) -> Column:
    """Distinct tokens of three letters or more, neither numbers nor ignored words, with singulars."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    good = F.filter(raw, lambda t: (F.length(t) >= 3) & ~t.rlike(r"^\d+$") & ~t.isin(K.NAV_IGNORE))
    more = F.transform(F.filter(good, lambda t: t.endswith("s") & (F.length(t) > 4)), lambda t: F.regexp_replace(t, "s$", ""))
    return F.array_sort(F.array_union(good, more))


def stem(t: Column) -> Column:
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    ing = F.regexp_replace(cut(3), "mm$", "m")
    return F.when((n > 6) & t.endswith("ing"), ing).when((n > 5) & t.endswith("ers"), cut(3)).when((n > 4) & t.endswith("es"), cut(2)).when((n > 4) & t.endswith("s"), cut(1)).when((n > 5) & t.endswith("ed"), cut(2)).otherwise(t)


def stem_tokens(x: Column) -> Column:
    """Tokens and their stems, in order, without short words, numbers and stop words."""
    raw = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda t: t != "")
    both = F.flatten(F.transform(raw, lambda t: F.when(stem(t) == t, F.array(t)).otherwise(F.array(t, stem(t)))))
    return F.filter(both, lambda t: (F.length(t) >= 3) & ~t.isin(K.STOPWORDS) & ~t.rlike(r"^\d+$"))


#: Punctuation at the ends of words, of a whole text at once.
_ENDS = r"(?<!\S)[.,:;()\[\]{}!?\"'`]+|[.,:;()\[\]{}!?\"'`]+(?!\S)"


def loose_tokens(*xs: Column) -> Column:
    """Distinct white-space tokens of two characters or more; slashes, dashes and underscores part words."""
    blob = F.translate(F.lower(F.concat_ws(" ", *xs)), "/_-", "   ")
    return F.array_distinct(F.filter(F.split(F.regexp_replace(blob, _ENDS, ""), r"\s+"), lambda t: F.length(t) >= 2))


def overlaps(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, _set(words))


def page_intent(url: Column, title: Column, summary: Column, content_type: Column) -> Column:
    def judge(t: Column) -> Column:
        return (
            F.when(overlaps(t, K.ARCHIVE), "archive")
            .when(overlaps(t, K.GATEKEEPER), F.when(overlaps(t, ["session", "plenary"]), "session_detail").otherwise("gatekeeper"))
            .when(overlaps(t, K.UTILITY), "non_content")
            .otherwise("listing")
        )

    # Bound to a lambda's variable, so that a text is cut into words once.
    judged = F.get(F.transform(F.array(loose_tokens(url, title, summary)), judge), F.lit(0))
    return F.when((F.lower(F.coalesce(content_type, F.lit(""))) == "pdf") | F.lower(url).endswith(".pdf"), "pdf").otherwise(judged)


def is_gatekeeper(tokens: Column, confidence: Column, least: float = 0.6) -> Column:
    return (confidence >= least) & overlaps(tokens, K.GATEKEEPER)


def person_like(*xs: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in xs]))
    out = F.lit(False)
    for h in K.PERSON_HINTS:
        out = out | blob.contains(h)
    return out


@F.pandas_udf(StringType())
def _unescape(x: pd.Series) -> pd.Series:
    return x.map(unescape_entities, na_action="ignore")


def unescape(x: Column) -> Column:
    """HTML entities to characters; only texts with an ampersand leave the JVM."""
    return F.coalesce(_unescape(F.when(x.contains("&"), x)), x)


def _bare(parts: Column, ends: str) -> Column:
    """Words in lower case without the given characters at their ends."""
    return F.transform(parts, lambda p: F.regexp_replace(F.lower(p), f"^[{ends}]+|[{ends}]+$", ""))


def _many(parts: Column, words: list[str]) -> Column:
    return F.size(F.filter(parts, lambda p: p.isin(words)))


def name_part(x: Column) -> Column:
    """The words of a name without capital-letter words before it, two words at least where there are more."""
    def cut(parts: Column) -> Column:
        shouted = F.transform(parts, lambda p: (F.upper(p) == p) & (F.lower(p) != p))
        calm = F.array_position(shouted, F.lit(False)).cast("int")
        lead = F.least(F.when(calm == 0, F.size(parts)).otherwise(calm - 1), F.greatest(F.size(parts) - 2, F.lit(0)))
        return F.slice(parts, lead + 1, F.size(parts))

    return F.array_join(F.get(F.transform(F.array(F.split(collapse(x), " ")), cut), F.lit(0)), " ")


def is_person_name(x: Column) -> Column:
    """Two to five capitalised words, an initial before them at most, not all the same, without too many words of pages."""
    def shape(name: Column) -> Column:
        low = _bare(F.split(name, " "), ".")
        n = F.size(low)
        return name.rlike(K.PERSON_NAME) & n.between(2, 5) & (F.size(F.array_distinct(low)) > 1) & (_many(low, K.NON_NAME) < F.when(n == 2, 1).otherwise(2))

    return F.get(F.transform(F.array(name_part(x)), shape), F.lit(0))


def is_session_title(x: Column) -> Column:
    """16 characters and three words or more, not all the same, with a session word or a fourth word, and not of a menu."""
    def shape(title: Column) -> Column:
        low = _bare(F.split(title, " "), ".:")
        return (F.length(title) >= 16) & (F.size(low) >= 3) & (F.size(F.array_distinct(low)) > 1) & (_many(low, K.NON_SESSION) < 2) & (title.rlike(K.SESSION_WORD) | (F.size(low) >= 4))

    return F.get(F.transform(F.array(collapse(x)), shape), F.lit(0))


def _has_any(x: Column, words: list[str]) -> Column:
    return F.lower(x).rlike("|".join(words))


def sanitize_lines(x: Column, most: int | None = None) -> Column:
    """Lines without boilerplate and web addresses, on one line, cut to `most` characters if given.

    A line goes if it is a copyright line, an address alone or holds the address of a
    dated asset; a line with a word of site furniture goes unless it has a session
    word, credentials or the shape of a person's name.
    """
    def kept(line: Column) -> Column:
        rights = F.lower(line).startswith("copyright") | F.lower(line).contains("all rights reserved")
        rescued = line.rlike(K.SESSION_WORD) | line.rlike(K.BLOCK_CREDENTIAL) | is_person_name(line)
        return (line != "") & ~rights & ~line.rlike(K.ASSET_YEAR_URL) & ~line.rlike(f"^{K.URL_TOKEN}$") & (~_has_any(line, K.CONTEXT_NOISE) | rescued)

    lines = F.transform(F.split(F.regexp_replace(unescape(F.coalesce(x, F.lit(""))), "\r", "\n"), "\n+"), collapse)
    out = collapse(F.regexp_replace(F.array_join(F.filter(lines, kept), " "), K.URL_TOKEN, " "))
    return F.substring(out, 1, most) if most else out


def windows(x: Column, size: int = 2400, overlap: int = 250, most: int = 60) -> Column:
    """Overlapping character windows: array of (start, text); the last one reaches the end."""
    step = size - (min(overlap, size // 3) if overlap >= size else overlap)
    n = F.length(x)
    count = F.least(F.lit(most), F.when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)) + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * step).alias("start"), F.substring(x, i * step + 1, F.lit(size)).alias("text")))


def paragraphs(x: Column, least: int = 30) -> Column:
    """Blocks parted by empty lines, of at least `least` characters."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "\n{2,}"), collapse), lambda p: F.length(p) >= least)


def fingerprint(x: Column, most: int = 12000) -> Column:
    return F.sha2(F.substring(collapse(x), 1, most), 256)
