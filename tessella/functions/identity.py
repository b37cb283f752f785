"""Which conference a page belongs to, from its site name, title and address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from . import html as H
from . import url as U
from .text import collapse

CONFIDENCE = 0.62


def title_parts(title: Column) -> Column:
    """The title cut at bars, colons and dashes, without empty parts."""
    return F.filter(F.transform(F.split(title, "[|\\-\u2013\u2014:]"), lambda p: collapse(p)), lambda p: p != "")


def conference_identity(url: Column, title: Column, html: Column, years: Column) -> Column:
    """Struct of organizer, event, display, canonical and confidence.

    Null inputs count as empty; `years` are the page's year hints, the newest is
    added to a name without a year.
    """
    url, title, html = (F.coalesce(c, F.lit("")) for c in (url, title, html))
    parts = title_parts(title)
    root = F.initcap(F.trim(F.regexp_replace(F.substring_index(U.host(url), ".", 1), "[^a-zA-Z0-9]+", " ")))
    organizer = F.coalesce(H.meta_site_name(html), F.try_element_at(parts, F.lit(-1)), F.nullif(root, F.lit("")), F.lit("Conference Organizer"))
    marked = F.filter(parts, lambda p: F.exists(F.array(*map(F.lit, K.EVENT_TERMS)), lambda t: F.contains(F.lower(p), t)))
    event = F.coalesce(F.get(marked, F.lit(0)), F.when(F.size(parts) >= 2, F.get(parts, F.lit(0))), U.event_name(url), F.lit("Conference Event"))
    both = F.when(F.contains(F.lower(event), F.lower(organizer)), event).otherwise(F.concat(organizer, F.lit(" - "), event))
    newest = F.array_max(years)
    display = F.when((newest >= 1990) & ~both.rlike(r"\b(19|20|21)\d{2}\b"), F.concat(both, F.lit(" "), newest.cast("string"))).otherwise(both)
    return F.struct(organizer.alias("organizer"), event.alias("event"), F.substring(display, 1, 255).alias("display"), F.substring(F.lower(collapse(display)), 1, 255).alias("canonical"), F.lit(CONFIDENCE).alias("confidence"))
