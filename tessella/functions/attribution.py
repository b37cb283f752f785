"""Which event and year a record belongs to, as column expressions.

A target is struct(name string, year int, confidence double, reason string).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pages import stripped, valid_target
from .scores import clamp


def _blank_null(x: Column) -> Column:
    return F.nullif(stripped(x), F.lit(""))


def _last(years: Column) -> Column:
    return F.try_element_at(years, F.lit(-1))


def relaxed_year(url_years: Column, title_years: Column, record_years: Column, page_years: Column, known: Column) -> Column:
    """The ladder of years: URL, title, a record's only year, the page's latest, the latest known one; lists ascend."""
    latest_known = F.array_max(F.transform(F.filter(known, lambda t: t["year"].between(1990, 2100)), lambda t: t["year"].cast("int")))
    pages = F.filter(F.array_sort(page_years), lambda y: (y >= 1990) & (y <= 2100))
    return F.coalesce(_last(url_years), _last(title_years), F.when(F.size(record_years) == 1, F.try_element_at(record_years, F.lit(1))), _last(pages), latest_known)


def relaxed_target(run_name: Column, default_name: Column, known: Column, year: Column, confidence: Column) -> Column:
    """A target by context alone, with a confidence between 0.35 and 0.8; null without a name or a valid year."""
    names = F.filter(F.transform(known, lambda t: _blank_null(t["name"])), lambda n: n.isNotNull())
    name = F.coalesce(_blank_null(run_name), _blank_null(default_name), F.try_element_at(names, F.lit(-1)))
    sure = clamp(F.coalesce(F.nullif(confidence.cast("double"), F.lit(0.0)), F.lit(0.55)), 0.35, 0.8)
    return F.when(valid_target(name, year), F.struct(name.alias("name"), year.cast("int").alias("year"), sure.alias("confidence"), F.lit("relaxed_context_fallback").alias("reason")))


def resolve_targets(explicit: Column, found: Column, relaxed: Column) -> Column:
    """The record's own valid targets, else those found for it, else the relaxed one; an array, empty without any."""
    def good(a: Column) -> Column:
        return F.filter(a, lambda t: valid_target(t["name"], t["year"]))

    own = good(explicit)
    return F.when(F.size(own) > 0, own).when(F.size(found) > 0, good(found)).otherwise(F.filter(F.array(relaxed), lambda t: t.isNotNull()))
