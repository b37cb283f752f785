"""Scores and ladders as column expressions.  "Now" and other moving values are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def branch_yield(pages: Column, candidates: Column, normalized: Column, physicians: Column, links: Column, appearances: Column) -> Column:
    def rate(x: Column, per: int) -> Column:
        return F.least(F.lit(1.0), x / F.greatest(pages * per, F.lit(1)))

    score = 0.30 * rate(candidates, 10) + 0.25 * rate(normalized, 3) + 0.20 * rate(physicians, 2) + 0.15 * rate(links, 8) + 0.10 * rate(appearances, 2)
    return F.when(F.coalesce(pages, F.lit(0)) <= 0, 0.0).otherwise(clamp(score))


def memory(visits: Column, speaker_hits: Column, appearance_hits: Column, streak: Column, age_days: Column, decay_days: int = 30, min_visits: int = 2) -> Column:
    v = F.greatest(F.lit(1), F.coalesce(visits, F.lit(0)))
    base = 0.6 * speaker_hits / v + 0.4 * appearance_hits / v
    decay = F.when(age_days.isNull(), 1.0).otherwise(F.exp(-F.greatest(F.lit(0.0), age_days) / decay_days))
    boost = F.when(v >= min_visits, F.least(F.lit(0.15), (v - min_visits) * 0.01)).otherwise(0.0)
    return clamp(base * decay + boost - F.least(F.lit(0.5), F.greatest(F.lit(0), streak) * 0.08))


def novelty(seen: Column, cluster: Column) -> Column:
    return F.when(seen, 0.0).when(cluster <= 1, 0.95).when(cluster <= 4, 0.75).otherwise(0.55)


def year_delta(years: Column, seed: int | None) -> Column:
    """Bonus of the year nearest to the seed year (the earlier of two equally near ones)."""
    if seed is None:
        return F.lit(0.0)
    near = F.array_min(F.transform(years, lambda y: F.struct(F.abs(y - seed).alias("d"), y.alias("y"))))["y"]
    d = seed - near
    return F.when(near.isNull(), 0.0).when(d < 0, -0.04).when(d <= 1, 0.12).when(d <= 5, 0.10).when(d <= 10, 0.08).otherwise(0.06)


def enqueue_priority(llm: Column, mem: Column, nov: Column, yld: Column, depth: Column, delta: Column) -> Column:
    return clamp(clamp(0.45 * llm + 0.30 * mem + 0.15 * nov + 0.10 * yld - 0.05 * (depth + 1), 0.01) + delta, 0.01)


def frontier_priority(llm: Column, yld: Column, nov: Column, depth: Column) -> Column:
    return clamp(0.45 * clamp(llm) + 0.30 * yld + 0.20 * clamp(nov) - 0.05 * F.greatest(F.lit(0), depth), 0.01)


def keyword_score(text: Column, weights: dict[str, int]) -> Column:
    out = F.lit(0)
    for word, weight in weights.items():
        out = out + F.when(text.contains(word), weight).otherwise(0)
    return out


def link_keyword(url: Column, anchor: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", url, F.coalesce(anchor, F.lit(""))))
    return (keyword_score(blob, K.LINK_WEIGHTS) + F.when(F.lower(url).endswith(".pdf"), 4).otherwise(0)).cast("double")


def confidence_min(record: Column, target: Column, default: float = 0.7) -> Column:
    return F.least(F.coalesce(record, F.lit(default)), F.coalesce(target, F.lit(default)))


def safe_int(json: Column, path: str) -> Column:
    """Non-negative int at a JSON path; 0 where it is missing, malformed or no number."""
    return F.greatest(F.lit(0), F.coalesce(F.try_variant_get(F.try_parse_json(json), path, "int"), F.lit(0)))
