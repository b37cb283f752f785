"""What becomes of a fetch: two sources, the reason for the second, gates before costly steps, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from . import url as U
from .pages import is_thin


def crawl_outcome(seed: Column, url: Column, enabled: Column, first: Column, error: Column, second: Column) -> Column:
    """(status, reason, used_fallback, text) of a page that a crawler fetched first and a plain fetch would serve second.

    first, second: struct<kind, text, links, pdf_links>, null where the fetch gave
    nothing.  Reasons, in order: out_of_domain (nothing is fetched), crawl4ai_disabled,
    crawl4ai_thin_content, then the crawler's own error or crawl4ai_failed.
    """
    thin = F.coalesce(is_thin(first["kind"], first["text"], first["links"], first["pdf_links"]), F.lit(True))
    reason = (
        F.when(~U.same_site(seed, url), "out_of_domain")
        .when(~enabled, "crawl4ai_disabled")
        .when(first.isNotNull() & ~thin, F.lit(None).cast("string"))
        .when(first.isNotNull(), "crawl4ai_thin_content")
        .otherwise(F.coalesce(error, F.lit("crawl4ai_failed")))
    )
    rejected = reason.eqNullSafe(F.lit("out_of_domain"))
    fell = reason.isNotNull() & ~rejected
    served = F.when(fell, second).when(~rejected, first)
    return F.struct(F.when(served.isNotNull(), "fetched").otherwise("error").alias("status"), reason.alias("reason"), fell.alias("used_fallback"), F.coalesce(served["text"], F.lit("")).alias("text"))


def explores_interactions(enabled: Column, depth: Column, deepest: int, kind: Column, links: Column, blocks: Column, streak: Column, least: int, window: int) -> Column:
    """Whether a page's controls are worth trying: a page above the last level with few links, no candidates, or no progress for half a window."""
    poor = (links < max(1, least)) | (blocks == 0) | (streak >= max(1, window // 2))
    return enabled & (depth < deepest) & (kind == "html") & poor


def model_choice(stage: Column, allowed: list[str], reasoning: str, plain: str, enabled: bool = True) -> Column:
    """The model of a stage: the reasoning one where it is enabled, named and allowed for the stage."""
    if not enabled or not reasoning.strip():
        return F.lit(plain)
    return F.when(stage.isin([s for s in allowed if s in K.MODEL_STAGES]), reasoning.strip()).otherwise(plain)


def timeout_choice(model: Column, reasoning: str, default: Column, own: float) -> Column:
    """Seconds for a call: the reasoning model gets at least its own."""
    return F.when(model == (reasoning.strip() or None), F.greatest(default, F.lit(own))).otherwise(default) if reasoning.strip() else default


def age_days(then: Column, now: Column) -> Column:
    """Days between two instants, never below zero."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 8.64e10)


def work_key(version: str, hashes: Column) -> Column:
    """Key of a batch of candidates: the same set of hashes in any order is the same work."""
    return F.sha2(F.concat(F.lit(version + "::"), F.array_join(F.array_sort(hashes), "||")).cast("binary"), 256)


def branch_end(first: Column, again: Column) -> Column:
    """What a page's navigation comes to: links at once, links after being asked again, or a closed branch."""
    return F.when(first > 0, "pathfinder").when(again > 0, "nav_reask").otherwise("branch_closed_no_links")
