"""Best-first crawl over a static link graph: the driver holds the pages in view, Spark looks up their links."""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from .dedupe import first_by
from .navigation import internal_links

NEAR = 12


def link_graph(pages: DataFrame, sources: list[int] | None = None) -> DataFrame:
    """(src, dst, priority) between pages of a site: next pages by id, and links that lead to known pages.

    Next pages meet by their ids, so a large site's work is that of its pages.  With
    `sources`, only these pages' edges, and no other page is parsed.
    """
    sited = lambda p: p.select("page_id", U.registrable(F.col("url")).alias("site"), "url")
    own = pages if sources is None else pages.where(F.col("page_id").isin(sources))
    site = sited(pages)
    after = sited(own).select(F.col("page_id").alias("src"), "site", F.explode(F.sequence(F.col("page_id") + 1, F.col("page_id") + NEAR)).alias("dst"))
    hop = after.join(site.select(F.col("page_id").alias("dst"), "site"), ["dst", "site"]).select("src", "dst")
    known = internal_links(own).select(F.col("page_id").alias("src"), "url").join(site.select(F.col("page_id").alias("dst"), "url"), "url").select("src", "dst")
    return hop.union(known).distinct().withColumn("priority", F.round(1 / (1 + F.pmod(F.xxhash64("dst"), F.lit(97))), 6))


def crawl(graph: DataFrame | Callable[[list[int]], DataFrame], *, start: int = 0, depth: int = 4, pages: int = 500, batch: int = 1, ahead: int = 32) -> DataFrame:
    """(page_id, depth, visit): pages in the order of their batches, best priority first.

    batch=1 is exact best-first order; larger batches visit that many at once.  `graph`
    holds edges (src, dst, priority), or gives those of some pages and is never built
    whole.  A priority belongs to the page that an edge leads to, so no edge of a page
    but its first `pages` can decide anything: the driver holds that many for each
    visited page and for the `ahead` best ones in view, whose edges are looked up with
    those of the page that is due.
    """
    of = graph if callable(graph) else lambda sources: graph.where(F.col("src").isin(sources))
    todo: dict[int, tuple[int, float]] = {start: (0, 1.0)}
    done: dict[int, int] = {}
    ready: dict[int, list] = {}

    def order(page: int) -> tuple:
        return -todo[page][1], todo[page][0], page

    def edges(sources: list[int]) -> dict[int, list]:
        found: dict[int, list] = {p: [] for p in sources}
        best = first_by(of(sources), ["src"], [F.desc("priority"), F.col("dst")], pages)
        for r in best.collect():
            found[r["src"]].append((r["dst"], r["priority"]))
        return found

    while todo and len(done) < pages:
        now = heapq.nsmallest(min(batch, pages - len(done)), todo, key=order)
        done |= {p: todo.pop(p)[0] for p in now}
        due = [p for p in now if done[p] < depth]
        if missing := [p for p in due if p not in ready]:
            view = heapq.nsmallest(ahead, (p for p, (d, _) in todo.items() if d < depth), key=order)
            ready = {p: ready[p] for p in (*due, *view) if p in ready}
            ready |= edges(missing + [p for p in view if p not in ready])
        for p in due:
            for dst, priority in ready.pop(p):
                if dst not in done:
                    d, q = todo.get(dst, (done[p] + 1, priority))
                    todo[dst] = (min(d, done[p] + 1), max(q, priority))
    return of([]).sparkSession.createDataFrame([(p, d, i) for i, (p, d) in enumerate(done.items())], "page_id long, depth int, visit int")
