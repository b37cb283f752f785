"""Where to go from a page without a model: focus words, a scored pool of links and documents, a diverse selection with reserved seats.

A page's words are counted in its row; links are rows of their own, so the only
groups are the links of one page.  Ties keep the order of the page: linked documents
first, then links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scores
from ..functions import text as T
from ..functions import url as U
from ..session import checkpointed
from . import navigation
from .dedupe import first_by


def path_tokens(url: Column) -> Column:
    """Distinct words of a path and their light stems, three letters or more; numbers count."""
    words = F.filter(F.split(F.lower(U.path(url)), "[^a-z0-9]+"), lambda t: t != "")
    n = F.length
    ing = lambda t: F.regexp_replace(F.substring(t, F.lit(1), n(t) - 3), "mm$", "m")
    stem = lambda t: F.when(t.endswith("ing") & (n(t) > 6), ing(t)).when(t.endswith("s") & (n(t) > 4), F.substring(t, F.lit(1), n(t) - 1)).otherwise(t)
    both = F.flatten(F.transform(words, lambda t: F.array(t, stem(t))))
    return F.array_sort(F.array_distinct(F.filter(both, lambda t: (n(t) >= 3) & ~t.isin(K.STOPWORDS))))


def focus_tokens(seed: Column, page: Column, title: Column, headings: Column, summary: Column, most: int = 50) -> Column:
    """The most frequent words of both paths, the title, twelve headings and the head of the summary; ties to the earlier one."""
    heads = F.flatten(F.transform(F.slice(headings, 1, 12), T.stem_tokens))
    every = F.concat(path_tokens(seed), path_tokens(page), T.stem_tokens(title), heads, T.stem_tokens(F.substring(F.coalesce(summary, F.lit("")), 1, 1800)))

    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    # Equal words stand together, the earliest first: they are counted by where they and the next ones begin.
    placed = F.sort_array(F.transform(every, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))

    def ranked(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda x, j: F.when((j == 0) | (x["t"] != F.get(s, j - 1)["t"]), j)), lambda j: j.isNotNull())
        counted = bound(begins, lambda b: F.transform(b, lambda j, k: F.struct((j - F.coalesce(F.get(b, k + 1), F.size(s))).alias("n"), F.get(s, j)["i"].alias("i"), F.get(s, j)["t"].alias("t"))))
        return F.transform(F.slice(F.sort_array(counted), 1, most), lambda c: c["t"])

    return bound(placed, ranked)


def link_score(seed: Column, page: Column, url: Column, text: Column, context: Column, focus: Column, pdf: Column) -> Column:
    """Overlap of a link's words with the focus and with both paths, its place and depth."""
    size = lambda a, b: F.size(F.array_intersect(a, b)).cast("double")
    words, around, own = F.array_distinct(T.stem_tokens(text)), F.array_distinct(T.stem_tokens(context)), path_tokens(url)
    depth = F.size(U.segments(url))
    overlap = 2.2 * size(F.array_union(F.array_union(own, words), around), focus) + 1.6 * size(words, focus) + 0.8 * size(around, focus) + 0.8 * size(own, path_tokens(seed)) + 0.55 * size(own, path_tokens(page))
    place = F.when(pdf, 1.0).otherwise(0.0) + F.when(U.query(url) != "", -0.5).otherwise(0.0) + F.when(F.trim(text) != "", 0.8).otherwise(0.0) + F.when(F.lower(context) == "html_anchor", 3.0).otherwise(0.0)
    tokens = F.size(T.stem_tokens(text))
    told = F.when(tokens >= 2, 0.9).when(tokens == 1, 0.4).otherwise(0.0)
    return overlap + place - F.least(F.lit(2.0), depth * 0.2) + told + F.least(F.lit(0.9), depth * 0.15)


def pool(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Scored candidates of links (page_id, seed, page, focus, pos, url, text, context, pdf).

    Same-site addresses that weren't visited, the first of equal ones (documents come
    first), with score, priority, type, template and expected yield.
    """
    url = F.get(F.transform(F.array(F.trim("url")), lambda u: U.resolve(F.col("page"), u)), F.lit(0))
    full = links.select("page_id", "seed", "page", "focus", "pos", "pdf", F.trim(F.coalesce("text", F.lit(""))).alias("text"), F.trim(F.coalesce("context", F.lit(""))).alias("context"), F.explode(F.array(url)).alias("url"))
    own = full.where(F.col("url").isNotNull() & U.same_site(F.col("seed"), F.col("url")))
    fresh = own.join(visited.select("page_id", "url").distinct(), ["page_id", "url"], "left_anti")
    first = first_by(fresh, ["page_id", "url"], [F.desc("pdf"), F.col("pos")])
    score = F.round(link_score(F.col("seed"), F.col("page"), F.col("url"), F.col("text"), F.col("context"), F.col("focus"), F.col("pdf")), 9)
    s = first.withColumn("score", score)
    # The focus goes with its last use: it is as long as a page's words and would be kept once a link.
    return s.select(
        *[c for c in s.columns if c != "focus"],
        F.round(scores.clamp(0.4 + F.col("score") / 20, 0.2, 0.95), 9).alias("priority"),
        F.when(F.col("pdf"), "pdf").otherwise("unknown").alias("page_type"),
        U.template_hint(F.col("url")).alias("branch_hint"),
        F.round(scores.clamp(0.25 + F.col("score") / 18, 0.1, 1.0), 9).alias("expected_yield"),
    )


def select(candidates: DataFrame, k: int) -> DataFrame:
    """The k next addresses of each page: the best of each template, then the best, with seats for other branches."""
    order = [F.desc("score"), F.desc("pdf"), F.col("pos")]
    # Kept, as it is read twice: scores are much work.
    t = checkpointed(candidates.withColumn("_template", U.template_key(F.col("url"))))
    chosen = navigation.diverse_top(t, "page_id", "_template", order, k, "score").select("page_id", "url", "place")
    from pyspark.sql import Window

    ranked = t.withColumn("nth", F.row_number().over(Window.partitionBy("page_id").orderBy(*order))).join(chosen, ["page_id", "url"], "left")
    prefix = U.prefix(F.col("url"))
    core = (prefix == U.prefix(F.col("seed"))) | (prefix == U.prefix(F.col("page")))
    signal = T.overlaps(T.stem_tokens(F.substring("text", 1, 220)), K.CONTENT_SIGNALS)
    seated = navigation.reserve_cross(ranked, "page_id", "nth", "score", core, F.size(U.segments(F.col("url"))), signal, k)
    return seated.where("place IS NOT NULL").select("page_id", "place", "url", "score", "priority", "page_type", "branch_hint", "expected_yield")
