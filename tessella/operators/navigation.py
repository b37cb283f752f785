"""Link extraction, scoring and diversified selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import dom
from ..functions import html as H
from ..functions import scores
from ..functions import text as T
from ..functions import url as U
from ..session import checkpointed
from .dedupe import first_by


def resolved_links(base: Column) -> Column:
    """A parsed page's links as an array of (url, anchor), resolved against its address."""
    # Resolved inside the array: a filter on what a generator gives doesn't repeat the expression.
    return F.transform(dom.links(), lambda l: F.struct(U.resolve(base, l["href"]).alias("url"), F.substring(l["anchor"], 1, 200).alias("anchor")))


def own_links(found: DataFrame, links: Column, most: int | None = None) -> DataFrame:
    """(page_id, pos, url, anchor): the distinct same-site ones of each page's links (an array), the first `most` if given, for pages (page_id, base)."""
    each = found.select("page_id", "base", F.posexplode(links).alias("pos", "l")).select("page_id", "base", "pos", "l.url", "l.anchor")
    full = each.where(F.col("url").isNotNull() & U.same_site(F.col("base"), F.col("url")))
    first = first_by(full, ["page_id", "url"], [F.col("pos")])
    return (first if most is None else first_by(first, ["page_id"], [F.col("pos")], most)).select("page_id", "pos", "url", "anchor")


def internal_links(pages: DataFrame, most: int = 60) -> DataFrame:
    """(page_id, pos, url, anchor): the first `most` distinct same-site links of each page, fragments kept."""
    parsed = dom.parsed(pages.select("page_id", F.col("url").alias("base"), "html"))
    return own_links(parsed, resolved_links(F.col("base")), most)


def nav_rows(links: DataFrame) -> DataFrame:
    """Links (url, text) as navigation reads them: a text (else the last part of the path) and where they stand."""
    last = F.substring(F.coalesce(F.element_at(F.split(F.regexp_replace(U.path(F.col("url")), "^/+|/+$", ""), "/"), -1), F.lit("")), 1, 120)
    text = F.coalesce(F.nullif(F.trim(F.coalesce("text", F.lit(""))), F.lit("")), last)
    context = F.substring(F.coalesce(F.nullif(F.col("context"), F.lit("")), F.lit("link")), 1, 120) if "context" in links.columns else F.lit("link")
    return links.withColumn("text", text).withColumn("context", context)


def seed_packets(pages: DataFrame, most: int = 30, width: int = 2000) -> DataFrame:
    """What is told of a first page: domain, title, the head of its text, its first internal links and the years in both."""
    parsed = dom.parsed(pages.select("page_id", "url", "html", H.title(F.col("html")).alias("title")))
    head = F.substring("text", 1, width)
    own = internal_links(pages, most).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "url", "anchor"))).alias("links"))
    told = parsed.select("page_id", "url", U.host(F.col("url")).alias("domain"), "title", head.alias("visible_text"), F.slice(T.years(F.concat_ws(" ", "title", head)), 1, 12).alias("year_hints"))
    return told.join(own, "page_id", "left").withColumn("links", F.coalesce(F.transform("links", lambda l: F.struct(l["url"].alias("url"), l["anchor"].alias("anchor"))), F.array().cast("array<struct<url: string, anchor: string>>")))


def relevant(seed: Column, page: Column, candidate: Column, anchor: Column, focus: Column) -> Column:
    """Whether a link is in scope: same site, no utility page, and a focus, year or signal hit."""
    tokens = T.nav_tokens(F.concat_ws(" ", U.path(candidate), anchor))
    signal, focused = T.overlaps(tokens, K.NAV_SIGNAL), F.arrays_overlap(tokens, focus)
    generic = F.lower(T.collapse(anchor)).isin(K.GENERIC_ANCHORS)
    section = (U.primary_section(seed) != "") & (U.primary_section(seed) == U.primary_section(candidate)) & (U.primary_section(seed) == U.primary_section(page))
    dated = (F.size(T.years(F.concat_ws(" ", candidate, anchor))) > 0) & section
    return U.same_site(seed, candidate) & ~(T.overlaps(tokens, K.NAV_EXCLUDE) & ~signal) & ~(generic & ~focused) & (focused | dated | signal)


def filter_links(links: DataFrame, seed: str, page: str, focus: Column, allow_pdf: Column, within: list[str], order: str) -> DataFrame:
    """Adds `kept` and `why` to (url, text) links: 'empty', 'repeated', 'pdf', 'out_of_scope' or 'kept'.

    The first link of a canonical URL is judged; later ones are repeats whatever becomes of it.
    """
    url = F.coalesce(F.trim("url"), F.lit(""))
    w = Window.partitionBy(*within, "_canonical").orderBy(order)
    rows = links.withColumn("_canonical", F.when(url != "", U.canonical(url))).withColumn("_nth", F.row_number().over(w))
    good = relevant(F.col(seed), F.col(page), url, F.coalesce("text", F.lit("")), focus)
    why = F.when(url == "", "empty").when(F.col("_nth") > 1, "repeated").when(~allow_pdf & U.is_pdf_like(url), "pdf").when(~F.coalesce(good, F.lit(False)), "out_of_scope").otherwise("kept")
    return rows.withColumn("why", why).withColumn("kept", F.col("why") == "kept").drop("_canonical", "_nth")


def context_score(seed: Column, page: Column, candidate: Column, anchor: Column, focus: Column) -> Column:
    """Linear overlap score of a link with the page's focus tokens."""
    shared = lambda a, b: F.size(F.array_intersect(a, b)).cast("double")
    path = lambda u: F.array_distinct(T.stem_tokens(U.path(u)))
    words = F.array_distinct(T.stem_tokens(anchor))
    depth = F.size(U.segments(candidate))
    base = 2.2 * shared(F.array_union(path(candidate), words), focus) + 1.6 * shared(words, focus) + 0.8 * shared(path(candidate), path(seed)) + 0.55 * shared(path(candidate), path(page)) - F.least(F.lit(2.0), depth * 0.2)
    query = F.when(U.query(candidate) != "", -0.5).otherwise(0.0)
    text = F.when(F.trim(anchor) != "", 0.8).otherwise(0.0)
    known = F.when(F.size(words) >= 2, 0.9).when(F.size(words) == 1, 0.4).otherwise(0.0)
    return base + query + text + 3.0 + known + F.least(F.lit(0.9), depth * 0.15)


def scored_links(pages: DataFrame, k: int) -> DataFrame:
    """Best k links of each page by context score, ties by position."""
    focus = F.array_distinct(F.slice(T.stem_tokens(F.concat_ws(" ", U.path(F.col("base")), F.col("title"))), 1, 50))
    base = pages.select("page_id", F.col("url").alias("base"), H.title(F.col("html")).alias("title"))
    rows = internal_links(pages).join(base, "page_id").withColumn("focus", focus)
    score = context_score(F.col("base"), F.col("base"), F.col("url"), F.col("anchor"), F.col("focus"))
    best = first_by(rows.withColumn("score", F.round(score, 6)), ["page_id"], [F.desc("score"), F.col("pos")], k)
    return best.select("page_id", "url", "score", F.round(scores.clamp(0.4 + F.col("score") / 20, 0.2, 0.95), 6).alias("priority"), F.round(scores.clamp(0.25 + F.col("score") / 18, 0.1, 1.0), 6).alias("expected_yield"))


def diverse_top(df: DataFrame, key: str, template: str, order: list[Column], k: int, score: str | None = None) -> DataFrame:
    """k rows a key: the best of each template first, then the rest in order.

    Rows with a score below max(2, a fifth of the key's best) go, where min(3, k) others are left.
    """
    if score:
        of_key = Window.partitionBy(key)
        marked = df.withColumn("_good", F.col(score) >= F.greatest(F.lit(2.0), F.max(score).over(of_key) * 0.2))
        df = marked.withColumn("_left", F.count_if("_good").over(of_key)).where(F.col("_good") | (F.col("_left") < min(3, k))).drop("_good", "_left")
    first = F.row_number().over(Window.partitionBy(key, template).orderBy(*order))
    ranked = df.withColumn("_again", (first > 1).cast("int"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_again", *order))
    return ranked.withColumn("place", place).where(F.col("place") <= k).drop("_again")


def judge_candidates(rows: DataFrame, seed: str, page: str, focus: Column, allow_pdf: Column, within: list[str], order: str) -> DataFrame:
    """Adds `kept` and `why` to candidates (url, page_type, reason, branch_hint).

    As filter_links, and before the scope is judged: pages without content go, and
    unknown ones whose address, reason and type hold neither a focus nor a signal word.
    """
    text = F.trim(F.concat(F.coalesce("reason", F.lit("")), F.lit(" "), F.coalesce("branch_hint", F.lit(""))))
    kind = F.lower(F.trim(F.coalesce(F.nullif("page_type", F.lit("")), F.lit("unknown"))))
    words = T.nav_tokens(F.concat_ws(" ", "url", text, kind))
    judged = filter_links(rows.withColumn("text", text), seed, page, focus, allow_pdf, within, order)
    open_ = ~F.col("why").isin("empty", "repeated", "pdf")
    idle = (kind == "unknown") & ~(T.overlaps(words, K.NAV_SIGNAL) | F.arrays_overlap(words, focus))
    why = F.when(open_ & (kind == "non_content"), "no_content").when(open_ & idle, "no_signal").otherwise(F.col("why"))
    return judged.withColumn("why", why).withColumn("kept", F.col("why") == "kept").drop("text")


def reserve_cross(pool: DataFrame, key: str, order: str, score: str, core: Column, depth: Column, signal: Column, k: int) -> DataFrame:
    """A selection (place 1 to k, else null) of each key with seats kept for other branches.

    pool: scored rows of a key, `order` their rank by score; core tells rows of the
    seed's or the page's own branch.  Where more than max(3, k // 2) rows are chosen,
    up to two seats go to the best of the other branches, one of them with a content
    signal if there is any; they push the last chosen rows of the own branches out and
    stand at the end.  Ranks are counted within a key: of core rows from the tail, of
    the newcomers from their head.
    """
    of_key = Window.partitionBy(key)
    boosted = F.col(score) + 0.2 * depth + F.when(signal, 1.2).otherwise(0.0)
    best = of_key.orderBy("_core", F.desc("_boost"), order)
    t = pool.withColumns({"_core": core.cast("int"), "_sig": signal, "_boost": boosted})
    t = t.withColumns({"_chosen": F.coalesce(F.col("place") <= k, F.lit(False)), "_cross": F.when(F.col("_core") == 0, F.row_number().over(best))})
    t = t.withColumns({"_n": F.count_if("_chosen").over(of_key), "_others": F.count_if(F.col("_core") == 0).over(of_key), "_first_sig": F.min(F.when((F.col("_core") == 0) & F.col("_sig"), F.col("_cross"))).over(of_key)})
    seats = F.least(F.lit(min(2, max(1, k // 6))), "_others")
    # Without a signal row among the first seats, the best signal row takes the last one.
    late = F.col("_first_sig") > seats
    wanted = (F.col("_cross") <= F.when(late, seats - 1).otherwise(seats)) | (late & (F.col("_cross") == F.col("_first_sig")))
    t = t.withColumn("_new", F.coalesce(wanted, F.lit(False)) & ~F.col("_chosen") & (F.col("_n") > max(3, k // 2)))
    ranks = {
        "_news": F.count_if("_new").over(of_key),
        "_nth_new": F.when(F.col("_new"), F.row_number().over(of_key.orderBy(F.desc("_new"), "_cross"))),
        "_cores": F.count_if(F.col("_chosen") & (F.col("_core") == 1)).over(of_key),
        "_tail": F.when(F.col("_chosen") & (F.col("_core") == 1), F.row_number().over(of_key.orderBy(F.desc(F.col("_chosen") & (F.col("_core") == 1)), F.desc("place")))),
    }
    t = t.withColumns(ranks)
    free = k - F.col("_n")
    stays = F.col("_chosen") & ~F.coalesce(F.col("_tail") <= F.col("_news"), F.lit(False))
    comes = F.col("_new") & (F.col("_nth_new") <= F.col("_cores") + free)
    t = t.withColumn("_in", stays | comes)
    place = F.row_number().over(of_key.orderBy(F.desc("_in"), F.col("_new").cast("int"), F.when(F.col("_new"), F.col("_nth_new")).otherwise(F.col("place"))))
    return t.select(*[c for c in pool.columns if c != "place"], F.when(F.col("_in"), place).alias("place"))


def link_targets(pages: DataFrame) -> DataFrame:
    """Distinct (page_id, url): the links on each page, canonical."""
    return internal_links(pages, 1 << 30).select("page_id", U.canonical(F.col("url")).alias("url")).distinct()


def reachable(links: DataFrame, seeds: DataFrame, depth: int = 4) -> DataFrame:
    """(seed, page_id, depth) of the pages that seeds (seed, page_id) reach by links that pages share, in `depth` steps at most.

    A step goes from the pages it found to their distinct links and from those to the
    pages that have them, so its work is that of the links; links are read once and kept.
    """
    links = checkpointed(links)
    found = level = checkpointed(seeds.select("seed", "page_id").distinct().withColumn("depth", F.lit(0)))
    for step in range(1, depth + 1):
        over = level.join(links, "page_id").select("seed", "url").distinct()
        pages = over.join(links, "url").select("seed", "page_id").distinct()
        level = checkpointed(pages.join(found, ["seed", "page_id"], "left_anti").withColumn("depth", F.lit(step)))
        found = found.unionByName(level)
    return found


def heuristic_people(rows: DataFrame) -> DataFrame:
    """(id, full_name, designation, confidence) found by credentials, else by the title of doctor."""
    text = T.collapse(F.col("text"))
    both = lambda group: F.regexp_extract_all(text, F.lit(K.CREDENTIAL_NAME), F.lit(group))
    hit = F.arrays_zip(both(1).alias("name"), both(2).alias("degree"))
    doctor = F.regexp_extract(text, K.DOCTOR_NAME, 1)
    alone = F.when(doctor != "", F.array(F.struct(doctor.alias("name"), F.lit(None).cast("string").alias("degree")))).otherwise(F.array().cast("array<struct<name:string,degree:string>>"))
    person = F.filter(hit, lambda p: ~F.lower(p["name"]).isin(K.NON_PERSON))
    found = F.when(F.size(person) > 0, person).otherwise(F.filter(alone, lambda p: ~F.lower(p["name"]).isin(K.NON_PERSON)))
    # One row a name in any case, the last of them.
    people = first_by(rows.select("id", F.posexplode(found).alias("pos", "p")).withColumn("low", F.lower("p.name")), ["id", "low"], [F.desc("pos")])
    degree = F.regexp_replace(F.upper("p.degree"), r"\.", "")
    return people.select("id", F.col("p.name").alias("full_name"), F.when(degree == "PHD", "PhD").otherwise(degree).alias("designation"), F.when(degree.isNull(), 0.45).otherwise(0.62).alias("confidence"))
