"""The fallback of navigation against a plain version of its rules."""

import random
import re
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from tessella.functions import constants as K
from tessella.operators import fallback

from .conftest import DATA
from .test_runs import seats


def stem(t):
    if len(t) > 6 and t.endswith("ing"):
        return re.sub("mm$", "m", t[:-3])
    for end, least, cut in (("ers", 5, 3), ("es", 4, 2), ("s", 4, 1), ("ed", 5, 2)):
        if len(t) > least and t.endswith(end):
            return t[:-cut]
    return t


def words(text):
    raw = re.sub("[^a-z0-9]+", " ", (text or "").lower()).split()
    both = [v for t in raw for v in ([t] if stem(t) == t else [t, stem(t)])]
    return [v for v in both if len(v) >= 3 and v not in K.STOPWORDS and not v.isdigit()]


def of_path(url):
    out = set()
    for t in re.split("[^a-z0-9]+", urlparse(url).path.lower()):
        s = re.sub("mm$", "m", t[:-3]) if t.endswith("ing") and len(t) > 6 else t[:-1] if t.endswith("s") and len(t) > 4 else t
        out |= {v for v in (t, s) if len(v) >= 3 and v not in K.STOPWORDS}
    return out


def parts(url):
    return [p for p in urlparse(url).path.lower().split("/") if p]


def plain_focus(seed, page, title, headings, summary):
    every = [*sorted(of_path(seed)), *sorted(of_path(page)), *words(title), *[w for h in headings[:12] for w in words(h)], *words(summary[:1800])]
    return {t for t in sorted(dict.fromkeys(every), key=lambda t: -every.count(t))[:50]}


def plain_select(seed, page, focus, links, visited, k):
    """links: (url, text, context, pdf) in order, documents first."""
    site = lambda u: ".".join(urlparse(u).netloc.lower().split(".")[-2:])
    pool, seen = [], set()
    for url, text, context, pdf in links:
        if not url:
            continue
        url = urljoin(page, url)
        if urlparse(url).scheme not in ("http", "https") or site(url) != site(seed) or url in visited or url in seen:
            continue
        seen.add(url)
        own, said, near, depth = of_path(url), set(words(text)), set(words(context)), len(parts(url))
        s = 2.2 * len((own | said | near) & focus) + 1.6 * len(said & focus) + 0.8 * len(near & focus) + 0.8 * len(own & of_path(seed)) + 0.55 * len(own & of_path(page)) - min(2.0, depth * 0.2)
        s += pdf * 1.0 - 0.5 * bool(urlparse(url).query) + 0.8 * bool(text.strip()) + 3.0 * (context.lower() == "html_anchor")
        s += {0: 0.0, 1: 0.4}.get(len(words(text)), 0.9) + min(0.9, 0.15 * depth)
        pool.append((url, round(s, 9), text))
    pool.sort(key=lambda r: -r[1])
    if not pool:
        return []
    good = [r for r in pool if r[1] >= max(2.0, pool[0][1] * 0.2)]
    used = good if len(good) >= min(3, k) else pool
    template = lambda u: "/".join("{num}" if p.isdigit() else "{id}" if re.match("^[0-9a-f-]{8,}$", p) else p for p in parts(u)[:6])
    firsts = list({template(u): u for u, _, _ in reversed(used)}.values())
    firsts = [u for u, _, _ in used if u in firsts]
    chosen = (firsts + [u for u, _, _ in used if u not in firsts])[:k]
    core = {tuple(parts(seed)[:2]), tuple(parts(page)[:2])}
    rows = [(u, i, s, tuple(parts(u)[:2]) in core, len(parts(u)), bool(set(words(t[:220])) & set(K.CONTENT_SIGNALS))) for i, (u, s, t) in enumerate(pool)]
    by = {r[0]: r for r in rows}
    # `seats` takes the first k by rank as chosen: chosen ones come first, in their order.
    order = [by[u] for u in chosen] + [r for r in rows if r[0] not in chosen]
    scored = {r[0]: i for i, r in enumerate(rows)}
    ranked = [(u, i + 1 if i < len(chosen) else 10_000 + scored[u], s, c, d, g) for i, (u, _, s, c, d, g) in enumerate(order)]
    return seats(ranked, k, scored)


@pytest.mark.parametrize("k", [4, 8])
def test_fallback_equals_a_plain_version(spark, k):
    rng = random.Random(k)
    vocabulary = ["speakers", "program", "agenda", "eyes", "planning", "swimming", "hotel", "2024", "news", "series", "listed", "talks"]
    pages, rows, visited, want, focus_want = [], [], [], {}, {}
    for page_id in range(40):
        seed, page = "https://x.org/" + rng.choice(["", "eyes/2024", "program"]), "https://x.org/" + "/".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 3)))
        title, heads, summary = (" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (4, 3, 30))
        links = [("/".join(["", *(rng.choice([*vocabulary, "77", "deadbeef1"]) for _ in range(rng.randrange(0, 4)))]) + rng.choice(["", "", "?a=1"]), rng.choice(["", "Speakers of eyes", "news", "our program"]), rng.choice(["html_anchor", "link", "eyes"]), False) for _ in range(rng.randrange(0, 25))]
        links += [("https://other.net/x", "x", "link", False), ("mailto:a@b", "m", "link", False)]
        docs = [(f"/{rng.choice(vocabulary)}.pdf", "pdf", "pdf_link", True) for _ in range(rng.randrange(0, 3))]
        gone = {urljoin(page, u) for u, *_ in links if rng.random() < 0.1}
        focus = plain_focus(seed, page, title, [heads], summary)
        focus_want[page_id] = focus
        want[page_id] = plain_select(seed, page, focus, docs + links, gone, k)
        pages.append((page_id, seed, page, title, [heads], summary))
        rows += [(page_id, i, u, t, c, pdf) for i, (u, t, c, pdf) in enumerate(docs + links)]
        visited += [(page_id, u) for u in gone] or [(page_id, "https://x.org/never")]
    p = spark.createDataFrame(pages, "page_id int, seed string, page string, title string, heads array<string>, summary string").withColumn("focus", fallback.focus_tokens(F.col("seed"), F.col("page"), F.col("title"), F.col("heads"), F.col("summary")))
    assert {r["page_id"]: set(r["focus"]) for r in p.collect()} == focus_want
    links = spark.createDataFrame(rows, "page_id int, pos int, url string, text string, context string, pdf boolean").join(p.select("page_id", "seed", "page", "focus"), "page_id")
    got = {i: [] for i in range(40)}
    for r in fallback.select(fallback.pool(links, spark.createDataFrame(visited, "page_id int, url string")), k).orderBy("page_id", "place").collect():
        got[r["page_id"]].append(r["url"])
        assert 0.2 <= r["priority"] <= 0.95 and 0.1 <= r["expected_yield"] <= 1.0 and r["page_type"] == ("pdf" if r["url"].endswith(".pdf") else "unknown")
    assert got == want


def test_nav_fallback_parses_each_page_once(spark, monkeypatch):
    from tessella.functions import dom
    from tessella.plans import catalogue

    calls, plain = [], dom.parsed
    monkeypatch.setattr(dom, "parsed", lambda *a: calls.append(a) or plain(*a))
    out = catalogue.QUERIES["nav_fallback"](spark, f"{DATA}/sf0.001")
    assert out.count() > 0 and len(calls) == 1
    # What is left to run reads what was kept, no page.
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()


def test_nav_fallback_takes_every_link_of_a_page(spark, tmp_path):
    from tessella.plans import catalogue

    rng = random.Random(7)
    vocabulary = ["speakers", "program", "agenda", "eyes", "hotel", "news", "talks"]
    pages, want = [], {}
    for page_id, n in enumerate((20, 61, 90, 400)):
        page, title, said = f"https://x.org/eyes/{page_id}", "Speakers of eyes", "the program and its talks " * 20
        # The words of the page come late: among the first sixty links there is none of the best.
        found = [(f"/{rng.choice(['news', 'hotel'])}/{i}", "more") for i in range(n * 3 // 4)]
        found += [(f"/{rng.choice(vocabulary)}/{rng.choice(vocabulary)}{rng.choice(['', '', '.pdf', '?a=1'])}", rng.choice(vocabulary)) for _ in range(n - len(found))]
        pages.append((page_id, page, f"<title>{title}</title><nav>{''.join(f'<a href={chr(34)}{u}{chr(34)}>{t}</a>' for u, t in found)}</nav><article><h1>{title}</h1><p>{said}</p></article>"))
        first = {u: (i, t) for i, (u, t) in reversed(list(enumerate(found)))}
        links = sorted((not u.endswith(".pdf"), i, urljoin(page, u), t) for u, (i, t) in first.items())
        focus = plain_focus("https://x.org/", page, title, [title], f"{title} {said}")
        want[page_id] = plain_select("https://x.org/", page, focus, [(u, t, "link" if i % 3 == 0 else "html_anchor", not other) for other, i, u, t in links], {u for _, i, u, _ in links if i % 7 == 6}, 8)
        late = {u for _, i, u, _ in links if i >= 60}
        assert n < 90 or late & set(want[page_id])
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {i: [] for i in want}
    for r in catalogue.QUERIES["nav_fallback"](spark, str(tmp_path)).orderBy("page_id", "place").collect():
        got[r["page_id"]].append(r["url"])
    assert got == want
