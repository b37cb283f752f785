"""Golden cases of the scalar functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import html as H
from tessella.functions import names, recover, scores
from tessella.functions import text as T
from tessella.functions import url as U


def one(spark, expr, **cols):
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "url", "want"),
    [
        (U.registrable, "https://a.b.example.org/x", "example.org"),
        (U.registrable, "https://example/x", "example"),
        (U.template_full, "https://x.org/Talk/12/0123456789ab", "/talk/{num}/{id}"),
        (U.template_full, "https://x.org", "/"),
        (U.canonical, "HTTPS://X.org//a//b/?utm_a=1&z=2&b=1&ref=q", "https://x.org/a/b?b=1&z=2"),
        (U.canonical_interaction, "https://x.org/a/?q=1", "https://x.org/a"),
        (U.canonical_reasoner, "https://x.org//a/?q=1", "https://x.org//a?q=1"),
        (U.fetch_method, "https://x.org/p.pdf", "pdf_text"),
        (U.fetch_method, "https://whova.com/e", "playwright_network"),
        (U.fetch_method, "https://x.org/e", "http_static"),
        (U.source_category, "https://x.org/speakers", "official_speakers"),
        (U.event_name, "https://x.org/spring-days/program/", "Spring Days"),
        (U.canonical, "not a url", "https:///"),
    ],
)
def test_url(spark, f, url, want):
    assert one(spark, f(F.col("u")), u=url) == want


def test_same_template_for_other_number_and_case(spark):
    assert one(spark, U.template_full(F.col("a")) == U.template_full(F.col("b")), a="https://x.org/Day/1", b="https://x.org/day/22")


def test_tokens(spark):
    assert one(spark, T.nav_tokens(F.col("x")), x="/Events/Speakers-2024/ab") == ["speaker", "speakers"]
    assert one(spark, T.stem_tokens(F.col("x")), x="programming the papers 12") == ["programming", "program", "papers", "pap"]
    assert one(spark, T.years(F.col("x")), x="2024 1985 2024 1999 20245") == [1999, 2024]
    assert one(spark, T.collapse(F.col("x")), x="  a  b\n") == "a b"
    assert one(spark, T.keep_lines(F.col("x")), x="a\r\n\r\n\r\n\r\nb\t c ") == "a\n\nb c"
    assert one(spark, T.sanitize_lines(F.col("x")), x="Talk one\nPrivacy Policy\nhttps://x.org/a\nTalk two") == "Talk one Talk two"


@pytest.mark.parametrize(
    ("title", "kind", "want"),
    [("scientific program plenary", "html", "session_detail"), ("past years", "html", "archive"), ("x", "pdf", "pdf"), ("hotel", "html", "non_content"), ("faculty", "html", "gatekeeper"), ("welcome", "html", "listing")],
)
def test_page_intent(spark, title, kind, want):
    assert one(spark, T.page_intent(F.lit("https://x.org/"), F.col("t"), F.lit(""), F.col("k")), t=title, k=kind) == want


def test_windows_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(5000))
    got = one(spark, T.windows(F.col("x"), 2400, 250), x=text)
    assert [w["start"] for w in got] == [0, 2150, 4300]
    assert got[-1]["text"] == text[4300:]


def test_html(spark):
    page = "<title> A  b </title><script>var t='</p>';</script><h2>Two</h2><h1>One <b>x</b></h1><p>Some words</p><a href='/p.pdf#x'>P</a><a href='mailto:x'>m</a>"
    assert one(spark, H.title(F.col("h")), h=page) == "A b"
    assert one(spark, H.headings(F.col("h")), h=page) == ["One x", "Two"] or one(spark, H.headings(F.col("h")), h=page) == ["One", "Two"]
    assert "var t" not in one(spark, H.visible_text(F.col("h")), h=page)
    links = one(spark, F.transform(H.links(F.col("h")), lambda a: U.resolve(F.lit("https://x.org/d/e"), a["href"], fragment=False)), h=page)
    assert links == ["https://x.org/p.pdf", None]


def test_json_recovery(spark):
    assert one(spark, recover.json_object(F.col("x")), x='so ```json\n{"a": 1}\n``` ok') == '{"a": 1}'
    assert one(spark, recover.json_payload(F.col("x")), x="list: [1, 2] end") == "[1, 2]"
    assert one(spark, scores.safe_int(F.col("x"), "$.k"), x='{"k": "12"}') == 12
    assert one(spark, scores.safe_int(F.col("x"), "$.k"), x="{bad") == 0
    assert one(spark, scores.safe_int(F.col("x"), "$.k"), x='{"k": -4}') == 0


def test_memory_score_bounds(spark):
    x = one(spark, scores.memory(F.lit(2), F.lit(1), F.lit(1), F.lit(0), F.lit(0.0)))
    assert 0 < x <= 1
    assert one(spark, scores.branch_yield(*[F.lit(v) for v in (2, 20, 6, 4, 16, 4)])) == pytest.approx(1.0)
    assert one(spark, scores.year_delta(F.array(F.lit(2023), F.lit(2030)), 2024)) == pytest.approx(0.12)


@pytest.mark.parametrize("raw", ["HIV treatment Jane Smith, MD", "MD Jane Smith", "jane SMITH"])
def test_canonical_name(raw):
    got = names.canonical_person(raw)
    assert got["is_valid"] and got["full_name"] == "Jane Smith"


@pytest.mark.parametrize(("raw", "reason"), [("", "empty_name"), ("123", "no_tokens"), ("Agenda", "not_person_like")])
def test_not_a_name(raw, reason):
    assert names.canonical_person(raw)["reason"] == reason


def test_keys():
    assert names.key_of("Dr. José  Núñez, MD, PhD") == "jose nunez"
    assert names.identity("anna berg", "anna bergg") > 88 > names.identity("anna berg", "bruno berg")


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert names.lcs(a, b) == t[-1][-1]


def test_session_pairs(spark):
    from tessella.functions import extract as X

    def pairs(text):
        return [(r["session"], r["speaker"]) for r in X.pairs_table(spark.createDataFrame([(1, text)], "id int, text string")).orderBy("pos").collect()]

    text = "## Opening plenary session on eyes\n* Anna Berg (City Hospital)\n[Great advances in corneal care](https://x.org/1) Bruno Kern"
    assert pairs(text) == [("Great advances in corneal care", "Bruno Kern"), ("Opening plenary session on eyes", "Anna Berg")]
    assert pairs("<li><a href='x'>A keynote lecture on light</a> Carla Dorn (Bonn)</li>") == [("A keynote lecture on light", "Carla Dorn")]
    title = "Person-Centered Eye Care: Letting Patients Choose their"
    assert pairs(f"**PLENARY SESSION 2: EYES**\n* {title} ART Rupa Berg\n* Long-Acting Drops: Changing the Clinic Monica Kern")[0] == (title, "Rupa Berg")
    items = f"<p><strong>PLENARY SESSION 2: EYES</strong></p><ul><li><a href='x'><em>{title} care</em></a><br>Rupa Berg</li>\n<li>Carla Dorn (Bonn)</li></ul>"
    assert pairs(items)[:2] == [(f"{title} care", "Rupa Berg"), ("PLENARY SESSION 2: EYES", "Carla Dorn")]
    assert pairs("[ Join The Club ](https://x.org/j) Log In\n[ Education ](https://x.org/e) Education Education") == []
    assert pairs(None) == pairs("") == []
    assert pairs("Home Login Join\nMembership Policy") == []


def test_json_nodes():
    from tessella.functions import extract as X

    assert X.json_nodes('{"@type": "Organization", "name": "Acme"}') == [] and len(X.json_nodes('{"FirstName": "A", "lastName": "B", "company": "C"}')) == 1
    twice = '{"a": [{"title": "T", "speakers": [{"name": "A", "bio": "b"}]}, {"name": "A", "bio": "b"}], "x": {"name": "B"}}'
    assert X.json_nodes(twice) == ['{"speakers": [{"bio": "b", "name": "A"}], "title": "T"}', '{"bio": "b", "name": "A"}']
    assert X.json_nodes("{bad") == []
    assert X.context_spans("aa bb cc bb dd", "bb", 3, 5) == ["aa bb cc", "cc bb dd"]


def test_conference_identity(spark):
    from pyspark.sql import functions as F

    from tessella.functions import identity

    cases = [
        ("https://x.org/a", "Spring Summit 2024 | Eye Society", "", [2021, 2024], ("Eye Society", "Spring Summit 2024", "Eye Society - Spring Summit 2024")),
        ("https://eye-club.org/events/retina-days", "", "", [2019, 2022], ("Eye Club", "Retina Days", "Eye Club - Retina Days 2022")),
        ("https://x.org/", "Home", '<meta property="og:site_name" content="Eye Forum">', [], ("Eye Forum", "Conference Event", "Eye Forum - Conference Event")),
        ("https://x.org/", "Welcome - Eye Congress", "", [1985], ("Eye Congress", "Eye Congress", "Eye Congress")),
        (None, None, None, None, ("Conference Organizer", "Conference Event", "Conference Organizer - Conference Event")),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, url string, title string, html string, years array<int>")
    got = df.select("i", identity.conference_identity(*map(F.col, ("url", "title", "html", "years"))).alias("x")).orderBy("i").select("x.*").collect()
    assert [(r["organizer"], r["event"], r["display"]) for r in got] == [c[4] for c in cases]
    assert all(r["canonical"] == r["display"].lower() and r["confidence"] == 0.62 for r in got)
