"""URL features as column expressions.

Parts are taken with anchored regular expressions, never parse_url, so dirty input
gives empty parts instead of errors.  All functions map null to null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def segments(url: Column) -> Column:
    """Non-empty path segments."""
    return F.array_remove(F.split(path(url), "/"), "")


def registrable(url: Column) -> Column:
    """The last two host labels (all, if fewer)."""
    labels = F.array_remove(F.split(host(url), r"\."), "")
    return F.array_join(F.when(F.size(labels) <= 2, labels).otherwise(F.slice(labels, -2, 2)), ".")


def same_site(a: Column, b: Column) -> Column:
    return registrable(a) == registrable(b)


def _trimmed(p: Column) -> Column:
    return F.when(p == "", "/").when((p != "/") & p.endswith("/"), F.regexp_replace(p, "/$", "")).otherwise(p)


def decode(x: Column) -> Column:
    """Form-decoded text: + is a blank, %XX a byte of UTF-8; a % without two digits stays, broken bytes become U+FFFD."""
    return F.url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))


def encode(x: Column) -> Column:
    """Form-encoded text: letters, digits and -._~ stay, blanks become +, all else the bytes of its UTF-8."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def parameters(query: Column) -> Column:
    """Decoded (key, value) pairs of a query, in order; those without a value are left out."""
    pairs = F.filter(F.split(query, "&"), lambda kv: F.regexp_extract(kv, "(?s)^[^=]*=(.*)$", 1) != "")
    return F.transform(pairs, lambda kv: F.struct(decode(F.substring_index(kv, "=", 1)).alias("key"), decode(F.regexp_extract(kv, "(?s)^[^=]*=(.*)$", 1)).alias("value")))


def canonical(url: Column) -> Column:
    """Run variant: one slash in a row, no trailing slash nor parameters of the last segment; the query's
    pairs decoded, without tracking ones, sorted and encoded again."""
    u = F.trim(url)
    kept = F.filter(parameters(query(u)), lambda kv: ~(F.lower(kv["key"]).startswith(K.TRACKING_PREFIX) | F.lower(kv["key"]).isin(K.TRACKING_KEYS)))
    q = F.array_join(F.transform(F.array_sort(kept), lambda kv: F.concat(encode(kv["key"]), F.lit("="), encode(kv["value"]))), "&")
    plain = F.regexp_replace(path(u), ";[^/]*$", "")
    base = F.concat(F.when(scheme(u) == "", "https").otherwise(scheme(u)), F.lit("://"), host(u), _trimmed(F.regexp_replace(plain, "/{2,}", "/")))
    return F.concat(base, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))


def without_dots(path: Column, squeeze: Column) -> Column:
    """A path with . and .. segments resolved, in one pass over a stack of segments; empty inner ones go where `squeeze` holds."""
    def fold(parts: Column) -> Column:
        inner = F.filter(parts, lambda s, i: ~squeeze | (s != "") | (i == 0) | (i == F.size(parts) - 1))
        stack = F.aggregate(
            inner,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)),
        )
        return F.array_join(F.when(F.element_at(inner, -1).isin(".", ".."), F.array_append(stack, F.lit(""))).otherwise(stack), "/")

    out = F.get(F.transform(F.array(F.split(path, "/")), fold), F.lit(0))
    return F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))


def resolve(base: Column, href: Column, fragment: bool = True) -> Column:
    """http(s) URL that a link on the page `base` means; null for other schemes and empty links."""
    h = F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    mark = F.regexp_extract(h, "(?s)(#.+)$", 1) if fragment else F.lit("")
    h = F.regexp_replace(h, "(?s)#.*$", "")
    own, asked = F.regexp_extract(h, r"(?s)^([^?]*)", 1), F.regexp_extract(h, r"(?s)^[^?]*(\?.*)$", 1)
    root = F.concat(scheme(base), F.lit("://"), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    asked = F.when(asked == "?", "").otherwise(asked)
    joined = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
    same_page = F.concat(root, path(base), F.when(asked != "", asked).when(query(base) != "", F.concat(F.lit("?"), query(base))).otherwise(""))
    full = (
        F.when(F.regexp_replace(href, r"[\x00-\x20]+", "") == "", F.lit(None))
        .when(h.rlike("^(?i)https?://"), h)
        .when(h.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*:"), F.lit(None))
        .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), F.regexp_replace(h, r"\?$", "")))
        .when(own == "", same_page)
        .otherwise(F.concat(root, without_dots(joined, ~own.startswith("/")), asked))
    )
    return F.when(full.rlike("^(?i)https?://"), F.concat(full, mark))


def canonical_interaction(url: Column) -> Column:
    """Interaction variant: the query goes altogether."""
    u = F.trim(url)
    return F.concat(F.when(scheme(u) == "", "https").otherwise(scheme(u)), F.lit("://"), host(u), _trimmed(F.regexp_replace(path(u), "/{2,}", "/")))


def canonical_reasoner(url: Column) -> Column:
    """Reasoner variant: raw query kept, slashes as they are."""
    q = query(url)
    base = F.concat(F.when(scheme(url) == "", "https").otherwise(scheme(url)), F.lit("://"), host(url), _trimmed(path(url)))
    return F.concat(base, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))


def template_full(url: Column) -> Column:
    """Path with numbers, UUIDs and long hex segments replaced."""

    def one(s: Column) -> Column:
        v = F.lower(F.trim(s))
        return F.when(v.rlike(r"^\d+$"), "{num}").when(v.rlike(K.UUID), "{uuid}").when(v.rlike("^[0-9a-f]{10,}$"), "{id}").otherwise(v)

    return F.concat(F.lit("/"), F.array_join(F.transform(segments(url), one), "/"))


def _template(url: Column, most: int) -> Column:
    def one(s: Column) -> Column:
        v = F.lower(s)
        return F.when(v.rlike(r"^\d+$"), "{num}").when(v.rlike("^[0-9a-f-]{8,}$"), "{id}").otherwise(v)

    return F.concat(F.lit("/"), F.array_join(F.slice(F.transform(segments(url), one), 1, most), "/"))


def template_hint(url: Column) -> Column:
    return _template(url, 5)


def template_key(url: Column) -> Column:
    return _template(url, 6)


def branch(url: Column) -> Column:
    return F.concat(host(url), F.lit("::"), template_full(url))


def prefix(url: Column, depth: int = 2) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.slice(F.transform(segments(url), F.lower), 1, depth), "/"))


def primary_section(url: Column) -> Column:
    return F.coalesce(F.get(F.transform(segments(url), F.lower), F.lit(0)), F.lit(""))


def contains_any(text: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def is_pdf_like(url: Column) -> Column:
    return contains_any(F.lower(url), ["pdf", "brochure"])


def source_category(url: Column) -> Column:
    u = F.lower(url)
    return F.when(u.contains("pdf"), "pdf_program").when(contains_any(u, K.SPEAKER_TERMS), "official_speakers").when(contains_any(u, K.PROGRAM_TERMS), "official_program").when(contains_any(u, K.PLATFORM_CATEGORY), "platform").otherwise("unknown")


def fetch_method(url: Column, content_type: Column | None = None) -> Column:
    hint = F.lit(False) if content_type is None else F.coalesce(F.lower(content_type).contains("pdf"), F.lit(False))
    return F.when(F.lower(url).endswith(".pdf") | hint, "pdf_text").when(contains_any(F.lower(url), K.PLATFORM_HOSTS), "playwright_network").otherwise("http_static")


def content_type(raw: Column, url: Column) -> Column:
    r = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(r.contains("application/pdf") | F.lower(url).endswith(".pdf"), "pdf").when(r.contains("json"), "json").when(r.contains("html") | (r == ""), "html").otherwise("unknown")


def is_valid(url: Column) -> Column:
    return url.rlike("^(?i)https?://[^/?#]+")


def event_name(url: Column) -> Column:
    """Title-cased last path segment that is not a generic word, a number or an id; null without one."""
    skip = ["events", "event", "program", "agenda", "schedule", "index", "details"]
    good = F.filter(F.reverse(segments(url)), lambda s: ~F.lower(s).isin(skip) & ~F.lower(s).rlike(r"^\d+$") & ~F.lower(s).rlike("^[0-9a-f-]{8,}$") & s.rlike("[a-zA-Z0-9]"))
    return F.get(F.transform(good, lambda s: F.initcap(F.trim(F.regexp_replace(s, "[^a-zA-Z0-9]+", " ")))), F.lit(0))
