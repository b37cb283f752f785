"""Speaker records from loosely typed JSON, as columns over VARIANT values.

A payload is an object with a list `records`, or a list; each object in it becomes a
record if it names a person.  Values of any type are read as text, missing and
unusable ones get their defaults, texts and lists are cut to their limits.  Two
forms differ in defaults and limits: EXTRACTION and REASONING.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import collapse


@dataclass(frozen=True)
class Form:
    """Defaults and limits of a form; own_names: aliases equal to the name stay; checked: names must look like a person's."""

    confidence: float
    session: int
    evidence: int
    targets: int
    own_names: bool
    checked: bool


EXTRACTION = Form(0.70, 220, 800, 6, own_names=False, checked=True)
REASONING = Form(0.65, 240, 900, 8, own_names=True, checked=False)

TARGET = "struct<conference_name: string, year: int, confidence: double, reason: string>"


def member(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def kind_of(v: Column) -> Column:
    """STRING, BOOLEAN, BIGINT, DECIMAL(...), DOUBLE, ARRAY<...>, OBJECT<...> or VOID; null where there is no value."""
    return F.schema_of_variant(v)


def as_text(v: Column, none: Column | None = None) -> Column:
    """A value's text; `none` for null."""
    text = F.try_variant_get(v, "$", "string")
    return F.when(v.isNull() | F.is_variant_null(v), none if none is not None else F.lit(None).cast("string")).when(kind_of(v) == "BOOLEAN", F.initcap(text)).otherwise(text)


def filled(v: Column) -> Column:
    """Whether a value counts as given: neither null nor false, zero, nor empty."""
    kind, text = kind_of(v), F.try_variant_get(v, "$", "string")
    number = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE")
    empty = F.when(kind == "STRING", text == "").when(kind == "BOOLEAN", text == "false").when(number, F.try_variant_get(v, "$", "double") == 0).otherwise(text.isin("[]", "{}"))
    return ~(v.isNull() | F.is_variant_null(v)) & ~F.coalesce(empty, F.lit(False))


def given(v: Column, *names: str) -> Column:
    """White-space-collapsed text of the first member that is given; empty if none is."""
    return collapse(F.coalesce(*[F.when(filled(member(v, n)), as_text(member(v, n))) for n in names], F.lit("")))


def clip(text: Column, most: int) -> Column:
    """At most so many characters; null if empty."""
    return F.nullif(F.substring(text, 1, most), F.lit(""))


def number(v: Column, default: float) -> Column:
    """A confidence between 0 and 1 from a number, a truth value or a number's text."""
    kind = kind_of(v)
    text = F.when(kind == "STRING", F.trim(F.try_variant_get(v, "$", "string")).try_cast("double"))
    truth = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
    value = F.coalesce(text, truth, F.when(~kind.startswith("ARRAY") & ~kind.startswith("OBJECT") & ~kind.isin("STRING", "BOOLEAN"), F.try_variant_get(v, "$", "double")), F.lit(default))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def elements(v: Column) -> Column:
    """A list's values, else none."""
    return F.coalesce(F.when(kind_of(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))


def targets(v: Column, most: int) -> Column:
    """The valid conference targets: a name, a year from 1990 to 2100, a confidence from 0 to 1, a reason or none."""
    def one(t: Column) -> Column:
        name, reason = member(t, "conference_name"), member(t, "reason")
        year = F.try_variant_get(t, "$.year", "double")
        year = F.coalesce(year, F.trim(F.try_variant_get(t, "$.year", "string")).try_cast("int").cast("double"))
        sure = F.coalesce(F.try_variant_get(t, "$.confidence", "double"), F.trim(F.try_variant_get(t, "$.confidence", "string")).try_cast("double"))
        fine = kind_of(t).startswith("OBJECT") & (kind_of(name) == "STRING") & (year == F.floor(year)) & year.between(1990, 2100) & sure.between(0, 1) & (reason.isNull() | F.is_variant_null(reason) | (kind_of(reason) == "STRING"))
        return F.when(fine, F.struct(as_text(name).alias("conference_name"), year.cast("int").alias("year"), sure.alias("confidence"), as_text(reason).alias("reason")))

    return F.slice(F.filter(F.transform(elements(v), one), lambda t: t.isNotNull()), 1, most)


def names_no_person(name: Column) -> Column:
    low = F.lower(name)
    n = F.size(F.split(low, " "))
    return low.rlike("|".join(K.NON_PERSON_PHRASES)) | ~n.between(2, 5) | ~low.rlike("[a-z]")


def record(v: Column, form: Form) -> Column:
    """The record of an object, or null."""
    name = given(v, "full_name", "name")
    designation = F.coalesce(clip(collapse(as_text(member(v, "designation"))), 80) if form.checked else clip(given(v, "designation"), 80), F.lit(None))
    flag = member(v, "is_physician_candidate")
    credential = F.coalesce(designation.rlike(K.CREDENTIAL_WORD), F.lit(False))
    if form.checked:
        physician = F.when(kind_of(flag) == "BOOLEAN", F.try_variant_get(flag, "$", "boolean")).otherwise(credential)
    else:
        physician = F.when(flag.isNull(), True).otherwise(filled(flag))
    aliases = F.transform(elements(member(v, "aliases")), lambda a: collapse(as_text(a, F.lit("None" if form.checked else ""))))
    kept = F.filter(aliases, lambda a: (a != "") & (F.lit(form.own_names) | (F.lower(a) != F.lower(name))))
    out = F.struct(
        name.alias("full_name"),
        designation.alias("designation"),
        *[clip(given(v, c), most).alias(c) for c, most in (("affiliation", 180), ("location", 120), ("role", 120), ("session_title", form.session), ("talk_brief_extracted", 600))],
        F.slice(F.transform(kept, lambda a: F.substring(a, 1, 140)), 1, 10).alias("aliases"),
        physician.alias("is_physician_candidate"),
        number(member(v, "confidence"), form.confidence).alias("confidence"),
        clip(given(v, "evidence_span"), form.evidence).alias("evidence_span"),
        targets(member(v, "attribution_targets"), form.targets).alias("attribution_targets"),
    )
    good = kind_of(v).startswith("OBJECT") & (name != "")
    return F.when(good & ~names_no_person(name) if form.checked else good, out)


def records(payload: Column, form: Form = EXTRACTION) -> Column:
    """The records of a JSON text, in order; none where it can't be read."""
    v = F.try_parse_json(payload)
    raw = F.when(kind_of(v).startswith("OBJECT"), elements(member(v, "records"))).otherwise(elements(v))
    return F.filter(F.transform(F.coalesce(raw, F.array().cast("array<variant>")), lambda r: record(r, form)), lambda r: r.isNotNull())
