"""JSON from model replies: raw, fenced, or the outermost braces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first(candidates: list[Column], shape: str) -> Column:
    bare = [F.regexp_replace(c, r"^\s+|\s+$", "") for c in candidates]
    tries = [F.when(F.try_parse_json(c).isNotNull() & c.startswith(shape[0]), c) for c in bare]
    return F.coalesce(*tries)


def json_object(text: Column) -> Column:
    """An object's text, or null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return _first([text, fenced, braces], "{")


def json_payload(text: Column) -> Column:
    """An object's or array's text, or null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.coalesce(json_object(text), _first([text, fenced, F.regexp_extract(text, r"(?s)(\[.*\])", 1)], "["))


def message_text(reply: Column) -> Column:
    """Content, or the reasoning where content is blank."""
    return F.coalesce(F.nullif(F.trim(F.get_json_object(reply, "$.content")), F.lit("")), F.nullif(F.trim(F.get_json_object(reply, "$.reasoning_content")), F.lit("")), F.lit(""))
