"""Table functions for SQL: what walks nesting, as LATERAL joins.

`register` gives a session page_elements(html), json_nodes(text) and
session_pairs_raw(text).  They yield rows for one row; shapes, limits and first-of-
equals rules are left to SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..session import ship
from . import dom, extract


class PageElements:
    def eval(self, html: str) -> Iterator[tuple]:
        text, _, rows = dom.tree(html or "")
        for r in rows:
            yield r["id"], r["parent"], r["last"], r["tag"], r["cls"], r["framed"], text[r["start"] : r["end"]]


class JsonNodes:
    def eval(self, text: str) -> Iterator[tuple]:
        yield from enumerate(extract.json_nodes(text or ""))


class SessionPairs:
    def eval(self, text: str) -> Iterator[tuple]:
        for pos, (session, speaker) in enumerate(extract.raw_pairs(text or "")):
            yield pos, session, speaker


def register(spark: SparkSession) -> None:
    ship(spark)
    for name, handler, schema in (
        ("page_elements", PageElements, "id int, parent int, last int, tag string, cls string, framed boolean, text string"),
        ("json_nodes", JsonNodes, "pos int, node string"),
        ("session_pairs_raw", SessionPairs, "pos int, session string, speaker string"),
    ):
        spark.udtf.register(name, udtf(handler, returnType=schema))
