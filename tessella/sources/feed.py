"""A Spark data source over an event endpoint that is read by cursor.

`GET {url}?cursor=ID&limit=N` answers {"next_cursor": ID, "events": [...]} with the
events after that id, in the order of ids.  Ids are the offsets: a read is planned as
ranges of ids of at most `span` each, one task a range, and a task walks its range in
pages of `page` events.  Batch and stream share that reader, so a stream that has seen
everything has the rows of the batch; a restarted stream plans the same ranges again
from its checkpoint and an endpoint that keeps its events answers them alike.

Options: url; page (500 at most); span (ids a task); start (the cursor to begin after).
Use: spark.dataSource.register(EventFeed); spark.read.format("event_feed").option("url", ...).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

EVENT = "id long, run_id string, conference_year_id long, stage string, level string, message string, data_json string, created_at string"
MOST = 500


@dataclass
class IdRange(InputPartition):
    """Events with after < id <= upto."""

    after: int
    upto: int


def request(url: str, after: int, limit: int) -> tuple[int, list[dict]]:
    """One page after a cursor, and the next cursor (the same one where there is no more)."""
    mark = "&" if "?" in url else "?"
    with urlopen(f"{url}{mark}{urlencode({'cursor': after, 'limit': limit})}", timeout=60) as reply:
        page = json.load(reply)
    rows = page.get("events") or []
    return int(rows[-1]["id"]) if rows else after, rows


def walk(url: str, after: int, upto: int, limit: int) -> Iterator[dict]:
    """All events of a range of ids."""
    while after < upto:
        after, rows = request(url, after, limit)
        yield from (r for r in rows if r["id"] <= upto)
        if not rows:
            return


def as_row(event: dict) -> tuple:
    data = event.get("data_json")
    return (event["id"], event.get("run_id"), event.get("conference_year_id"), event.get("stage"), event.get("level"), event.get("message"), data if data is None or isinstance(data, str) else json.dumps(data, sort_keys=True), event.get("created_at"))


class _Plan:
    def __init__(self, options: dict) -> None:
        self.url = options["url"]
        self.page = min(int(options.get("page", MOST)), MOST)
        self.span = int(options.get("span", 20 * self.page))
        self.start = int(options.get("start", 0))

    def last(self, after: int) -> int:
        """The newest id: asked for by doubling steps, then halving, so requests grow with the logarithm of the ids."""
        def any_after(cursor: int) -> bool:
            return bool(request(self.url, cursor, 1)[1])

        if not any_after(after):
            return after
        step = self.span
        while any_after(after + step):
            step *= 2
        lo, hi = after + step // 2 if step > self.span else after, after + step
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if any_after(mid) else (lo, mid)
        return hi

    def ranges(self, after: int, upto: int) -> list[IdRange]:
        return [IdRange(a, min(a + self.span, upto)) for a in range(after, upto, self.span)]

    def rows(self, part: IdRange) -> Iterator[tuple]:
        return (as_row(e) for e in walk(self.url, part.after, part.upto, self.page))


class _Batch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.plan = _Plan(options)

    def partitions(self) -> list[IdRange]:
        return self.plan.ranges(self.plan.start, self.plan.last(self.plan.start)) or [IdRange(self.plan.start, self.plan.start)]

    def read(self, partition: IdRange) -> Iterator[tuple]:
        return self.plan.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.plan = _Plan(options)
        self.known = self.plan.start

    def initialOffset(self) -> dict:
        return {"id": self.plan.start}

    def latestOffset(self) -> dict:
        self.known = self.plan.last(self.known)
        return {"id": self.known}

    def partitions(self, start: dict, end: dict) -> list[IdRange]:
        return self.plan.ranges(start["id"], end["id"])

    def read(self, partition: IdRange) -> Iterator[tuple]:
        return self.plan.rows(partition)

    def commit(self, end: dict) -> None:
        """The endpoint keeps its events, so there is nothing to let go of but older ids to ask from."""
        self.known = max(self.known, end["id"])


class EventFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_feed"

    def schema(self) -> str:
        return EVENT

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)
