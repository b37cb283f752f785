"""Streams in queries, the event feed, and their agreement with tables."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tessella.session import ship
from tessella.sources.feed import EventFeed
from tessella.streaming import events

ROWS = "event_id long, user_id long, event_type string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Six files of events in the order of ids."""
    rng = random.Random(3)
    path = str(tmp_path_factory.mktemp("ev"))
    for k in range(6):
        rows = [(100 * k + i, rng.randrange(7), rng.choice(["view", "click", "purchase", "error", "error", "view", "view"])) for i in range(100)]
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    return f"{path}/events.parquet"


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(*a.columns).collect()), key=str)


def test_streams_come_to_what_tables_have(spark, folder):
    ship(spark)
    table = spark.read.parquet(folder)
    assert same(events.settled(events.heartbeat(events.events_stream(spark, folder)), ["user_id"]), events.heartbeat_batch(table))
    assert same(events.settled(events.heartbeat(events.events_stream(spark, folder)), ["user_id"], "complete"), events.heartbeat_batch(table))
    assert same(events.settled(events.template_memory_stream(events.events_stream(spark, folder)), ["user_id"]), events.template_memory_batch(table))
    for limit in (2, 6, 1000):
        progress = F.col("event_type").isin("click", "purchase")
        with events.state_in_files(spark):
            assert same(events.settled(events.stalls_stream(events.events_stream(spark, folder), progress, limit), ["user_id"]), events.stalls_batch(table, progress, limit))


def test_a_stream_of_nothing(spark, tmp_path):
    spark.createDataFrame([], ROWS).write.parquet(f"{tmp_path}/events.parquet")
    assert events.settled(events.heartbeat(events.events_stream(spark, f"{tmp_path}/events.parquet")), ["user_id"]).count() == 0


@pytest.fixture
def endpoint():
    """An endpoint with gaps between its ids; `store` may grow."""
    store = [{"id": i, "run_id": "r", "stage": "s", "level": "info", "message": f"m{i}", "data_json": {"b": i, "a": None} if i % 2 else None, "created_at": "2024"} for i in (*range(3, 60), 71, *range(200, 230, 3))]
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            after, limit = int(q["cursor"][0]), int(q["limit"][0])
            asked.append((after, limit))
            rows = [e for e in sorted(store, key=lambda e: e["id"]) if e["id"] > after][:limit]
            body = json.dumps({"next_cursor": rows[-1]["id"] if rows else after, "events": rows}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/events", store, asked
    server.shutdown()


def test_feed_reads_all_by_ranges_of_ids(spark, endpoint):
    url, store, asked = endpoint
    ship(spark)
    spark.dataSource.register(EventFeed)
    read = lambda **o: spark.read.format("event_feed").options(url=url, page=7, span=30, **o).load()
    got = sorted((r["id"], r["message"], r["data_json"]) for r in read().collect())
    assert got == [(e["id"], e["message"], e["data_json"] and json.dumps(e["data_json"], sort_keys=True)) for e in store]
    assert read().rdd.getNumPartitions() == -(-store[-1]["id"] // 30) and max(n for _, n in asked) == 7
    assert [r["id"] for r in read(start=71).orderBy("id").collect()] == [e["id"] for e in store if e["id"] > 71]
    assert read(start=10_000).count() == 0


def test_feed_as_a_stream_goes_on_after_a_restart(spark, endpoint, tmp_path):
    url, store, _ = endpoint
    ship(spark)
    spark.dataSource.register(EventFeed)

    def run():
        q = spark.readStream.format("event_feed").options(url=url, page=10, span=50).load().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        return [r["id"] for r in spark.read.parquet(f"{tmp_path}/out").orderBy("id").collect()]

    assert run() == [e["id"] for e in store]
    store.extend({"id": i, "message": "late"} for i in range(300, 420))
    assert run() == [e["id"] for e in store]
    assert run() == [e["id"] for e in store]
