"""Stateful upserts against the batch ones, and the paged source against a small service."""

from __future__ import annotations

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanspark.operators.upsert import upsert_reviews
from gleanspark.sources.reviews import RAW_SCHEMA, STORED_SCHEMA, normalize_review
from gleanspark.streaming import ingest as I
from gleanspark.streaming import pages as P


def _state(spark, path):
    return sorted(tuple(str(v) for v in r) for r in I.current(spark, path).collect())


def _page_rows(spark, pages):
    """Pages (number, records) as stored rows with seq."""
    rows = [(n, json.dumps(r)) for n, records in pages for r in records]
    raw = spark.createDataFrame(rows, "seq long, record string").select("seq", F.from_json("record", RAW_SCHEMA).alias("r")).select("seq", "r.*")
    return normalize_review(raw, F.lit(7), F.col("seq")).withColumn("seq", F.col("fetched_at"))


def test_replayed_and_reordered_pages(spark, tmp_path):
    rng = random.Random(1)
    pages = []
    for n in range(1, 9):
        ids = rng.sample("abcdefghij", 4)
        pages.append((n, [{"recommendationid": i, "language": f"l{n}", "review": f"text {n}", "votes_up": n, "timestamp_created": n, "voted_up": n % 2 == 0} for i in ids]))
    expected = sorted(tuple(str(v) for v in r) for r in upsert_reviews(_page_rows(spark, pages)).select(*STORED_SCHEMA.fieldNames()).collect())
    order = [3, 0, 7, 1, 3, 6, 2, 5, 4, 0]  # two come again
    schema = T.StructType([*STORED_SCHEMA.fields, T.StructField("seq", T.LongType())])
    source, touched = tmp_path / "in", []
    source.mkdir()
    for step, at in enumerate(order):
        _page_rows(spark, [pages[at]]).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(schema).json(str(source))
        I.kept(stream, f"{tmp_path}/log", f"{tmp_path}/state").awaitTermination()
        changed = spark.read.parquet(f"{tmp_path}/log/batch={step:09d}")
        touched.append({r.recommendation_id for r in changed.collect()})
        assert touched[-1] <= {r["recommendationid"] for r in pages[at][1]}
    assert _state(spark, f"{tmp_path}/state") == expected
    assert not touched[4] and not touched[9]  # pages that come again change nothing


class _Pages(BaseHTTPRequestHandler):
    """Apps 1 to 3 with 5, 2 and 0 pages of 3 records; app 9 is refused."""

    asked: list[tuple[int, str, str]] = []
    size = {1: 5, 2: 2, 3: 0}

    def do_GET(self):
        at, query = urlparse(self.path), parse_qs(urlparse(self.path).query)
        app, cursor = int(at.path.strip("/")), query["cursor"][0]
        self.asked.append((app, cursor, query["language"][0]))
        n = 0 if cursor == "*" else int(cursor[1:])
        found = [{"recommendationid": f"{app}-{n}-{i}", "review": f"ä {n}", "votes_up": i} for i in range(3)] if n < self.size.get(app, 0) else []
        body = {"success": int(app != 9), "reviews": found, "cursor": f"c{n + 1}"} | ({"query_summary": {"total_reviews": 3 * self.size[app], "review_score_desc": "Good"}} if n == 0 and app in self.size else {})
        text = json.dumps(body).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(text)))
        self.end_headers()
        self.wfile.write(text)

    def log_message(self, *args):
        pass


@pytest.fixture
def service(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    _Pages.asked.clear()
    P.register(spark)
    yield {"url": f"http://127.0.0.1:{server.server_port}/{{app_id}}", "pause": "0", "language": "german"}
    server.shutdown()


def test_batch_of_pages(spark, service):
    df = spark.read.format(P.FORMAT).options(**service, apps="1,2,3").load()
    assert df.rdd.getNumPartitions() == 3
    rows = P.raw_records(df).collect()
    assert {r.recommendation_id for r in rows} == {f"{a}-{n}-{i}" for a, k in _Pages.size.items() for n in range(k) for i in range(3)}
    assert all(r.app_id == int(r.recommendation_id[0]) and r.review_text.startswith("ä") and r.fetched_at > 0 for r in rows)
    assert {r[2] for r in _Pages.asked} == {"german"}
    games = sorted((r.app_id, r.total_reviews, r.review_score_desc) for r in P.raw_summaries(df).collect())
    assert games == [(1, 15, "Good"), (2, 6, "Good")]
    # No page is asked for once enough are there: the last one may overshoot.
    _Pages.asked.clear()
    assert len(spark.read.format(P.FORMAT).options(**service, apps="1", maxReviews="4").load().collect()) == 6
    assert [a[1] for a in _Pages.asked] == ["*", "c1"]
    with pytest.raises(PySparkException, match="refused"):
        spark.read.format(P.FORMAT).options(**service, apps="9").load().collect()


def test_stream_of_pages_goes_on_at_the_cursor(spark, service, tmp_path):
    def run():
        df = spark.readStream.format(P.FORMAT).options(**service, apps="1,2", maxReviews="100").load()
        rows = P.raw_records(df).withColumn("seq", F.col("fetched_at"))
        q = I.kept(rows, f"{tmp_path}/log", f"{tmp_path}/state", processingTime="0 seconds")
        q.processAllAvailable()
        q.stop()

    size, _Pages.size = _Pages.size, {1: 2, 2: 1}
    try:
        run()
        assert I.current(spark, f"{tmp_path}/state").count() == 9
        _Pages.asked.clear()
        _Pages.size = {1: 4, 2: 2}
        run()
    finally:
        _Pages.size = size
    assert "*" not in {a[1] for a in _Pages.asked} and (1, "c2", "german") in _Pages.asked
    got = I.current(spark, f"{tmp_path}/state")
    assert got.count() == 18 and got.select("recommendation_id").distinct().count() == 18
