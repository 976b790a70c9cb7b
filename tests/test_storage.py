"""The stored table, stored results, one-file exports and progress."""

from __future__ import annotations

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from gleanspark.functions.text import embedded_counts
from gleanspark.operators.upsert import upsert_reviews
from gleanspark.plans import analysis, progress, report
from gleanspark.plans.results import ResultStore
from gleanspark.sources import reviews as S
from gleanspark.sources.tables import COLUMNS, ReviewTable


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark, tables, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS glean_test LOCATION '%s'" % (tmp_path / "db"))
    t = ReviewTable(spark, "glean_test.reviews", 4)
    t.create(S.reviews(spark, tables, with_vectors=False))
    yield t
    spark.sql("DROP DATABASE glean_test CASCADE")


def _files(tmp_path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(tmp_path / "db") for n in names if n.startswith("part-")}


def test_table_layout(spark, table, tmp_path, tables):
    one = table.of_app(3)
    plan = _plan(one)
    assert "PartitionFilters: [isnotnull(app_id" in plan and one.count() == S.reviews(spark, tables, False).where("app_id = 3").count()
    times = [r.timestamp_created for r in one.collect()]
    assert times == sorted(times, reverse=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in _plan(table.rows().groupBy("recommendation_id").agg(F.max("votes_up")))
        assert "Exchange" not in _plan(table.rows().alias("a").join(table.rows().alias("b"), "recommendation_id").select("a.votes_up", "b.votes_funny"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    before = _files(tmp_path)
    table.delete_app(1)
    after = _files(tmp_path)
    assert after == {f: t for f, t in before.items() if "app_id=1/" not in f} and len(after) < len(before)
    assert table.rows().where("app_id = 1").count() == 0


def test_table_upsert_touches_its_apps(spark, table, tmp_path):
    old = table.rows().where("app_id IN (2, 7) OR recommendation_id = '2'")
    change = old.where("app_id = 2").limit(3).withColumns({"review_text": F.lit("new"), "language": F.lit("other"), "fetched_at": F.lit(5).cast("long")})
    fresh = change.limit(1).withColumns({"recommendation_id": F.lit("new one"), "app_id": F.lit(7).cast("long")})
    changes = change.unionByName(fresh).withColumn("seq", F.lit(5).cast("long"))
    rows = [tuple(r) for r in changes.select(*COLUMNS, "seq").collect()]
    changes = spark.createDataFrame(rows, changes.select(*COLUMNS, "seq").schema)
    expected = sorted(map(str, upsert_reviews(table.rows().withColumn("seq", F.lit(0).cast("long")).unionByName(changes)).select(*COLUMNS).collect()))
    before = _files(tmp_path)
    table.upsert(changes)
    after = _files(tmp_path)
    assert sorted(map(str, table.rows().select(*COLUMNS).collect())) == expected
    assert {f: t for f, t in before.items() if "app_id=2/" not in f}.items() <= after.items()
    got = table.rows().where("review_text = 'new' AND app_id = 2").collect()
    assert len(got) == 3 and all(r.language != "other" and r.fetched_at == 5 for r in got)


def test_results(spark, tmp_path):
    store = ResultStore(spark, f"{tmp_path}/results")
    assert store.get(1, "topics", "h") is None
    store.put(1, "topics", "h", {"k": 1})
    store.put(1, "topics", "h", {"k": 2, "name": "ä"})
    store.put(1, "topics", "other", {"k": 3})
    store.put(2, "topics", "h", {"k": 4})
    assert store.get(1, "topics", "h") == {"k": 2, "name": "ä"} and store.latest(1, "topics") == {"k": 3} and store.get(9, "topics", "h") is None
    assert store.rows().count() == 3  # a put replaces
    assert "PartitionFilters: [isnotnull(app_id" in _plan(store.of(1, "topics", "h"))
    for text in ("[1]", "{", "7", "null", ""):
        store.put_json(3, "topics", "h", text)
        assert store.get(3, "topics", "h") is None
    ks = store.rows().where("result IS NOT NULL").select(F.try_variant_get("result", "$.k", "int").alias("k")).collect()
    assert sorted(r.k for r in ks) == [2, 3, 4]
    writers = [threading.Thread(target=store.put, args=(5, "topics", "h", {"k": k})) for k in (1, 2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert store.get(5, "topics", "h") in ({"k": 1}, {"k": 2})


def test_one_csv_of_many_parts(spark, tables, tmp_path):
    rows = S.reviews(spark, tables, with_vectors=False).withColumn("review_text", F.concat("review_text", F.lit(' "q",\n')))
    report.export_one_csv(rows, f"{tmp_path}/all.csv")
    listed = sorted(rows.collect(), key=lambda r: (-r.timestamp_created, r.recommendation_id))
    lines = [",".join(['"' + r[c].replace('"', '""') + '"' if c == "review_text" else str(r[c]) for c in report.CSV_COLUMNS]) for r in listed]
    with open(f"{tmp_path}/all.csv", encoding="utf-8", newline="") as f:
        assert f.read() == "\ufeff" + "\n".join([",".join(report.CSV_COLUMNS), *lines])
    assert [n for n in os.listdir(tmp_path) if "parts" in n] == []
    report.export_one_csv(rows.where("false"), f"{tmp_path}/none.csv")
    with open(f"{tmp_path}/none.csv", encoding="utf-8", newline="") as f:
        assert f.read() == "\ufeff" + ",".join(report.CSV_COLUMNS)


def test_progress_of_an_analysis(spark, tables):
    events = []
    analysis.run_analysis(S.reviews(spark, tables), {"n_topics": 3, "topicCountMode": "manual"}, events.append)
    percents = [e["percent"] for e in events]
    assert percents == sorted(percents) and percents[0] == 10 and percents[-1] == 100 and len(set(percents)) > 5
    assert {"embedding", "clustering", "keywords", "complete"} <= {e["stage"] for e in events} and all(e["elapsed_ms"] >= 0 for e in events)
    assert not spark.sparkContext.getJobTags()


def test_a_tag_ends_an_analysis(spark):
    failed = []

    def run():
        try:
            with progress.Progress(spark, None, "stop-me"):
                spark.range(0, 8, 1, 4).mapInPandas(lambda batches: (b for b in batches if time.sleep(60) is None), "id long").count()
        except Exception as e:
            failed.append(str(e))

    runner = threading.Thread(target=run)
    began = time.monotonic()
    runner.start()
    time.sleep(3)
    progress.cancel(spark, "stop-me")
    runner.join(30)
    assert not runner.is_alive() and failed and time.monotonic() - began < 40


def test_progress_of_a_stream(spark, tables, tmp_path):
    events = []
    listener = progress.StreamProgress(events.append, total=1000)
    spark.streams.addListener(listener)
    try:
        rows = spark.readStream.schema(spark.read.parquet(f"{tables}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(tables)
        q = rows.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        deadline = time.monotonic() + 10
        while (not events or events[-1]["stage"] != "complete") and time.monotonic() < deadline:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    percents = [e["percent"] for e in events]
    assert percents == sorted(percents) and events[-1]["percent"] == 100 and events[-1]["fetched"] == 1000 and events[0]["message"] == "started"


def test_embedded_counts(spark):
    said = spark.createDataFrame([("Embedded 1,234/5,678 reviews",), ("Embedded 64 / 128",), ("Clustering",), ("Embedded /5",)], "m string")
    assert [None if r.c is None else tuple(r.c) for r in said.select(embedded_counts(F.col("m")).alias("c")).collect()] == [(1234, 5678), (64, 128), None, None]
