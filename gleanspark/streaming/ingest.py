"""Incremental ingest of pages of raw reviews, and trends over a stream."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from gleanspark.operators.upsert import MUTABLE
from gleanspark.sources.reviews import RAW_SCHEMA, STORED_SCHEMA, normalize_review

PAGE_ROWS, PAUSE_S, TRIES = 100, 0.5, 3


def fetch(url: str, opener: Callable = urlopen, sleep: Callable = time.sleep) -> dict:
    """JSON from a URL, with three tries and growing pauses."""
    for n in range(TRIES):
        try:
            with opener(url) as reply:
                return json.loads(reply.read())
        except OSError:
            if n == TRIES - 1:
                raise
            sleep(2**n + random.random())
    raise AssertionError


def pages(get: Callable[[str], dict], most: int | None = None, sleep: Callable = time.sleep) -> Iterator[list[dict]]:
    """Pages of raw records by cursor, until one is empty or ``most`` are there before a page is asked for."""
    cursor, n = "*", 0
    while most is None or n < most:
        page = get(cursor)
        if not page.get("reviews"):
            return
        yield page["reviews"]
        n += len(page["reviews"])
        cursor = page.get("cursor", cursor)
        sleep(PAUSE_S)


def page_url(base: str, cursor: str = "*", language: str = "all", off_topic: bool = False) -> str:
    """The address of a page of an app's newest reviews; without ``off_topic`` the service leaves such ones out."""
    asked = {"json": 1, "filter": "recent", "language": language, "num_per_page": PAGE_ROWS, "cursor": cursor, "filter_offtopic_activity": int(not off_topic)}
    return f"{base}?{urlencode(asked)}"


def fetch_reviews(base: str, get: Callable[[str], dict] = fetch, language: str = "all", off_topic: bool = False, most: int | None = None, progress: Callable[[dict], None] | None = None, sleep: Callable = time.sleep) -> Iterator[tuple[list[dict], dict | None]]:
    """(records, summary) of every page; the summary comes with the first page that has one.  A refused page raises."""
    total, n, told = 0, 0, False
    summary: dict | None = None

    def ask(cursor: str) -> dict:
        nonlocal summary
        page = get(page_url(base, cursor, language, off_topic))
        if not page.get("success"):
            raise OSError(f"the service refused {base}")
        summary = page.get("query_summary") or None
        ask.cursor = page.get("cursor", cursor)
        return page

    for records in pages(ask, most, sleep):
        first = None if told else summary
        if first:
            told, total = True, int(first.get("total_reviews") or 0)
        n += len(records)
        if progress:
            progress({"fetched": n, "total": total, "cursor": ask.cursor})
        yield records, first


_ROW = T.StructType([*STORED_SCHEMA.fields, T.StructField("first_seq", T.LongType()), T.StructField("last_seq", T.LongType())])
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Sightings(StatefulProcessor):
    """The state of a review: what its first sighting fixed and what its last one said, each with that sighting's number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", _ROW)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: TimerValues) -> Iterator[Row]:
        held = dict(zip(_ROW.fieldNames(), self.row.get(), strict=True)) if self.row.exists() else None
        before = dict(held) if held else None
        for r in rows:
            new = r.asDict()
            seq = new.pop("seq")
            if held is None:
                held = new | {"first_seq": seq, "last_seq": seq}
                continue
            if seq < held["first_seq"]:
                held |= {k: v for k, v in new.items() if k not in MUTABLE} | {"first_seq": seq}
            if seq >= held["last_seq"]:
                held |= {k: v for k, v in new.items() if k in MUTABLE} | {"last_seq": seq}
        if held != before:
            self.row.update(tuple(held[c] for c in _ROW.fieldNames()))
            yield Row(**held)

    def close(self) -> None:
        pass


def upserted(rows: DataFrame) -> DataFrame:
    """A stream of stored review rows with ``seq``, as a stream of the merged rows of the reviews that each batch changes.

    The state is keyed by id and kept in RocksDB, so a batch touches its own keys only, and sightings may come twice or out of
    order: the columns of the smallest and the largest ``seq`` count, as in ``upsert_reviews``.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    needed = rows.select(*STORED_SCHEMA.fieldNames(), "seq")
    return needed.groupBy("recommendation_id").transformWithState(_Sightings(), _ROW, "Update", "None")


def kept(rows: DataFrame, log: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Run the upserts of ``rows``: the state is in ``checkpoint``, and what each batch changed in a folder of ``log``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number:09d}")

    return upserted(rows).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest(spark: SparkSession, source: str, log: str, checkpoint: str, app_id: int) -> StreamingQuery:
    """Take up all new page files (JSON lines); a file's time says when its page was fetched."""
    stream = spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", 1000).json(source)
    at = F.unix_millis(F.col("_metadata.file_modification_time"))
    rows = normalize_review(stream.withColumn("_at", at), F.lit(app_id), F.col("_at"))
    return kept(rows.withColumn("seq", F.col("fetched_at")), log, checkpoint)


def current(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All reviews after the last batch, read from the state itself: first sightings' fixed columns, last ones' others."""
    state = spark.read.format("statestore").option("stateVarName", "row").load(checkpoint)
    return state.select("value.*").select(*STORED_SCHEMA.fieldNames())


def event_trend(events: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by window and type with a watermark: an extension for streams, equal to the batch result on a table."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def app_name(app_id: int, get: Callable[[int], str]) -> str:
    """The name that a look-up gives, or a plain one where it fails."""
    try:
        return get(app_id) or f"App {app_id}"
    except (OSError, ValueError, KeyError):
        return f"App {app_id}"
