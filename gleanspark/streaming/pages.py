"""A paged review service as a Spark data source: ``spark.read.format("review_pages")``, and the same as a stream.

Options: ``url`` (with ``{app_id}`` in it), ``apps`` (ids with commas between), ``language``, ``offTopic``, ``maxReviews`` (of
an app), ``pause`` (seconds between pages).  A row is one record as JSON text with its app, page, time of fetching and, on the
first record that comes with one, the service's summary; ``raw_records`` and ``raw_summaries`` parse them in Spark.

A batch read has a partition for each app.  A stream takes one page of each app a batch; its offset is each app's cursor and
what was fetched so far, so a restart goes on at the cursor.  An app ends with an empty page; with ``maxReviews`` no page is
asked for once that many are there, so the last page may overshoot.  A refused page is an error.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from gleanspark.sources.reviews import RAW_SCHEMA, SUMMARY_SCHEMA, normalize_review, normalize_summary
from gleanspark.streaming.ingest import PAUSE_S, fetch, page_url

FORMAT = "review_pages"
_SCHEMA = "app_id long, page int, fetched_at long, record string, summary string"


class _Service:
    """One page of an app, as rows and the place of the next one."""

    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}  # names of options don't tell cases apart
        self.url, self.language = options["url"], options.get("language", "all")
        self.apps = [int(a) for a in options["apps"].split(",") if a.strip()]
        self.off_topic = options.get("offtopic", "false").lower() == "true"
        self.most = int(options["maxreviews"]) if "maxreviews" in options else None
        self.pause = float(options.get("pause", PAUSE_S))

    def first(self) -> dict:
        return {"cursor": "*", "fetched": 0, "page": 0, "told": False}

    def page(self, app: int, at: dict) -> tuple[list[tuple], dict]:
        """No rows, and the same place, where there is nothing (more) to be had."""
        if self.most is not None and at["fetched"] >= self.most:
            return [], at
        got = fetch(page_url(self.url.format(app_id=app), at["cursor"], self.language, self.off_topic))
        if not got.get("success"):
            raise OSError(f"the service refused app {app}")
        records, summary = got.get("reviews") or [], None if at["told"] else got.get("query_summary") or None
        if not records:
            return [], at
        now = time.time_ns() // 1_000_000
        said = json.dumps(summary, ensure_ascii=False) if summary else None
        rows = [(app, at["page"], now, json.dumps(r, ensure_ascii=False), None if i else said) for i, r in enumerate(records)]
        return rows, {"cursor": got.get("cursor", at["cursor"]), "fetched": at["fetched"] + len(rows), "page": at["page"] + 1, "told": at["told"] or summary is not None}


class _App(InputPartition):
    def __init__(self, app: int) -> None:
        self.app = app


class _Batch(DataSourceReader):
    def __init__(self, service: _Service) -> None:
        self.service = service

    def partitions(self) -> Sequence[InputPartition]:
        return [_App(a) for a in self.service.apps]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at = self.service.first()
        while True:
            rows, to = self.service.page(partition.app, at)
            if not rows:
                return
            yield from rows
            if to["cursor"] == at["cursor"]:  # a service that doesn't go on would be asked for ever
                return
            at = to
            time.sleep(self.service.pause)


class _Stream(SimpleDataSourceStreamReader):
    """Offsets are {app: place}; a page is at most a hundred short records."""

    def __init__(self, service: _Service) -> None:
        self.service, self.asked = service, 0.0

    def initialOffset(self) -> dict:
        return {str(a): self.service.first() for a in self.service.apps}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], {}
        time.sleep(max(0.0, self.asked + self.service.pause - time.monotonic()))
        self.asked = time.monotonic()
        for app in self.service.apps:
            more, to = self.service.page(app, start.get(str(app)) or self.service.first())
            rows += more
            end[str(app)] = to
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for app in self.service.apps:
            at, to = start.get(str(app)) or self.service.first(), end.get(str(app))
            while to and at["page"] < to["page"]:
                rows, at = self.service.page(app, at)
                if not rows:
                    break
                yield from rows


class ReviewPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(_Service(dict(self.options)))

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Stream(_Service(dict(self.options)))


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(ReviewPages)


def raw_records(pages: DataFrame) -> DataFrame:
    """Review rows, normalised, with ``fetched_at``; works on a table of pages and on a stream of them."""
    parsed = pages.select(F.from_json("record", RAW_SCHEMA).alias("r"), "app_id", "fetched_at").select("r.*", F.col("app_id").alias("_app"), F.col("fetched_at").alias("_at"))
    return normalize_review(parsed, F.col("_app"), F.col("_at"))


def raw_summaries(pages: DataFrame) -> DataFrame:
    """Game rows from the pages that came with a summary."""
    told = pages.where("summary IS NOT NULL").select("app_id", F.from_json("summary", SUMMARY_SCHEMA).alias("s")).select(F.col("app_id").alias("_app"), "s.*")
    return normalize_summary(told, F.col("_app"))
