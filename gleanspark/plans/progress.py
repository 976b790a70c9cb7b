"""Progress of analyses and streams as events: percent, message, stage and milliseconds since the start.

Within a phase of an analysis the percent comes from Spark's own stages: of those that its jobs have begun, how many tasks
are done.  Percents never fall.  All jobs of an analysis bear a tag, so that ``cancel`` ends them from another thread.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent

EVERY_S = 0.25
Tell = Callable[[dict[str, Any]], None]


class Progress:
    """A context in which Spark's jobs are tagged and watched; ``phase`` says where the analysis is."""

    def __init__(self, spark: SparkSession, tell: Tell | None = None, tag: str | None = None) -> None:
        self.spark, self.tell, self.tag = spark, tell, tag or f"analysis-{uuid.uuid4().hex}"
        self.began, self.lock, self.over = time.monotonic(), threading.Lock(), threading.Event()
        self.low = self.high = self.percent = 0
        self.message = self.stage = ""
        self.seen: set[int] = set()

    def __enter__(self) -> Progress:
        self.spark.sparkContext.addJobTag(self.tag)
        self.group = self.spark.sparkContext.getLocalProperty("spark.jobGroup.id")
        self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", self.tag)
        self.watch = threading.Thread(target=self._watch, daemon=True)
        if self.tell:
            self.watch.start()
        return self

    def __exit__(self, *failed: object) -> None:
        self.over.set()
        if self.tell:
            self.watch.join()
        self.spark.sparkContext.removeJobTag(self.tag)
        self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", self.group)

    def phase(self, percent: int, message: str, stage: str, upto: int | None = None) -> None:
        """A new phase begins at ``percent``; its jobs carry it on towards ``upto``."""
        with self.lock:
            self.low, self.high, self.message, self.stage = percent, upto or percent, message, stage
            self.seen = set(self.spark.sparkContext.statusTracker().getJobIdsForGroup(self.tag))
            self._say(percent)

    def _say(self, percent: int) -> None:
        self.percent = max(self.percent, percent)
        if self.tell:
            self.tell({"percent": self.percent, "message": self.message, "stage": self.stage, "elapsed_ms": round(1000 * (time.monotonic() - self.began))})

    def done_share(self) -> float:
        """Of the tasks of the stages that this phase's jobs have, the share that is done."""
        tracker = self.spark.sparkContext.statusTracker()
        jobs = [j for i in set(tracker.getJobIdsForGroup(self.tag)) - self.seen if (j := tracker.getJobInfo(i))]
        stages = [s for j in jobs for i in j.stageIds if (s := tracker.getStageInfo(i))]
        total = sum(s.numTasks for s in stages)
        return sum(s.numCompletedTasks for s in stages) / total if total else 0.0

    def _watch(self) -> None:
        while not self.over.wait(EVERY_S):
            share = self.done_share()
            with self.lock:
                now = int(self.low + (self.high - self.low) * share)
                if now > self.percent:
                    self._say(now)


def cancel(spark: SparkSession, tag: str) -> None:
    """End the jobs of the analysis that runs under a tag; it fails with Spark's error of a cancelled job."""
    spark.sparkContext.cancelJobsWithTag(tag)


class StreamProgress(StreamingQueryListener):
    """Tells of each batch of a stream: how many rows came so far, and of ``total`` how much that is."""

    def __init__(self, tell: Tell, total: int | None = None) -> None:
        self.tell, self.total, self.began, self.rows = tell, total, time.monotonic(), {}

    def _say(self, query: str, message: str, stage: str, percent: int | None = None) -> None:
        rows = self.rows.get(query, 0)
        if percent is None:
            percent = min(99, 100 * rows // self.total) if self.total else 0
        self.tell({"percent": percent, "message": message, "stage": stage, "fetched": rows, "elapsed_ms": round(1000 * (time.monotonic() - self.began))})

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self._say(str(event.runId), "started", "ingest")

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        self.rows[str(p.runId)] = self.rows.get(str(p.runId), 0) + max(0, p.numInputRows)
        self._say(str(p.runId), f"batch {p.batchId}", "ingest")

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        failed = event.exception is not None
        self._say(str(event.runId), event.exception.splitlines()[0] if failed else "done", "failed" if failed else "complete", None if failed else 100)
