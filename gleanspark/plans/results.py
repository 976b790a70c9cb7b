"""Stored results: JSON by app, type and configuration, a partition for each key, read as VARIANT.

A put replaces its key's partition, so one result stays however many writers there are; should two end at once, the later
counts.  Only JSON objects are results: anything else, malformed text included, is null where it is read.
"""

from __future__ import annotations

import json
import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["app_id", "analysis_type", "config_hash"]
SCHEMA = "language_filter string, result_json string, created_at double, app_id long, analysis_type string, config_hash string"


def object_of(text: Column) -> Column:
    """JSON text as VARIANT if it is an object, else null."""
    parsed = F.try_parse_json(text)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


class ResultStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """All that is stored, with ``result`` as VARIANT."""
        return self.spark.read.schema(SCHEMA).parquet(self.path).withColumn("result", object_of(F.col("result_json")))

    def put_json(self, app_id: int, kind: str, config_hash: str, text: str, language: str = "all") -> None:
        row = self.spark.createDataFrame([(language, text, time.time(), app_id, kind, config_hash)], SCHEMA)
        row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(self.path)

    def put(self, app_id: int, kind: str, config_hash: str, result: dict, language: str = "all") -> None:
        self.put_json(app_id, kind, config_hash, json.dumps(result, ensure_ascii=False), language)

    def of(self, app_id: int, kind: str, config_hash: str | None = None) -> DataFrame:
        """(result, created_at) under one key, or under all configurations of an app and type; reads their partitions only."""
        known = (F.col("app_id") == app_id) & (F.col("analysis_type") == kind)
        rows = self.rows().where(known if config_hash is None else known & (F.col("config_hash") == config_hash))
        return rows.select("result", F.when(F.col("result").isNotNull(), F.col("result_json")).alias("json"), "created_at")

    def _last(self, app_id: int, kind: str, config_hash: str | None = None) -> dict | None:
        try:
            found = self.of(app_id, kind, config_hash).agg(F.max_by("json", "created_at").alias("json")).first()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":  # no result was ever stored
                return None
            raise
        return json.loads(found.json) if found.json else None

    def get(self, app_id: int, kind: str, config_hash: str) -> dict | None:
        return self._last(app_id, kind, config_hash)

    def latest(self, app_id: int, kind: str) -> dict | None:
        """The newest result of an app and type under any configuration; null if that one is no object."""
        return self._last(app_id, kind)
