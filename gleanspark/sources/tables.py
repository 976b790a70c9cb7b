"""The stored reviews as a table: a partition for each app, buckets by review id, newest first inside.

A filter on the app reads one partition, aggregates and joins by id need no shuffle, and a delete or an upsert touches only the
partitions of the apps that it names.  An app's rows are spread over all buckets, so a large app is no larger task than others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.operators.upsert import upsert_reviews
from gleanspark.sources.reviews import STORED_SCHEMA
from gleanspark.sources.storage import discard, stored

BUCKETS = 16
#: Lists of apps up to this long are broadcast.
BROADCAST_APPS = 100_000
#: Columns of the table; that of the partition comes last.
COLUMNS = [c for c in STORED_SCHEMA.fieldNames() if c != "app_id"] + ["app_id"]


class ReviewTable:
    """Reviews of all apps under one name in the session's catalog."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS) -> None:
        self.spark, self.name, self.buckets = spark, name, buckets

    def create(self, reviews: DataFrame) -> None:
        """A new table of ``reviews``; a column that they lack is null."""
        rows = reviews if "fetched_at" in reviews.columns else reviews.withColumn("fetched_at", F.lit(None).cast("long"))
        dealt = rows.select(*COLUMNS).repartition(self.buckets, "recommendation_id")
        writer = dealt.write.format("parquet").partitionBy("app_id").bucketBy(self.buckets, "recommendation_id").sortBy("timestamp_created")
        writer.option("partitionOverwriteMode", "dynamic").saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def of_app(self, app_id: int) -> DataFrame:
        """One app's reviews, newest first."""
        return self.rows().where(F.col("app_id") == app_id).orderBy(F.col("timestamp_created").desc(), "recommendation_id")

    def upsert(self, changes: DataFrame) -> None:
        """Merge ``changes`` (stored columns and ``seq``, as for ``upsert_reviews``); other apps' partitions stay as they are.

        What is stored came before all changes.  A review stays with its app.
        """
        changes = stored(changes.select(*COLUMNS, "seq"), "changes")
        apps = changes.select("app_id").distinct()
        few = apps.limit(BROADCAST_APPS + 1).count() <= BROADCAST_APPS
        old = self.rows().join(F.broadcast(apps) if few else apps, "app_id", "left_semi")
        both = old.select(*COLUMNS, F.lit(-(2**63)).alias("seq")).unionByName(changes)
        # Stored first, as a table can't be read while it is overwritten.
        merged = stored(upsert_reviews(both).select(*COLUMNS), "merged")
        merged.repartition(self.buckets, "recommendation_id").write.mode("overwrite").insertInto(self.name)
        discard(changes, merged)

    def delete_app(self, app_id: int) -> None:
        """One partition goes; nothing else is read or written."""
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (app_id = {int(app_id)})")
