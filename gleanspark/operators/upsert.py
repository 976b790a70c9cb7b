"""Upserts and deletes as aggregates and anti-joins over numbered batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns that a later sighting of a review overwrites; all others keep their first value.
MUTABLE = ["review_text", "voted_up", "timestamp_updated", "votes_up", "votes_funny", "weighted_vote_score", "comment_count", "fetched_at"]


def upsert(rows: DataFrame, key: str, mutable: list[str], seq: str = "seq") -> DataFrame:
    """One row per key: immutable columns from its first sighting by ``seq``, mutable ones from its last."""
    rest = [c for c in rows.columns if c not in (key, seq)]
    first, last = [c for c in rest if c not in mutable], [c for c in rest if c in mutable]
    kept = []
    if first:
        kept.append(F.min_by(F.struct(*first), seq).alias("_first"))
    if last:
        kept.append(F.max_by(F.struct(*last), seq).alias("_last"))
    out = rows.groupBy(key).agg(*kept)
    return out.select(key, *[F.col(f"_{'last' if c in mutable else 'first'}.{c}").alias(c) for c in rest])


def upsert_reviews(rows: DataFrame) -> DataFrame:
    return upsert(rows, "recommendation_id", MUTABLE)


def upsert_games(rows: DataFrame) -> DataFrame:
    """The first fetch time stays, everything else is overwritten; a blank name never replaces one."""
    named = rows.withColumn("app_name", F.nullif(F.col("app_name"), F.lit("")))
    other = [c for c in rows.columns if c not in ("app_id", "seq", "app_name", "first_fetched_at")]
    return named.groupBy("app_id").agg(
        F.coalesce(F.max_by("app_name", F.when(F.col("app_name").isNotNull(), F.col("seq"))), F.lit("")).alias("app_name"), F.min_by("first_fetched_at", "seq").alias("first_fetched_at"), *[F.max_by(c, "seq").alias(c) for c in other]
    )


def delete_apps(rows: DataFrame, doomed: DataFrame, key: str = "app_id") -> DataFrame:
    """Rows whose key is not among ``doomed``; child tables go by their own key."""
    return rows.join(doomed.select(key).distinct(), key, "left_anti")
