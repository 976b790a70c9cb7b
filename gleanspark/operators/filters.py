"""Filters on reviews; every one is a column predicate, so that scans can take it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Playtime brackets, half-open in minutes.
BRACKETS = [("<2h", 0, 120), ("2-10h", 120, 600), ("10-50h", 600, 3000), ("50h+", 3000, None)]


@dataclass(frozen=True)
class ReviewFilter:
    """Conditions that hold together; None (and an empty language) means no condition."""

    language: str | None = None
    period_start: int | None = None
    period_end: int | None = None
    playtime_min: int | None = None
    playtime_max: int | None = None
    steam_purchase: int | None = None
    received_for_free: int | None = None

    def predicate(self) -> Column:
        """Periods include both ends, playtimes their lower end only."""
        parts = []
        if self.language:
            parts.append(F.col("language") == self.language)
        if self.period_start is not None:
            parts.append(F.col("timestamp_created") >= self.period_start)
        if self.period_end is not None:
            parts.append(F.col("timestamp_created") <= self.period_end)
        if self.playtime_min is not None:
            parts.append(F.col("playtime_at_review") >= self.playtime_min)
        if self.playtime_max is not None:
            parts.append(F.col("playtime_at_review") < self.playtime_max)
        if self.steam_purchase is not None:
            parts.append(F.col("steam_purchase") == self.steam_purchase)
        if self.received_for_free is not None:
            parts.append(F.col("received_for_free") == self.received_for_free)
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def filter_reviews(reviews: DataFrame, f: ReviewFilter) -> DataFrame:
    return reviews.where(f.predicate())


def relative_period(days: int, asof: int) -> ReviewFilter:
    """The last ``days`` before ``asof`` (epoch seconds)."""
    return ReviewFilter(period_start=asof - days * 86400)


def bracket(label: str) -> ReviewFilter:
    low, high = next((lo, hi) for name, lo, hi in BRACKETS if name == label)
    return ReviewFilter(playtime_min=low, playtime_max=high)


def sentiment(positive: bool) -> Column:
    return F.col("voted_up") == int(positive)


def scan_reviews(reviews: DataFrame, app_id: int) -> DataFrame:
    """One app's reviews, newest first."""
    return reviews.where(F.col("app_id") == app_id).orderBy(F.col("timestamp_created").desc(), "recommendation_id")


def take_newest(reviews: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` with their position from 1: a top-n, so only its rows meet in one task."""
    top = reviews.orderBy(F.col("timestamp_created").desc(), "recommendation_id").limit(n)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(F.col("timestamp_created").desc(), "recommendation_id")))


def analysis_projection(reviews: DataFrame) -> DataFrame:
    """The pipeline's input row."""
    return reviews.select(
        F.col("recommendation_id").alias("id"),
        F.col("review_text").alias("text"),
        (F.col("voted_up") == 1).alias("voted_up"),
        "language",
        F.col("playtime_at_review").alias("playtime"),
        (F.col("primarily_steam_deck") == 1).alias("steam_deck"),
        (F.col("steam_purchase") == 1).alias("steam_purchase"),
        F.col("timestamp_created").alias("timestamp"),
        (F.col("written_during_early_access") == 1).alias("early_access"),
    )
