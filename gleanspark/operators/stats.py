"""Rating statistics, trends and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.functions.time import day_key, month_key, sunday_key
from gleanspark.operators.filters import BRACKETS


def up() -> Column:
    return F.when(F.col("voted_up") == 1, F.lit(1)).otherwise(F.lit(0))


def game_stats(reviews: DataFrame) -> DataFrame:
    """Totals, positive rate (0 without reviews) and languages by app, in one aggregate."""
    return reviews.groupBy("app_id").agg(
        F.count(F.lit(1)).alias("total_collected"), F.sum(up()).alias("positive_count"), F.sum(1 - up()).alias("negative_count"), F.avg(up().cast("double")).alias("positive_rate"), F.count_distinct("language").alias("n_languages")
    )


def languages(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("app_id").agg(F.sort_array(F.collect_set("language")).alias("languages"))


def recent_rate(reviews: DataFrame, asof: int, days: int = 30) -> DataFrame:
    """Reviews of the last ``days`` and their positive rate, null where there are none."""
    recent = F.col("timestamp_created") >= asof - days * 86400
    return reviews.groupBy("app_id").agg(F.count(F.when(recent, 1)).alias("recent_count"), F.avg(F.when(recent, up().cast("double"))).alias("recent_rate"))


def trend(reviews: DataFrame, bucket: str) -> DataFrame:
    """Positive and negative reviews by app and day, week (from its Sunday) or month."""
    key = {"day": day_key, "week": sunday_key, "month": month_key}[bucket](F.col("timestamp_created"))
    return reviews.groupBy("app_id", key.alias("bucket")).agg(F.sum(up()).alias("pos"), F.sum(1 - up()).alias("neg"))


def _largest(df: DataFrame, n: int, size: str, name: str) -> DataFrame:
    """The ``n`` largest rows of each app; ties go by name."""
    w = Window.partitionBy("app_id").orderBy(F.col(size).desc(), name)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def language_distribution(reviews: DataFrame, n: int = 15) -> DataFrame:
    return _largest(reviews.groupBy("app_id", "language").agg(F.count(F.lit(1)).alias("n")), n, "n", "language")


def rate_by_language(reviews: DataFrame, n: int = 15) -> DataFrame:
    return _largest(reviews.groupBy("app_id", F.col("language").alias("label")).agg(F.count(F.lit(1)).alias("total"), F.avg(up().cast("double")).alias("positive_rate")), n, "total", "label")


def rate_by_playtime(reviews: DataFrame) -> DataFrame:
    """All brackets of every app, empty ones with rate 0; playtimes in no bracket are left out."""
    p = F.col("playtime_at_review")
    cells = [F.struct(F.lit(label).alias("label"), ((p >= low) & (F.lit(True) if high is None else p < high)).alias("inside")) for label, low, high in BRACKETS]
    rows = reviews.select("app_id", up().alias("up"), F.explode(F.array(*cells)).alias("c"))
    inside = F.col("c.inside")
    return rows.groupBy("app_id", F.col("c.label").alias("label")).agg(F.count(F.when(inside, 1)).alias("total"), F.coalesce(F.avg(F.when(inside, F.col("up").cast("double"))), F.lit(0.0)).alias("positive_rate"))


def rate_by_purchase(reviews: DataFrame) -> DataFrame:
    """Purchased and received free: two groups that may overlap."""
    groups = [("Purchase", "steam_purchase"), ("Free", "received_for_free")]
    rows = reviews.select("app_id", up().alias("up"), F.explode(F.array(*[F.struct(F.lit(k).alias("label"), (F.col(c) == 1).alias("inside")) for k, c in groups])).alias("c"))
    inside = F.col("c.inside")
    return rows.groupBy("app_id", F.col("c.label").alias("label")).agg(F.count(F.when(inside, 1)).alias("total"), F.coalesce(F.avg(F.when(inside, F.col("up").cast("double"))), F.lit(0.0)).alias("positive_rate"))


def rate_band(rate: Column) -> Column:
    return F.when(rate >= 0.7, "high").when(rate >= 0.4, "middle").otherwise("low")


def compare_metrics(reviews: DataFrame, a: int, b: int) -> DataFrame:
    """Two apps side by side: rates in percent and log10 of the totals plus one."""
    s = game_stats(reviews.where(F.col("app_id").isin(a, b))).select("app_id", (F.col("positive_rate") * 100).alias("rate"), F.log10(F.col("total_collected") + 1).alias("log_total"), "n_languages")
    left = s.where(F.col("app_id") == a).select(F.col("app_id").alias("app_a"), F.col("rate").alias("rate_a"), F.col("log_total").alias("log_total_a"), F.col("n_languages").alias("languages_a"))
    right = s.where(F.col("app_id") == b).select(F.col("app_id").alias("app_b"), F.col("rate").alias("rate_b"), F.col("log_total").alias("log_total_b"), F.col("n_languages").alias("languages_b"))
    return left.join(right, F.lit(True))  # one row each


def top_helpful(reviews: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most helpful reviews of each app and sentiment."""
    w = Window.partitionBy("app_id", "voted_up").orderBy(F.col("weighted_vote_score").desc(), "recommendation_id")
    return reviews.select("app_id", "voted_up", F.row_number().over(w).alias("rn"), "recommendation_id", "weighted_vote_score").where(F.col("rn") <= n)


def sentiment_counts(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.coalesce(F.sum(up()), F.lit(0)).alias("positive_count"), F.coalesce(F.sum(1 - up()), F.lit(0)).alias("negative_count"))
