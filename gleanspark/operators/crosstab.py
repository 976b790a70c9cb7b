"""Cross-tabs of topics by segment, period and release phase: one long-form aggregate each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.functions.text import is_short, stripped
from gleanspark.functions.time import iso_week_key, month_key
from gleanspark.operators.filters import BRACKETS
from gleanspark.operators.stats import up

LEAST_EARLY, LEAST_EARLY_SHARE, PRESENCE = 50, 0.10, 0.05


def with_sentiment(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn("sentiment", F.when(F.col("voted_up") == 1, "positive").otherwise("negative"))


def long_reviews(reviews: DataFrame, min_words: int = 5) -> DataFrame:
    """Reviews that are not short: the ones that topics are made from."""
    return reviews.where(~is_short(F.col("review_text"), F.col("language"), min_words))


def short_summary(reviews: DataFrame, min_words: int = 5) -> DataFrame:
    """Number and positive rate of each app's short reviews."""
    short = reviews.where(is_short(F.col("review_text"), F.col("language"), min_words))
    return short.groupBy("app_id").agg(F.count(F.lit(1)).alias("count"), F.avg(up().cast("double")).alias("positive_rate"))


def short_phrases(reviews: DataFrame, n: int = 10, min_words: int = 5) -> DataFrame:
    """Each app's most frequent short texts, lower-cased; ties go to the one seen first (newest)."""
    short = reviews.where(is_short(F.col("review_text"), F.col("language"), min_words)).withColumn("phrase", F.lower(stripped(F.col("review_text")))).where("phrase <> ''")
    seen = F.min(F.struct((-F.col("timestamp_created")).alias("t"), F.col("recommendation_id").alias("i")))
    counts = short.groupBy("app_id", "phrase").agg(F.count(F.lit(1)).alias("n"), seen.alias("seen"))
    w = Window.partitionBy("app_id").orderBy(F.col("n").desc(), "seen", "phrase")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("app_id", "phrase", "n", "rank")


def _bucketed(reviews: DataFrame, n_languages: int) -> DataFrame:
    """(axis, bucket, bucket_order, sentiment, topic_id, n, ups) over four axes, from counts of one scan."""
    p = F.coalesce("playtime_at_review", F.lit(0))
    order = F.lit(len(BRACKETS) - 1)
    for k, (_, low, high) in enumerate(BRACKETS[:-1]):
        order = F.when((p >= low) & (p < high), k).otherwise(order)
    deck, bought = F.coalesce(F.col("primarily_steam_deck") == 1, F.lit(False)), F.coalesce(F.col("steam_purchase") == 1, F.lit(False))
    counts = reviews.groupBy(order.alias("bracket"), "language", deck.alias("deck"), bought.alias("bought"), "sentiment", "topic_id").agg(F.count(F.lit(1)).alias("n"), F.sum(up()).alias("ups"))
    # At most n_languages rows.
    most = counts.groupBy("language").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "language").limit(n_languages)
    top = most.select("language", (F.row_number().over(Window.orderBy("language")) - 1).alias("language_order"))
    cell = lambda axis, bucket, order: F.struct(F.lit(axis).alias("axis"), bucket.alias("bucket"), order.cast("int").alias("bucket_order"))
    cells = F.array(
        cell("playtime", F.get(F.array(*[F.lit(label) for label, _, _ in BRACKETS]), F.col("bracket")), F.col("bracket")),
        cell("language", F.when(F.col("language_order").isNotNull(), F.col("language")), F.col("language_order")),
        cell("steam_deck", F.when(F.col("deck"), "Deck").otherwise("Non-Deck"), F.when(F.col("deck"), 0).otherwise(1)),
        cell("purchase_type", F.when(F.col("bought"), "Purchase").otherwise("Free"), F.when(F.col("bought"), 0).otherwise(1)),
    )
    rows = counts.join(F.broadcast(top), "language", "left").select("*", F.explode(cells).alias("cell"))
    return rows.select("cell.*", "sentiment", "topic_id", "n", "ups").where(F.col("bucket").isNotNull())


def _shares(rows: DataFrame, keys: list[str], n: Column | None = None) -> DataFrame:
    """Topics' counts and shares by bucket and sentiment; the whole counts rows without a topic too."""
    counts = rows.groupBy(*keys, "sentiment", F.coalesce("topic_id", F.lit(-1)).alias("topic_id")).agg(F.sum(F.lit(1) if n is None else n).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*keys, "sentiment"))
    return counts.withColumn("proportion", F.col("n") / whole).where("topic_id >= 0")


def segment_cross(reviews: DataFrame, n_languages: int = 10) -> DataFrame:
    """(axis, bucket, bucket_order, sentiment, topic_id, n, proportion) over four axes from one scan."""
    return _shares(_bucketed(with_sentiment(reviews), n_languages), ["axis", "bucket", "bucket_order"], F.col("n"))


def segment_totals(reviews: DataFrame, n_languages: int = 10) -> DataFrame:
    plain = with_sentiment(reviews).withColumn("topic_id", F.lit(0))
    return _bucketed(plain, n_languages).groupBy("axis", "bucket").agg(F.sum("n").alias("total_reviews"), (F.sum("ups") / F.sum("n")).alias("positive_rate"))


def timeline(reviews: DataFrame, period: str) -> DataFrame:
    """(period, sentiment, topic_id, n, proportion) by ISO week or month; empty periods are not filled in."""
    key = {"week": iso_week_key, "month": month_key}[period](F.col("timestamp_created"))
    return _shares(with_sentiment(reviews).where(F.col("timestamp_created").isNotNull()).withColumn("period", key), ["period"])


def period_totals(reviews: DataFrame, period: str) -> DataFrame:
    key = {"week": iso_week_key, "month": month_key}[period](F.col("timestamp_created"))
    return reviews.where(F.col("timestamp_created").isNotNull()).groupBy(key.alias("period")).agg(F.count(F.lit(1)).alias("total_reviews"), F.avg(up().cast("double")).alias("positive_rate"))


def release_phases(reviews: DataFrame) -> DataFrame:
    """Negative topics before and after release; no rows unless enough reviews are early ones."""
    rows = with_sentiment(reviews).withColumn("early", F.coalesce(F.col("written_during_early_access") == 1, F.lit(False)))
    e, neg = F.col("early"), F.col("sentiment") == "negative"
    count = lambda c: F.count(F.when(c, 1))
    phase = rows.agg(
        count(e).alias("n_early"), F.count(F.lit(1)).alias("n_all"), F.avg(F.when(e, up().cast("double"))).alias("ea_positive_rate"), F.coalesce(F.avg(F.when(~e, up().cast("double"))), F.lit(0.0)).alias("post_launch_positive_rate"),
        count(e & neg).alias("early_neg"), count(~e & neg).alias("post_neg"),
    ).where((F.col("n_early") >= LEAST_EARLY) & (F.col("n_early") >= F.col("n_all") * LEAST_EARLY_SHARE))
    topics = rows.where(neg & (F.col("topic_id") >= 0)).groupBy("topic_id").agg(count(e).alias("early_n"), count(~e).alias("post_n"))
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(F.lit(0.0))
    both = topics.join(F.broadcast(phase)).withColumns({"ea_proportion": share("early_n", "early_neg"), "post_launch_proportion": share("post_n", "post_neg")})
    a, b = F.col("ea_proportion") >= PRESENCE, F.col("post_launch_proportion") >= PRESENCE
    status = F.when(a & b, "persistent").when(a, "resolved").when(b, "new")
    return both.withColumn("status", status).where("status IS NOT NULL").select("topic_id", "status", "ea_proportion", "post_launch_proportion", "ea_positive_rate", "post_launch_positive_rate")


def phase_order() -> list[Column]:
    """Persistent, resolved, new; the larger rounded share first; then the topic."""
    rank = F.when(F.col("status") == "persistent", 0).when(F.col("status") == "resolved", 1).otherwise(2)
    return [rank, F.greatest(F.round("ea_proportion", 4), F.round("post_launch_proportion", 4)).desc(), F.col("topic_id")]


def segment_grid(reviews: DataFrame) -> DataFrame:
    """Negative reviews by playtime bracket and topic, with zeros."""
    rows = _bucketed(with_sentiment(reviews), 1).where("axis = 'playtime'")
    counts = rows.where("sentiment = 'negative' AND topic_id >= 0").groupBy("bucket", "topic_id").agg(F.sum("n").alias("n"))
    # Brackets and topics: a few rows each.
    grid = rows.select("bucket").distinct().join(F.broadcast(counts.select("topic_id").distinct()))
    return grid.join(counts, ["bucket", "topic_id"], "left").select("bucket", "topic_id", F.coalesce("n", F.lit(0)).alias("n"))


def stacked_series(reviews: DataFrame) -> DataFrame:
    """Negative reviews by month and topic, with zeros."""
    rows = with_sentiment(reviews).where(F.col("timestamp_created").isNotNull()).withColumn("period", month_key(F.col("timestamp_created")))
    counts = rows.where("sentiment = 'negative' AND topic_id >= 0").groupBy("period", "topic_id").agg(F.count(F.lit(1)).alias("n"))
    grid = rows.select("period").distinct().join(F.broadcast(counts.select("topic_id").distinct()))
    return grid.join(counts, ["period", "topic_id"], "left").select("period", "topic_id", F.coalesce("n", F.lit(0)).alias("n"))


def first_per_topic(reviews: DataFrame, n: int = 5) -> DataFrame:
    """Each topic's newest reviews."""
    w = Window.partitionBy("topic_id").orderBy(F.col("timestamp_created").desc(), "recommendation_id")
    return reviews.where("topic_id >= 0").select("topic_id", F.row_number().over(w).alias("rn"), "recommendation_id").where(F.col("rn") <= n)


def cluster_sizes(reviews: DataFrame) -> DataFrame:
    return reviews.where("topic_id >= 0").groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))
