"""The registered queries: one for each operator, over the review projection of the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanspark.functions import text as T
from gleanspark.functions.ranks import ranked
from gleanspark.operators import clusters, crosstab, density, filters, keywords, learning, stats, upsert
from gleanspark.plans import analysis
from gleanspark.sources import reviews as S
from gleanspark.streaming.ingest import event_trend

#: Fixed value: the moment that relative periods end at.
ASOF = 1735689600


def _runs(r: DataFrame) -> DataFrame:
    """Two labellings of every review: by topic, and by id."""
    cells = F.array(F.struct(F.lit(1).alias("run"), F.col("topic_id").alias("label")), F.struct(F.lit(2).alias("run"), (F.col("recommendation_id").cast("long") % 7).cast("int").alias("label")))
    return r.select("recommendation_id", F.explode(cells).alias("c")).select("c.run", F.col("recommendation_id").alias("point"), "c.label")


def _batches(r: DataFrame) -> DataFrame:
    """Two overlapping batches: all of app 0 to 2, then apps 2 to 4 with changed columns."""
    first = r.where("app_id <= 2").withColumn("seq", F.lit(1))
    later = {"review_text": F.concat("review_text", F.lit("!")), "voted_up": 1 - F.col("voted_up"), "language": F.lit("changed"), "votes_up": F.col("votes_up") + 1, "timestamp_updated": F.col("timestamp_updated") + 60}
    return first.unionByName(r.where("app_id >= 2").withColumns(later).withColumn("seq", F.lit(2)))


def _filtered(f: filters.ReviewFilter):
    return lambda r: filters.filter_reviews(r, f).select("recommendation_id", "app_id")


def _list_games(r: DataFrame) -> DataFrame:
    """The listing with each game's place in it; the last change of a review stands for the last fetch."""
    fetched = r.groupBy("app_id").agg(F.max("timestamp_updated").alias("last_fetched_at"))
    listed = S.list_games(S.games(r).join(fetched, "app_id"))
    return ranked(listed, [F.col("last_fetched_at").desc(), F.col("app_id")], "pos").withColumn("pos", F.col("pos") + 1)


def _upsert_games(r: DataFrame) -> DataFrame:
    g = S.games(r).withColumns({"first_fetched_at": F.col("app_id") + 100, "last_fetched_at": F.col("app_id") + 100, "seq": F.lit(1)})
    again = g.where("app_id >= 2").withColumns({"app_name": F.when(F.col("app_id") == 3, "").otherwise(F.concat("app_name", F.lit(" II"))), "total_reviews": F.col("total_reviews") + 1, "first_fetched_at": F.lit(999), "last_fetched_at": F.lit(999), "seq": F.lit(2)})
    return upsert.upsert_games(g.unionByName(again)).select("app_id", "app_name", "first_fetched_at", "last_fetched_at", "total_positive", "total_negative", "total_reviews")


def _normalize(r: DataFrame) -> DataFrame:
    """Records as JSON, with gaps, read back and normalised."""
    i = F.col("recommendation_id").cast("long")
    raw = F.struct(
        F.col("recommendation_id").alias("recommendationid"),
        F.struct("playtime_at_review", F.when(i % 3 != 0, F.col("playtime_forever")).alias("playtime_forever")).alias("author"),
        F.when(i % 5 != 0, F.col("language")).alias("language"),
        (F.col("voted_up") == 1).alias("voted_up"),
        "timestamp_created",
        F.when(i % 2 == 0, F.col("steam_purchase") == 1).alias("steam_purchase"),
        F.when(i % 7 == 0, F.lit("bad")).otherwise(F.col("weighted_vote_score").cast("string")).alias("weighted_vote_score"),
    )
    parsed = r.select(F.from_json(F.to_json(raw), S.RAW_SCHEMA).alias("j")).select("j.*")
    return S.normalize_review(parsed, F.lit(7)).select("recommendation_id", "app_id", "language", "voted_up", "timestamp_created", "playtime_at_review", "playtime_forever", "steam_purchase", "votes_up", "weighted_vote_score")


def _group_sizes(r: DataFrame) -> DataFrame:
    """How many reviews each app has in each language: groups from a few rows up."""
    return r.groupBy("app_id", "language").agg(F.count(F.lit(1)).alias("n"))


def _app_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader may type for an app: addresses of pages as they are, store addresses, bare ids, and others."""
    i = F.col("page_id").cast("string")
    kinds = [F.col("url"), F.concat(F.lit(" "), i, F.lit(" ")), F.concat("url", F.lit("/app/"), i, F.lit("/Name/")), F.concat(i, F.lit("a"))]
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.get(F.array(*kinds), (F.col("page_id") % 4).cast("int")).alias("input"))


def _metrics(r: DataFrame) -> DataFrame:
    """Three runs for each of the apps, whose means stand for the scores of a candidate k."""
    mean = lambda c: F.avg(F.col(c).cast("double"))
    runs = r.groupBy("app_id", (F.col("recommendation_id").cast("long") % 3).alias("run")).agg(mean("weighted_vote_score").alias("separation"), mean("voted_up").alias("stability"), mean("received_for_free").alias("fragmentation"))
    return runs.select((F.col("app_id") + 2).cast("int").alias("k"), "separation", "stability", "fragmentation")


def _first_words(r: DataFrame) -> DataFrame:
    """(topic_id, rank, word): a word or two of each topic's newest reviews; one topic has none."""
    newest = Window.partitionBy("topic_id").orderBy(F.col("timestamp_created").desc(), "recommendation_id")
    rows = r.where("topic_id >= 0").select("topic_id", "review_text", (F.row_number().over(newest) - 1).alias("rank")).where("rank < 4")
    nth = lambda n: F.split_part("review_text", F.lit(" "), F.lit(n))
    return rows.select("topic_id", "rank", F.when(F.col("topic_id") != 9, F.when(F.col("rank") % 2 == 1, F.concat(nth(1), F.lit(" "), nth(2))).otherwise(nth(1))).alias("word"))


def _kmeans(r: DataFrame) -> DataFrame:
    return learning.kmeans_labels(crosstab.long_reviews(r).select("recommendation_id", "embedding"), 8).select("recommendation_id", "topic_id")


def _density(r: DataFrame) -> DataFrame:
    """Each app's reviews of one sentiment are a group: smaller ones than an analysis has, whose groups are sentiments alone."""
    long = crosstab.with_sentiment(crosstab.long_reviews(r)).where("embedding IS NOT NULL")
    return density.density_labels(long.select(F.concat_ws(":", "app_id", "sentiment").alias("part"), "recommendation_id", "embedding"), "recommendation_id", "part")


def _merge(r: DataFrame) -> DataFrame:
    return clusters.merge_topics(r.select("recommendation_id", "topic_id", "embedding"), 0.5)[0].select("recommendation_id", "topic_id")


REVIEW_QUERIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "scan_reviews": lambda r: filters.scan_reviews(r, 2).select(*S.REVIEW_COLUMNS),
    "get_game": lambda r: S.games(r).where("app_id = 3"),
    "list_games": _list_games,
    "filter_language": _filtered(filters.ReviewFilter(language="german")),
    "filter_period": _filtered(filters.ReviewFilter(period_start=1672531200 + 104729 * 3, period_end=1700000000)),
    "filter_playtime": _filtered(filters.ReviewFilter(playtime_min=120, playtime_max=600)),
    "filter_purchase": _filtered(filters.ReviewFilter(steam_purchase=1)),
    "filter_free": _filtered(filters.ReviewFilter(received_for_free=1)),
    "filter_conjunction": _filtered(filters.ReviewFilter("english", 1680000000, 1730000000, 60, 5000, 1, 0)),
    "filter_relative_period": _filtered(filters.relative_period(90, ASOF)),
    "filter_bracket": _filtered(filters.bracket("50h+")),
    "filter_sentiment": lambda r: r.where(filters.sentiment(False)).select("recommendation_id", "app_id"),
    "take_newest": lambda r: filters.take_newest(r, 100).select("recommendation_id", "pos"),
    "analysis_projection": filters.analysis_projection,
    "semi_delete": lambda r: upsert.delete_apps(r, S.games(r).where("app_id IN (1, 4)")).select("recommendation_id"),
    "upsert_games": _upsert_games,
    "upsert_reviews": lambda r: upsert.upsert_reviews(_batches(r.select(*S.REVIEW_COLUMNS))).select("recommendation_id", "app_id", "language", "review_text", "voted_up", "timestamp_updated", "votes_up", "playtime_forever"),
    "normalize_review": _normalize,
    "game_stats": stats.game_stats,
    "recent_rate": lambda r: stats.recent_rate(r, ASOF),
    "trend_daily": lambda r: stats.trend(r, "day"),
    "trend_weekly": lambda r: stats.trend(r, "week"),
    "trend_monthly": lambda r: stats.trend(r, "month"),
    "language_distribution": stats.language_distribution,
    "rate_by_playtime": stats.rate_by_playtime,
    "rate_by_language": stats.rate_by_language,
    "rate_by_purchase": stats.rate_by_purchase,
    "rate_band": lambda r: stats.rate_by_language(r).select("app_id", "label", stats.rate_band(F.col("positive_rate")).alias("band")),
    "compare_metrics": lambda r: stats.compare_metrics(r, 0, 1),
    "sentiment_counts": stats.sentiment_counts,
    "top_helpful": stats.top_helpful,
    "short_filter": lambda r: r.select("recommendation_id", T.is_short(F.col("review_text"), F.col("language")).alias("is_short")),
    "short_summary": crosstab.short_summary,
    "short_phrases": crosstab.short_phrases,
    "segment_cross": lambda r: crosstab.segment_cross(crosstab.long_reviews(r)),
    "segment_totals": lambda r: crosstab.segment_totals(crosstab.long_reviews(r)),
    "timeline_weekly": lambda r: crosstab.timeline(crosstab.long_reviews(r), "week"),
    "timeline_monthly": lambda r: crosstab.timeline(crosstab.long_reviews(r), "month"),
    "period_totals": lambda r: crosstab.period_totals(crosstab.long_reviews(r), "month"),
    "release_phase": lambda r: crosstab.release_phases(crosstab.long_reviews(r)),
    "segment_grid": lambda r: crosstab.segment_grid(crosstab.long_reviews(r)),
    "stacked_series": lambda r: crosstab.stacked_series(crosstab.long_reviews(r)),
    "first_n_per_topic": crosstab.first_per_topic,
    "cluster_sizes": crosstab.cluster_sizes,
    "cluster_centroids": lambda r: clusters.cluster_centroids(r).select("topic_id", "dim", F.round("value", 6).alias("value")),
    "centroid_pairs": lambda r: clusters.centroid_pairs(r).select("a", "b", F.round("similarity", 6).alias("similarity")),
    "nearest_to_centroid": clusters.nearest_to_centroid,
    "fragmentation": lambda r: clusters.fragmentation(_runs(r)).select("run", F.round("value", 6).alias("value")),
    "stability_ari": lambda r: clusters.stability(_runs(r)).select(F.round("value", 6).alias("value")),
    "silhouette": lambda r: learning.silhouette(r).select(F.round("value", 6).alias("value")),
    "truncate_review": lambda r: r.select("recommendation_id", T.truncate_review(F.col("review_text")).alias("value")),
    "language_name": lambda r: r.groupBy("language").agg(F.count(F.lit(1)).alias("n")).select("language", T.language_name(F.col("language")).alias("value"), "n"),
    "topic_label_lookup": lambda r: r.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n")).where("topic_id >= 0").select("topic_id", T.topic_name(F.col("topic_id"), F.when(F.col("topic_id") < 3, F.lit("named"))).alias("label"), "n"),
    "cluster_kmeans": _kmeans,
    "cluster_density": _density,
    "merge_topics": _merge,
    "recommend_k": lambda r: learning.recommend_k(crosstab.with_sentiment(crosstab.long_reviews(r)).where("embedding IS NOT NULL")),
    "keywords_statistical": keywords.keywords_statistical,
    "keywords_semantic": keywords.keywords_semantic,
    "embed": lambda r: learning.embed(r.select("recommendation_id", "review_text"), features=64).select("recommendation_id", "embedding"),
    "run_analysis": lambda r: analysis.topic_table(r, {"n_topics": 6}),
    "score_k": lambda r: clusters.score_k(_metrics(r)).select("k", F.round("group_score", 6).alias("group_score"), F.round("normalised", 6).alias("normalised"), "is_winner", F.round("margin", 6).alias("margin"), "confidence"),
    "candidate_ks": lambda r: _group_sizes(r).select("*", F.explode(clusters.candidate_ks(F.col("n"))).alias("k")),
    "fallback_k": lambda r: _group_sizes(r).select("*", clusters.fallback_k(F.col("n")).alias("k")),
    "estimate_minutes": lambda r: _group_sizes(r).select("*", T.estimate_minutes(F.col("n")).alias("value")),
    "topic_label": lambda r: clusters.topic_labels(_first_words(r)),
}

#: The queries that use topics or vectors; the projection of all others leaves those out.
WITH_VECTORS = {
    "segment_cross", "segment_grid", "stacked_series", "timeline_weekly", "timeline_monthly", "release_phase", "first_n_per_topic", "cluster_sizes", "cluster_centroids", "centroid_pairs", "nearest_to_centroid", "fragmentation",
    "stability_ari", "silhouette", "topic_label", "topic_label_lookup", "cluster_kmeans", "cluster_density", "merge_topics", "recommend_k", "keywords_statistical", "keywords_semantic", "run_analysis",
}

PLAIN_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parse_app_id": lambda s, d: _app_texts(s, d).withColumn("app_id", S.parse_app_id(F.col("input"))),
    "event_trend": lambda s, d: event_trend(s.read.parquet(f"{d}/events.parquet")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total")),
}


def _on_reviews(f: Callable[[DataFrame], DataFrame], vectors: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(S.reviews(spark, sf_dir, vectors))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _on_reviews(f, name in WITH_VECTORS) for name, f in REVIEW_QUERIES.items()} | PLAIN_QUERIES
