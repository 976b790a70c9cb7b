"""The whole text analysis: short texts apart, the rest clustered by sentiment, merged, named and cross-tabulated."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.operators import clusters, crosstab, density, filters, keywords, learning, stats
from gleanspark.plans.config import resolve_config
from gleanspark.plans.progress import Progress
from gleanspark.sources.storage import stored

DEFAULT_TOPICS = 8


@dataclass
class Analysis:
    """Frames by name; every one stays lazy but for the small lists that clustering needs."""

    config: dict
    labelled: DataFrame | None = None
    topics: DataFrame | None = None
    counts: DataFrame | None = None
    short: DataFrame | None = None
    phrases: DataFrame | None = None
    crosstabs: dict[str, DataFrame] = field(default_factory=dict)
    recommendation: list[dict] = field(default_factory=list)
    merges: dict[str, dict] = field(default_factory=dict)


def _filter(config: dict) -> filters.ReviewFilter:
    known = filters.ReviewFilter.__dataclass_fields__
    return filters.ReviewFilter(**{k: v for k, v in config.get("filter", {}).items() if k in known})


def run_analysis(reviews: DataFrame, config: dict | None = None, progress: Callable[[dict], None] | None = None, tag: str | None = None) -> Analysis:
    """Reviews without a column ``embedding`` are embedded from their texts; of those with one, a row whose vector is null
    belongs to no topic (-1) and counts in the whole.

    The jobs bear ``tag``, by which ``progress.cancel`` ends them.
    """
    with Progress(reviews.sparkSession, progress, tag) as at:
        return _analysed(reviews, resolve_config(config or {}), at)


def _analysed(reviews: DataFrame, c: dict, at: Progress) -> Analysis:
    rows = filters.filter_reviews(reviews, _filter(c))
    if "maxReviews" in c:
        rows = rows.orderBy(F.col("timestamp_created").desc(), "recommendation_id").limit(c["maxReviews"])
    rows = rows.drop("topic_id")
    words = c["min_review_words"]
    out = Analysis(c, counts=stats.sentiment_counts(rows), short=crosstab.short_summary(rows, words), phrases=crosstab.short_phrases(rows, min_words=words))
    long = crosstab.with_sentiment(crosstab.long_reviews(rows, words))
    at.phase(10, "embedding", "embedding", 40)
    if "embedding" not in long.columns:
        long = learning.embed(long)
    # Stored, as every frame below reads it: whatever joins made the reviews move their texts once.
    long = stored(long, "long")
    known = long.where(F.col("embedding").isNotNull())
    sizes = {r.sentiment: r["count"] for r in known.groupBy("sentiment").count().collect()}
    if sum(sizes.values()) < 2:
        return out
    ks = {s: c.get("n_topics", DEFAULT_TOPICS) for s in sizes}
    if c["topicCountMode"] == "auto":
        at.phase(40, "choosing the number of topics", "recommendation", 60)
        out.recommendation = [r.asDict() for r in learning.recommend_k(known).collect()]
        ks |= {r["sentiment"]: r["k"] for r in out.recommendation}
    groups = []
    for i, (s, n) in enumerate(sorted(sizes.items())):
        at.phase(60 + 20 * i // len(sizes), f"clustering {s} reviews", "clustering", 60 + 20 * (i + 1) // len(sizes))
        group = known.where(F.col("sentiment") == s)
        if n < 2:
            groups.append(group.withColumn("topic_id", F.lit(-1)))
            continue
        if c["tier"] >= 1:
            found = density.density_labels(group, "recommendation_id", "sentiment")
            labelled = group.join(found.drop("sentiment"), "recommendation_id")
        else:
            labelled = learning.kmeans_labels(group, min(ks[s], n))
        merged, out.merges[s] = clusters.merge_topics(labelled, c["merge_threshold"])
        groups.append(merged)
    labelled = reduce(DataFrame.unionByName, groups, long.where(F.col("embedding").isNull()).withColumn("topic_id", F.lit(-1)))
    # Topics of k-means are computed from a row's vector wherever it is read; those of density come by a join.
    out.labelled = labelled = stored(labelled, "labelled") if c["tier"] >= 1 else labelled
    at.phase(80, "finding keywords", "keywords", 99)
    out.topics = topic_records(labelled, c["tier"])
    out.crosstabs = {
        "segments": crosstab.segment_cross(labelled),
        "segment_totals": crosstab.segment_totals(labelled),
        "weekly": crosstab.timeline(labelled, "week"),
        "monthly": crosstab.timeline(labelled, "month"),
        "phases": crosstab.release_phases(labelled),
    }
    at.phase(100, "done", "complete")
    return out


def topic_records(labelled: DataFrame, tier: int = 0) -> DataFrame:
    """(sentiment, topic_id, label, review_count, keywords, representative, samples) of every topic.

    Keywords are statistical in tier 0 and semantic from tier 1 up.
    """
    find = keywords.keywords_semantic if tier >= 1 else keywords.keywords_statistical
    parts = []
    for s in ("negative", "positive"):
        group = labelled.where((F.col("sentiment") == s) & (F.col("topic_id") >= 0))
        words = find(group)
        listed = words.groupBy("topic_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word", "score"))), lambda x: F.struct(x["word"].alias("word"), F.round(x["score"], 3).alias("score"))).alias("keywords"))
        texts = group.select("recommendation_id", "review_text")
        best = clusters.nearest_to_centroid(group).join(texts, "recommendation_id").select("topic_id", F.col("review_text").alias("representative"))
        first = crosstab.first_per_topic(group).join(texts, "recommendation_id").groupBy("topic_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "review_text"))), lambda x: x["review_text"]).alias("samples"))
        topics = group.groupBy("topic_id").agg(F.count(F.lit(1)).alias("review_count"))
        labels = clusters.topic_labels(words.select("topic_id", "rank", "word"))
        for more in (labels, listed, best, first):
            topics = topics.join(more, "topic_id", "left")
        name = F.coalesce("label", F.concat(F.lit("Topic "), F.col("topic_id").cast("string")))
        parts.append(topics.select(F.lit(s).alias("sentiment"), "topic_id", name.alias("label"), "review_count", "keywords", "representative", "samples"))
    return parts[0].unionByName(parts[1])


def topic_table(reviews: DataFrame, config: dict) -> DataFrame:
    """The topics of an analysis, without the nested parts."""
    return run_analysis(reviews, config).topics.select("sentiment", "topic_id", "label", "review_count")
