"""Review tables: schemas, normalisation of raw records, and a deterministic projection of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("recommendation_id", T.StringType(), False),
        T.StructField("app_id", T.LongType()),
        T.StructField("language", T.StringType()),
        T.StructField("review_text", T.StringType()),
        T.StructField("voted_up", T.IntegerType()),
        T.StructField("timestamp_created", T.LongType()),
        T.StructField("timestamp_updated", T.LongType()),
        T.StructField("playtime_at_review", T.LongType()),
        T.StructField("playtime_forever", T.LongType()),
        T.StructField("steam_purchase", T.IntegerType()),
        T.StructField("received_for_free", T.IntegerType()),
        T.StructField("written_during_early_access", T.IntegerType()),
        T.StructField("primarily_steam_deck", T.IntegerType()),
        T.StructField("votes_up", T.LongType()),
        T.StructField("votes_funny", T.LongType()),
        T.StructField("weighted_vote_score", T.DoubleType()),
        T.StructField("comment_count", T.LongType()),
    ]
)
REVIEW_COLUMNS = REVIEW_SCHEMA.fieldNames()

#: A raw record as the API pages hold it; the score comes as text or number and is read as text.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("recommendationid", T.StringType()),
        T.StructField("author", T.StructType([T.StructField("playtime_at_review", T.LongType()), T.StructField("playtime_forever", T.LongType())])),
        T.StructField("language", T.StringType()),
        T.StructField("review", T.StringType()),
        T.StructField("voted_up", T.BooleanType()),
        T.StructField("timestamp_created", T.LongType()),
        T.StructField("timestamp_updated", T.LongType()),
        T.StructField("steam_purchase", T.BooleanType()),
        T.StructField("received_for_free", T.BooleanType()),
        T.StructField("written_during_early_access", T.BooleanType()),
        T.StructField("primarily_steam_deck", T.BooleanType()),
        T.StructField("votes_up", T.LongType()),
        T.StructField("votes_funny", T.LongType()),
        T.StructField("weighted_vote_score", T.StringType()),
        T.StructField("comment_count", T.LongType()),
    ]
)

#: What the first page of an app says of the whole.
SUMMARY_SCHEMA = T.StructType([T.StructField(c, T.StringType() if c == "review_score_desc" else T.LongType()) for c in ("num_reviews", "review_score", "review_score_desc", "total_positive", "total_negative", "total_reviews")])

#: A stored review: a review row and when it was last fetched.
STORED_SCHEMA = T.StructType([*REVIEW_SCHEMA.fields, T.StructField("fetched_at", T.LongType())])

#: Tables of up to this many vectors are broadcast; larger ones are joined by a shuffle.
BROADCAST_VECTORS = 20_000


def normalize_review(raw: DataFrame, app_id: Column, fetched_at: Column | None = None) -> DataFrame:
    """Raw records as review rows: nulls get defaults, flags become 0/1, records without an id go.

    With a time of fetching (milliseconds) the rows have it as ``fetched_at``.
    """
    zero, flag = (lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c.split(".")[-1])), (lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c))
    return raw.where(F.col("recommendationid").isNotNull()).select(
        F.col("recommendationid").alias("recommendation_id"),
        app_id.cast("long").alias("app_id"),
        F.coalesce("language", F.lit("")).alias("language"),
        F.coalesce("review", F.lit("")).alias("review_text"),
        flag("voted_up"),
        zero("timestamp_created"),
        zero("timestamp_updated"),
        zero("author.playtime_at_review"),
        zero("author.playtime_forever"),
        *[flag(c) for c in ("steam_purchase", "received_for_free", "written_during_early_access", "primarily_steam_deck")],
        zero("votes_up"),
        zero("votes_funny"),
        F.coalesce(F.col("weighted_vote_score").try_cast("double"), F.lit(0.0)).alias("weighted_vote_score"),
        zero("comment_count"),
        *([] if fetched_at is None else [fetched_at.cast("long").alias("fetched_at")]),
    )


def normalize_summary(raw: DataFrame, app_id: Column) -> DataFrame:
    """A raw summary as a game row; the name comes from elsewhere."""
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    return raw.select(
        app_id.cast("long").alias("app_id"), F.lit("").alias("app_name"), zero("review_score"), F.coalesce("review_score_desc", F.lit("")).alias("review_score_desc"), zero("total_positive"), zero("total_negative"), zero("total_reviews")
    )


def parse_app_id(text: Column) -> Column:
    """The id in an all-digit text or in a store address; null for anything else."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    digits = F.when(trimmed.rlike(r"^[0-9]+$"), trimmed).otherwise(F.nullif(F.regexp_extract(trimmed, r"/app/([0-9]+)", 1), F.lit("")))
    return digits.try_cast("long")


def raw_reviews(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of raw records."""
    return spark.read.schema(RAW_SCHEMA).json(path)


def reviews(spark: SparkSession, sf_dir: str, with_vectors: bool = True) -> DataFrame:
    """Reviews by integer arithmetic on documents, labels and embeddings: the storage columns, topic_id and embedding.

    Without vectors the last two are left out, and embeddings are not read.
    """
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    quality = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    df = d.join(quality, "doc_id", "left")
    more = []
    if with_vectors:
        vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
        n = vectors.count()
        df = df.withColumn("vec_id", F.col("doc_id") % max(n, 1)).join(F.broadcast(vectors) if n <= BROADCAST_VECTORS else vectors, "vec_id", "left")
        more = [F.when(F.col("doc_id") % 11 == 0, F.lit(-1)).otherwise(F.col("label")).cast("int").alias("topic_id"), F.col("embedding")]
    i = F.col("doc_id")
    language = F.when(i % 20 == 0, "koreana").when(i % 20 == 1, "japanese").when(F.col("lang") == "en", "english").when(F.col("lang") == "de", "german").when(F.col("lang") == "fr", "french").otherwise("spanish")
    created = 1672531200 + (i * 104729) % 63072000
    played = (i * 7919) % 6000
    return df.select(
        i.cast("string").alias("recommendation_id"),
        (i % 5).alias("app_id"),
        language.alias("language"),
        F.col("text").alias("review_text"),
        F.coalesce(F.col("quality"), i % 2).cast("int").alias("voted_up"),
        created.alias("timestamp_created"),
        (created + (i % 7) * 3600).alias("timestamp_updated"),
        played.alias("playtime_at_review"),
        (played + i % 900).alias("playtime_forever"),
        (i % 3 != 0).cast("int").alias("steam_purchase"),
        (i % 10 == 0).cast("int").alias("received_for_free"),
        (i % 6 < 2).cast("int").alias("written_during_early_access"),
        (i % 9 == 0).cast("int").alias("primarily_steam_deck"),
        ((i * 31) % 500).alias("votes_up"),
        ((i * 17) % 50).alias("votes_funny"),
        (((i * 613) % 1000).cast("double") / 1000.0).alias("weighted_vote_score"),
        (i % 12).alias("comment_count"),
        *more,
    )


def list_games(games: DataFrame) -> DataFrame:
    """Games in the order of their last fetch, newest first; ties go by app."""
    return games.orderBy(F.col("last_fetched_at").desc(), "app_id")


def games(reviews: DataFrame) -> DataFrame:
    """One row per app with its totals."""
    positive = F.sum(F.when(F.col("voted_up") == 1, 1).otherwise(0))
    return reviews.groupBy("app_id").agg(positive.alias("total_positive"), (F.count(F.lit(1)) - positive).alias("total_negative"), F.count(F.lit(1)).alias("total_reviews")).select(
        "app_id", F.concat(F.lit("App "), F.col("app_id").cast("string")).alias("app_name"), "total_positive", "total_negative", "total_reviews"
    )
