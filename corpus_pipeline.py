"""The corpus pipeline: language ID, exact dedup, near-duplicate join, decontamination, encoding.

Every stage but the last returns rows of its input as they are, whatever other columns there are and however they are named.
In all stages a null text counts as an empty one, texts of any length are read whole, a null doc_id is kept like any other,
and an empty table gives an empty result; what ties and repeated rows do stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm import pieces
from gleanspark.llm.common import documents, stored
from gleanspark.llm.decontamination import decontaminate
from gleanspark.llm.exact_dedup import deduplicated
from gleanspark.llm.language_id import identified
from gleanspark.llm.ngram_join import representatives
from gleanspark.llm.queries import PIECES_FILE


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters go; all others have a language (of equally likely ones the first in the alphabet).

    Rows that repeat are judged one by one.
    """
    return identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays (one with a null doc_id only if there is no other).

    Of rows that repeat a doc_id and its text one stays.
    """
    return deduplicated(docs, keep="min")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays; rows without words stay.

    A row stays if its doc_id names its group, so rows that repeat doc_id and text stay together, and a row with a null
    doc_id stays only where no other row of its group has one.
    """
    return representatives(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows that repeat go together, equally similar items weigh the same."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, same_text): every text as piece ids, and whether they decode to the text.

    A null or empty text has no pieces; rows that repeat are encoded one by one; other columns go.
    """
    decoded = pieces.encode_and_decode(docs, pieces.load(PIECES_FILE), keep=["doc_id", "text"])
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same_text"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("decontamination", benchmark_stage),
    ("sentencepiece", encoding_stage),
]

#: Cross parsing and the transducer can't be expressed in SQL; the tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one keeps is written and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
