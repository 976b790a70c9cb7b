from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

from gleanspark.llm.common import documents

#: Column names that operators use inside, as extra columns of the edge table.
CLASHING = ["row", "id", "n", "digest", "text_sha256", "lang_pred", "score", "_id", "_text", "component_id", "ids", "keep_bitmap", "whole", "c0"]


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, a very long text, equal texts, near copies, repeated rows, repeated ids."""
    rng = random.Random(5)
    long = words(rng, 30_000)
    base = words(rng, 60).split(" ")
    near = " ".join([*base[:-1], "changed"])
    other = words(rng, 40)
    rows = [
        (1, None, "en"), (2, "", "en"), (3, "   \n\t ", None), (4, "12 345 !?", "de"), (5, long, "en"), (6, long + " more", "en"), (7, " ".join(base), "fr"), (8, near, "fr"), (9, near, None),
        (10, "one line of words here\nanother line of words\n\nsame", "es"), (11, "ANOTHER line of words \nsame", "es"), (12, other, "en"), (12, other, "en"), (13, other, "en"), (14, "a b c", "en"), (15, "A b  c", "en"),
        (16, "émile zoé ünï", "fr"), (17, "日本語 の 文章 です ね ここ", None), (18, "x" * 50_000, "en"), (None, "no id at all but words", "en"), (None, None, None), (19, "\x00\x1f \u2581 \ue000 🎉", "en"), (20, words(rng, 300), "de"), (20, words(rng, 5), "de"),
    ]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])
    return spark.createDataFrame([(*r, "src0", *["?"] * len(CLASHING)) for r in edge_rows], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def small(spark, tables):
    return documents(spark, tables)
