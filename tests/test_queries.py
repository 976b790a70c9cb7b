from __future__ import annotations

import pytest

import __spark_entry__
from gleanspark.plans import catalog, oracle


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_as_sql(name, spark, tables, same):
    same(catalog.QUERIES[name](spark, tables), oracle.SQL[name])


@pytest.mark.parametrize("name", ["cluster_kmeans", "merge_topics", "embed", "keywords_statistical", "keywords_semantic"])
def test_runs(name, spark, tables):
    assert catalog.QUERIES[name](spark, tables).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["axis", "bucket", "bucket_order", "sentiment", "topic_id", "n", "proportion"]
    assert df.count() > 0


def test_scans_read_what_is_needed(spark, tables):
    plan = catalog.QUERIES["game_stats"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    read = " ".join(part.split(">")[0] for part in plan.split("ReadSchema: ")[1:])
    assert "doc_id" in read and "text" not in read and "embedding" not in read
