from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanspark.llm import exact_dedup as E
from gleanspark.llm import queries
from gleanspark.llm.common import BLANKS, UPPER
from gleanspark.llm.exact_dedup import decisions, deduplicated, exact_dedup
from gleanspark.llm.line_dedup import kept_text, line_dedup

LOWER = str.maketrans(UPPER, UPPER.lower())


@pytest.mark.parametrize("name", ["op4_line_dedup", "op7_exact_dedup", "op8_url_filters", "op10_ngram_join"])
def test_same_as_sql(name, spark, tables, same):
    same(queries.QUERIES[name](spark, tables), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("digest", ["sha256", "crc32"])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_edge(edge, edge_rows, keep, digest):
    groups = defaultdict(list)
    for i, t, _ in edge_rows:
        groups[t or ""].append(i)
    expected = set()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        stays = (min if keep == "min" else max)(known) if known else None
        expected |= {(i, stays, len(ids), i == stays, hashlib.sha256(t.encode()).hexdigest()) for i in ids}
    got = [tuple(r) for r in exact_dedup(edge, keep, digest).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_collisions_are_told_apart(spark):
    """plumless and buckeroo have one CRC-32."""
    df = spark.createDataFrame([(1, "plumless"), (2, "buckeroo"), (3, "plumless")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(df, "min", "crc32").collect()}
    assert got == {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False)}


def test_exact_stage_keeps_one_of_each(edge, edge_rows, empty):
    out = deduplicated(edge)
    assert out.columns == edge.columns
    got = sorted(r.text or "" for r in out.collect())
    assert got == sorted({t or "" for _, t, _ in edge_rows})
    assert deduplicated(empty).count() == 0 and decisions(empty).count() == 0


def test_index_of_many_flushes(spark, monkeypatch):
    """Flushes and compactions by turns give what one pass gives; a run whose filter says no is not read."""
    rng = random.Random(6)
    monkeypatch.setattr(E, "FAN_IN", 3)
    rows = [(f"{rng.randrange(400 if k % 2 else 10**9)}".encode(), k, 1 + k % 3) for k in range(3000)]
    index = E.DigestIndex(spark, memtable_rows=200)
    batch = lambda a, b: spark.createDataFrame(rows[a:b], "digest binary, doc_id long, copies long")
    for k in range(9):
        index.flush(batch(200 * k, 200 * k + 200))
        if k in (3, 6):
            index.compact(0)
        if k == 6:
            index.compact(1)
    assert [len(x) for x in index.levels] == [2, 0, 1]
    index.flush(batch(1800, 3000).repartition(6), memtables=6)
    first = {}
    for digest, doc, copies in rows:
        lo, hi, n, m = first.get(digest, (doc, doc, 0, 0))
        first[digest] = (min(lo, doc), max(hi, doc), n + copies, m + 1)
    asked = [rows[5][0], rows[1700][0], rows[2999][0], b"never there"]
    found, read = index.lookup(spark.createDataFrame([(x,) for x in asked], "digest binary"))
    got = {bytes(r.digest): (r.lo, r.hi, r.n) for r in found.groupBy("digest").agg(F.min("least_id").alias("lo"), F.max("largest_id").alias("hi"), F.sum("group_size").alias("n")).collect()}
    assert got == {x: first[x][:3] for x in asked[:3]}
    assert len(read) < sum(len(x) for x in index.levels)
    only_new = spark.createDataFrame([(f"new {k}".encode(),) for k in range(3)], "digest binary")
    assert len(index.lookup(only_new)[1]) < sum(len(x) for x in index.levels)
    merged = index.merged()
    assert {bytes(r.digest): (r.least_id, r.largest_id, r.group_size, r.members) for r in merged.collect()} == first and merged.count() == len(first)
    assert sum(len(x) for x in index.levels) == 1


def test_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup(df, "max").where("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (1000, 2997, 2997, 1)


def brute_lines(rows):
    last = 2**63  # after all ids
    first = {}
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            key = line.strip(BLANKS).translate(LOWER)
            if len(key) >= 10:
                first[key] = min(first.get(key, last), last if i is None else i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        keys = [line.strip(BLANKS).translate(LOWER) for line in lines]
        keep = [len(k) < 10 or first[k] == (last if i is None else i) for k in keys]
        out.append((i, len(lines), keep.count(False), "\n".join(x for x, k in zip(lines, keep, strict=True) if k)))
    return sorted(out, key=str)


def test_lines_edge(edge, edge_rows, empty):
    maps = line_dedup(edge)
    assert sorted((tuple(r) for r in kept_text(edge, maps).collect()), key=str) == brute_lines(edge_rows)
    r = maps.where("id = 11").first()
    assert np.unpackbits(np.frombuffer(zlib.decompress(r.keep_bitmap), np.uint8), count=2).tolist() == [0, 1] and r.n_dropped == 1
    assert kept_text(empty, line_dedup(empty)).count() == 0


def test_a_null_id_is_not_the_largest(spark):
    rows = [(2**63 - 1, "a line in two documents", None), (None, "x\na line in two documents", None), (0, "another line of these", None), (None, "another line of these", None)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = sorted((tuple(r) for r in kept_text(df, line_dedup(df)).collect()), key=str)
    assert got == brute_lines(rows) and [r[2] for r in got] == [0, 0, 1, 1]


def test_hot_line_over_many_partitions(spark):
    rows = [(i, f"a very common line\nline number {i} of all\nA VERY COMMON LINE ", None) for i in range(700)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(7)
    import gleanspark.llm.line_dedup as L

    before, L.LINE_ROWS = L.LINE_ROWS, 50
    try:
        got = sorted((tuple(r) for r in kept_text(df, line_dedup(df)).collect()), key=str)
    finally:
        L.LINE_ROWS = before
    assert got == brute_lines(rows)


def test_filters_are_asked_at_any_size(spark, monkeypatch):
    """Filters too large for a broadcast are joined, with the same result."""
    rng = random.Random(8)
    rows = [(f"{rng.randrange(900)}".encode(), k, 1) for k in range(2000)]
    df = spark.createDataFrame(rows, "digest binary, doc_id long, copies long")
    got = []
    for bits in (E.MOST_BROADCAST_BITS, 0):
        monkeypatch.setattr(E, "MOST_BROADCAST_BITS", bits)
        index = E.DigestIndex(spark, memtable_rows=400)
        index.flush(df, memtables=5)
        got.append(sorted(map(tuple, index.merged().collect())))
        assert [len(x) for x in index.levels] == [0, 0, 1]
    assert got[0] == got[1] and len(got[0]) == len({d for d, _, _ in rows}) and sum(r[4] for r in got[0]) == len(rows)
