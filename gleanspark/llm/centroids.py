"""Centroid clustering: exact integer k-means over vectors that are dictionary-encoded block by block.

Vectors are cut into chunks of at most ``CHUNK``.  A chunk's dimensions are cut into blocks, and each block is stored as the
list of its distinct subvectors and a code for each row; blocks are halved until the distinct subvectors are at most a quarter
of the rows, or the block is one dimension wide.  Nothing is lost.  In a round a chunk measures each distinct subvector against
each centroid once; a row's distances are sums of those by its codes, and the new sums of a centroid are counts of codes times
subvectors.  All numbers are integers, so results don't depend on how rows are dealt.  Chunks are stored once; a round reads
them, and only the centroids and their sums reach the driver.

Defined cases: vectors that are null, have another number of components than ``size`` or hold null or non-finite ones are not
kept; floor(1024 * x) counts as 2^27 beyond that, either way, so that every distance fits a long; repeated rows count each; of
equal ids the vector that sorts first starts first, and null ids start last; with fewer vectors than centroids there are fewer
centroids; sums of distances beyond a long are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import discard, stored
from gleanspark.llm.vectors import finite, matrix, scaled_floor

#: Components of a vector, factor of the grid, number of centroids, rounds, and what ids are hashed with.
SIZE, FACTOR, CENTROIDS, ROUNDS, SALT = 64, 1024, 8, 10, "3:"
MOST = 1 << 27
#: Rows of a chunk at most, and dimensions of the widest block.
CHUNK, WIDEST = 8192, 8
_CHUNK_SCHEMA = "starts array<int>, widths array<int>, sizes array<int>, words binary, codes binary"


def encoded(x: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first dimension, distinct subvectors, code of each row) of blocks that together are the whole of ``x``."""
    todo, out = [(i, min(WIDEST, x.shape[1] - i)) for i in range(0, x.shape[1], WIDEST)][::-1], []
    while todo:
        at, width = todo.pop()
        block = np.ascontiguousarray(x[:, at : at + width])
        words, codes = np.unique(block.view([("", block.dtype)] * width).ravel(), return_inverse=True)
        if width > 1 and len(words) * 4 > len(x):
            todo += [(at + width // 2, width - width // 2), (at, width // 2)]
        else:
            out.append((at, words.view(block.dtype).reshape(-1, width), codes.astype(np.uint16)))
    return out


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                blocks = encoded(matrix(part.column("x"), size))
                cells = [[b[0] for b in blocks], [b[1].shape[1] for b in blocks], [len(b[1]) for b in blocks], b"".join(b[1].tobytes() for b in blocks), b"".join(b[2].tobytes() for b in blocks)]
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                kinds = [pa.list_(pa.int32())] * 3 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([c], k) for c, k in zip(cells, kinds, strict=True)]], names=["ids", *[c.split()[0] for c in _CHUNK_SCHEMA.split(", ")]])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[tuple[int, np.ndarray, np.ndarray]]]]:
    for batch in batches:
        for r in range(batch.num_rows):
            ids = batch.column("ids")[r].values
            starts, widths, sizes = (batch.column(c)[r].as_py() for c in ("starts", "widths", "sizes"))
            words, codes = np.frombuffer(batch.column("words")[r].as_py(), np.int64), np.frombuffer(batch.column("codes")[r].as_py(), np.uint16).reshape(len(starts), -1)
            ends = np.cumsum(np.multiply(widths, sizes)).tolist()
            yield ids, [(at, words[e - w * m : e].reshape(m, w), code) for at, w, m, e, code in zip(starts, widths, sizes, ends, codes, strict=True)]


def nearest(blocks: list[tuple[int, np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row (of equally near ones the first) and its squared distance."""
    total = np.zeros((len(centroids), len(blocks[0][2])), dtype=np.int64)
    for at, words, codes in blocks:
        away = words[None] - centroids[:, None, at : at + words.shape[1]]
        total += (away * away).sum(2)[:, codes]
    best = total.argmin(0)
    return best, total[best, np.arange(len(best))]


def _sums(centroids: np.ndarray):
    """Of each task: by centroid and dimension, the sum over its rows, and how many there are."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, d), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for _, blocks in _read(batches):
            best, _ = nearest(blocks, centroids)
            counts += np.bincount(best, minlength=k)
            for at, words, codes in blocks:
                times = np.bincount(best * len(words) + codes, minlength=k * len(words)).reshape(k, -1)
                sums[:, at : at + words.shape[1]] += times @ words
        at = np.indices((k, d), dtype=np.int32).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(np.repeat(counts, d)), pa.array(sums.ravel())], names=["cluster", "dim", "n", "s"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, blocks in _read(batches):
            best, distance = nearest(blocks, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return run


def centroid_clusters(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector after ``rounds`` rounds."""
    spark, kind = table.sparkSession, dict(table.dtypes)[key]
    v = F.col(f"`{vector}`")
    rows = table.where((F.size(v) == size) & finite(v)).select(F.col(f"`{key}`").alias("id"), scaled_floor(v, FACTOR, MOST).alias("x"))
    order = [F.sha2(F.concat(F.lit(SALT), F.col("id").cast("string")), 256).asc_nulls_last(), F.col("x")]
    centroids = np.array([r.x for r in rows.orderBy(*order).limit(k).collect()], dtype=np.int64)
    if not len(centroids):
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    chunks = stored(rows.mapInArrow(_chunks(size), f"ids array<{kind}>, {_CHUNK_SCHEMA}"), "chunks")
    for _ in range(rounds):
        cells = chunks.mapInArrow(_sums(centroids), "cluster int, dim int, n long, s long").groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        moved = centroids.copy()
        for c in cells.where("n > 0").collect():
            moved[c.cluster, c.dim] = c.s // c.n
        if (moved == centroids).all():  # every later round would do the same
            break
        centroids = moved
    out = stored(chunks.mapInArrow(_assigned(centroids), f"id {kind}, cluster int, distance long"), "assigned")
    discard(chunks)
    inertia = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    long = lambda s: F.lit(s if s < 2**63 else None).cast("long")
    of_cluster = lambda values: F.get(F.array(*values), F.col("cluster"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return out.select(
        F.col("id").alias(key), "cluster", "distance", of_cluster([long(inertia.get(i, 0)) for i in range(len(centroids))]).alias("cluster_inertia"), long(sum(inertia.values())).alias("inertia"), of_cluster([F.lit(x) for x in digests]).alias("centroid_sha256")
    )
