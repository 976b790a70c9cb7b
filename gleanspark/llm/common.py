"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words and may surround a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def work_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset a local session, as in tests, gets a folder of its
    own; on a cluster a machine's own folder would be of no use to the other machines, so the call is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gleanspark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there and a lost executor costs nothing."""
    path = f"{work_dir(df.sparkSession)}-{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once: an expression written into a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(spark: SparkSession, rows: int, per_slice: int, least: int = 1) -> int:
    """Into how many partitions ``rows`` go at about ``per_slice`` each, and not under the session's own count."""
    return max(least, -(-rows // per_slice), int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Lists of decisions up to this many rows (16 bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_DECISIONS = 1_000_000


def document_key() -> list[Column]:
    """Columns that name a row by its doc_id (null as itself) and text, for decisions to be joined on."""
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text")]


def wrapped(docs: DataFrame) -> DataFrame:
    """(whole, _id, _text): rows as one column beside their key, so that no name of ``docs`` can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), *document_key())


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not among ``dropped`` (_id, _text), with the columns of ``docs``."""
    dropped = stored(dropped.distinct(), "dropped")
    small = dropped.count() <= BROADCAST_DECISIONS
    return wrapped(docs).join(F.broadcast(dropped) if small else dropped, ["_id", "_text"], "left_anti").select("whole.*")


_kept: dict[Any, Any] = {}


def remembered(key: Any, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, made once per Python worker; a worker keeps one such thing at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def forget() -> None:
    """Drop what the worker remembers of other work and give its memory back: workers are kept, and used for later stages."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def parts(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """A batch cut where the sizes of its rows come to about ``most``, one row at least."""
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    bounds = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(sizes)]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def pieces_of(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``most_bytes`` of their text, so that a worker's memory has a bound."""
    for batch in batches:
        yield from parts(batch, byte_lengths(batch.column("text")), most_bytes)


def byte_lengths(texts: pa.Array) -> np.ndarray:
    return pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
