"""Line dedup: hashes of lines in range partitions, first occurrences streamed, keep bitmaps returned.

Every line long enough gives one narrow row ``(hash, document, position)``.  The rows are range-partitioned by hash and
document, so that a line of any frequency spreads over as many partitions as it needs, and sorted by hash, document and
position.  A stream over a partition knows the first document of every hash that begins in it.  Only the hash at a
partition's head may have begun before; its rows wait for the summaries (two rows a partition at most) of the partitions
before.  What returns is, for each document that loses lines, a compressed bitmap of the lines it keeps; documents
without a bitmap keep every line.  Texts are not moved until the bitmaps are applied.

Defined cases: a null or empty text is one empty line; texts of any length are read whole; lines that repeat in the first
document that holds them all stay there; a null doc_id is one document that comes after all others; rows that
repeat a doc_id are one document, and rows with different texts under one doc_id get a bitmap each; hashes have 128 bits; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import BLANKS, UPPER, pieces_of, slices, stored

#: Hashes of lines that one task sorts, and bytes of text that a worker takes up at a time.
LINE_ROWS, PART_BYTES = 400_000, 4_000_000
#: Partitions at most; larger ones spill while they are sorted.
MOST_PARTITIONS = 20_000

_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_BLANKS = BLANKS.encode()

#: A document is (late, id): late is 1 and id 0 for a null doc_id, which comes after all others.
LINES = "h1 long, h2 long, late int, id long, row long, pos int"
FOUND = f"kind string, {LINES}"


def line_keys(text: bytes, least: int = 10) -> Iterator[tuple[int, bytes]]:
    """(position, key) of the lines whose key has at least ``least`` code points."""
    for pos, line in enumerate(text.translate(_LOWER).split(b"\n")):
        key = line.strip(_BLANKS)
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least):
            yield pos, key


def _hash_lines(least: int):
    digest = xxhash.xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, PART_BYTES):
            named = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("late", "id", "row")]
            found, pos, counts = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                before = len(pos)
                for p, key in line_keys(text, least):
                    found.append(digest(key))
                    pos.append(p)
                counts.append(len(pos) - before)
            h = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            columns = [np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]), *[np.repeat(c, counts) for c in named], np.array(pos, dtype=np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "late", "id", "row", "pos"])

    return run


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (h1, h2, late, id, pos): lines to drop, lines of the head hash, and summaries of head and tail."""
    head = tail = None  # (h1, h2, late, id), of the first document of the first and of the last hash

    def out(kind, columns):
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), *(pa.array(c.astype(np.int32 if i in (2, 5) else np.int64)) for i, c in enumerate(columns))], names=["kind", "h1", "h2", "late", "id", "row", "pos"])

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, late, ids, rows, pos = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("h1", "h2", "late", "id", "row", "pos"))
        begins = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        starts = np.flatnonzero(begins)
        first_late, first = late[starts].copy(), ids[starts].copy()
        if head is None:
            head = (h1[0], h2[0], late[0], ids[0])
        elif tail[:2] == (h1[0], h2[0]):
            first_late[0], first[0] = tail[2:]
        run = np.cumsum(begins) - 1
        in_head = (h1 == head[0]) & (h2 == head[1])
        drop = ((ids != first[run]) | (late != first_late[run])) & ~in_head
        tail = (h1[-1], h2[-1], first_late[-1], first[-1])
        if drop.any():
            yield out("drop", [x[drop] for x in (h1, h2, late, ids, rows, pos)])
        if in_head.any():
            yield out("head", [x[in_head] for x in (h1, h2, late, ids, rows, pos)])
    for h in {head, tail} - {None}:
        yield out("first", [np.array([x], dtype=np.int64) for x in (*h, 0, 0)])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, dropped = [], []
        for drops in batch.column("drops").to_pylist():
            keep = np.ones(-(-(max(drops) + 1) // 8) * 8, dtype=bool)
            keep[drops] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
            dropped.append(len(drops))
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("late", "id", "row")], pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())], names=["late", "id", "row", "n_dropped", "keep_bitmap"])


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    id_ = F.col("doc_id").cast("long")
    return docs.select("doc_id", id_.isNull().cast("int").alias("late"), F.coalesce(id_, F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))


def line_dedup(docs: DataFrame, least: int = 10) -> DataFrame:
    """(late, id, row, n_dropped, keep_bitmap) for documents that lose lines: zlib over bits packed from the first line on.

    Lines beyond a map's end are kept.  ``id`` is doc_id (for null it is 0 and ``late`` is 1) and ``row`` tells apart texts under one doc_id.  A line's key is the line
    stripped of blanks and lower-cased in A-Z; keys of ``least`` code points or more that several documents hold lose all
    their lines except in the document with the smallest doc_id.
    """
    texts = _identified(docs)
    lines = stored(texts.select("late", "id", "row", "text").mapInArrow(_hash_lines(least), LINES), "lines")
    n = min(MOST_PARTITIONS, slices(docs.sparkSession, lines.count(), LINE_ROWS))
    ranged = lines.repartitionByRange(n, "h1", "h2", "late", "id").sortWithinPartitions("h1", "h2", "late", "id", "pos")
    found = stored(ranged.mapInArrow(_first_occurrences, FOUND), "found")
    firsts = found.where("kind = 'first'").groupBy("h1", "h2").agg(F.min(F.struct("late", "id")).alias("first"))
    # Two rows of some 40 bytes a partition at most, so under two megabytes for all partitions there can be.
    waited = found.where("kind = 'head'").join(F.broadcast(firsts), ["h1", "h2"]).where(F.struct("late", "id") != F.col("first"))
    drops = found.where("kind = 'drop'").select("late", "id", "row", "pos").unionByName(waited.select("late", "id", "row", "pos"))
    lost = drops.groupBy("late", "id", "row").agg(F.collect_set("pos").alias("drops"))
    return lost.mapInArrow(_bitmaps, "late int, id long, row long, n_dropped int, keep_bitmap binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of(batches, PART_BYTES):
        texts, lines, dropped = [], [], []
        for text, bits in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("keep_bitmap").to_pylist(), strict=True):
            if bits is None:
                n = lost = 0
                n = text.count(b"\n") + 1
            else:
                parts = text.split(b"\n")
                n = len(parts)
                keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))[:n].astype(bool).tolist()
                keep += [True] * (n - len(keep))
                text = b"\n".join([p for p, k in zip(parts, keep, strict=True) if k])
                lost = n - sum(keep)
            texts.append(text)
            lines.append(n)
            dropped.append(lost)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])


def kept_text(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): the lines of each row of ``docs`` that its bitmap keeps, joined by \\n."""
    maps = bitmaps.select("late", "id", "row", "keep_bitmap")
    joined = _identified(docs).join(maps, ["late", "id", "row"], "left")
    return joined.select("doc_id", "text", "keep_bitmap").mapInArrow(_apply, "doc_id long, n_lines long, n_dropped long, text string")
