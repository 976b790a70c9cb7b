"""Exact dedup: a log-structured merge index of text digests.

A memtable holds a narrow row for each digest of its documents: smallest and largest identifier, rows, documents.  It is
flushed as a run, sorted by digest, beside a filter with a bit for every slot that a digest of the run falls into.  Compaction
merges the runs of a level, a few at a time and all in one job, into runs of the next, until one is left.  It asks the filters
first, at every level and size, by a join on run and bucket: a row whose slot is in no other run of its group is written on as
it is, and only the others are shuffled by digest and merged.  A look-up asks a run's filter before it reads the run.

A digest that holds more than one document is a hit; the texts of hits are compared byte by byte, and a group that turns
out to hold several texts (a digest collision) is regrouped by the texts themselves.

Defined cases: a null text counts as empty; texts of any length are compared whole; rows that repeat both ``doc_id`` and
text are one document (the result holds it once, ``group_size`` counts all of its rows); equal identifiers are the only
ties; a null ``doc_id`` is never preferred over another; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm.common import stored, without, work_dir, wrapped

#: Hit digests up to this many (8 bytes each) are broadcast to filter the texts that need verification; more are joined.
BROADCAST_HITS = 2_000_000

#: Rows of a memtable, memtables at least and at most (then they grow), runs that one compaction merges, and bits of a filter
#: for each row.
MEMTABLE_ROWS, LEAST_MEMTABLES, MOST_MEMTABLES, FAN_IN, BITS_A_ROW = 4_000_000, 4, 64, 4, 16

#: Bits of the bitmaps that filters are kept in, and up to how many bits of filters (32 MB) their join is hinted as a broadcast.
BITMAP, MOST_BROADCAST_BITS = 32_768, 1 << 28
#: What a row of a run holds beside its digest, and how rows of one digest are merged.
MERGED = {"least_id": F.min, "largest_id": F.max, "group_size": F.sum, "members": F.sum}

DIGESTS = {
    "sha256": lambda text: F.unhex(F.sha2(text, 256)),
    "crc32": lambda text: F.crc32(text).cast("string").cast("binary"),
}


def _sorted(df: DataFrame, *by: str) -> DataFrameWriter:
    return df.sortWithinPartitions(*by).write


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


@dataclass(frozen=True)
class Run:
    """A flushed or merged run: a part of the tables of rows and of filters that were written with it, and its filter's slots."""

    path: str
    part: int
    slots: int


def _slot(digest: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(slots))


def _has(bits: Column, slot: Column) -> Column:
    """Whether the bit of a slot is set in the bitmap of its bucket (null: no bit is)."""
    at = slot % BITMAP
    byte = F.conv(F.hex(F.substr(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


class DigestIndex:
    """Levels of runs in the shared folder; level 0 is as flushed."""

    def __init__(self, spark: SparkSession, path: str | None = None, memtable_rows: int = MEMTABLE_ROWS) -> None:
        self.spark, self.path, self.memtable_rows = spark, path or f"{work_dir(spark)}-digests", memtable_rows
        self.levels: list[list[Run]] = []
        self.written = 0

    def _new(self, level: int) -> str:
        self.written += 1
        return f"{self.path}/l{level}-{self.written}"

    def _write(self, level: int, rows: DataFrame) -> None:
        """Write rows (part, digest, ...) sorted, so that each part is a run, and their filters; hang the runs into their level.

        Parts share files, so that there are no more files than tasks; pages of other parts are skipped when one is read.
        """
        path, slots = self._new(level), -(-BITS_A_ROW * self.memtable_rows * FAN_IN**level // BITMAP) * BITMAP
        _sorted(rows, "part", "digest").parquet(path)
        slot = _slot(F.col("digest"), slots)
        bits = self.spark.read.schema(rows.schema).parquet(path).groupBy("part", F.floor(slot / BITMAP).alias("bucket")).agg(F.bitmap_construct_agg((slot % BITMAP).cast("long")).alias("seen"))
        bits.write.parquet(f"{path}-filter")
        parts = sorted(r[0] for r in self.spark.read.schema(bits.schema).parquet(f"{path}-filter").select("part").distinct().collect())
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level] += [Run(path, i, slots) for i in parts]

    def _rows(self, run: Run) -> DataFrame:
        return self.spark.read.parquet(run.path).where(F.col("part") == run.part).select("digest", *MERGED)

    def _filter(self, run: Run) -> DataFrame:
        return self.spark.read.parquet(f"{run.path}-filter").where(F.col("part") == run.part).select("bucket", "seen")

    def _read(self, runs: list[Run], suffix: str = "") -> DataFrame:
        """The rows (or filters) of several runs, each table read once, with the number of the run among them."""

        def numbered(path: str) -> DataFrame:
            number = F.create_map(*[F.lit(x) for i, r in enumerate(runs) if r.path == path for x in (r.part, i)])
            return self.spark.read.parquet(path + suffix).withColumn("run", F.try_element_at(number, F.col("part"))).where("run IS NOT NULL").drop("part")

        return reduce(DataFrame.unionByName, [numbered(path) for path in sorted({r.path for r in runs})])

    def flush(self, entries: DataFrame, memtables: int = 1) -> None:
        """Write ``entries`` (digest, doc_id, copies; a row for each document) as at most that many runs."""
        dealt = entries.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(memtables)).cast("int").alias("part"), "digest")
        members = F.count(F.lit(1)).alias("members")
        self._write(0, dealt.agg(F.min("doc_id").alias("least_id"), F.max("doc_id").alias("largest_id"), F.sum("copies").alias("group_size"), members))

    def compact(self, level: int) -> None:
        """Merge the runs of a level, at most FAN_IN at a time, into runs of the next."""
        runs, self.levels[level] = self.levels[level], []
        if not runs:
            return
        rows = self._read(runs).withColumn("part", F.floor(F.col("run") / FAN_IN).cast("int"))
        # For each run the slots that the others of its group have.
        numbers = range(len(runs))
        others = F.array(*[F.array(*[F.lit(i) for i in numbers if i != j and i // FAN_IN == j // FAN_IN]).cast("array<int>") for j in numbers])
        bits = self._read(runs, "-filter").select(F.explode(F.get(others, F.col("run"))).alias("run"), "bucket", "seen").groupBy("run", "bucket").agg(F.bitmap_or_agg("seen").alias("seen"))
        bits = F.broadcast(bits) if sum(r.slots for r in runs) <= MOST_BROADCAST_BITS else bits
        slot = _slot(F.col("digest"), runs[0].slots)
        marked = rows.withColumn("bucket", F.floor(slot / BITMAP)).join(bits, ["run", "bucket"], "left").withColumn("shared", _has(F.col("seen"), slot))
        shared = marked.where("shared").groupBy("part", "digest").agg(*[f(c).alias(c) for c, f in MERGED.items()])
        self._write(level + 1, marked.where("NOT shared").select("part", "digest", *MERGED).unionByName(shared))

    def merged(self) -> DataFrame:
        """All levels compacted into one run: a row per digest, smallest and largest identifier, rows and distinct documents."""
        level = 0
        while level == 0 or sum(len(x) for x in self.levels[level:]) > 1:
            if level < len(self.levels) and self.levels[level]:
                self.compact(level)
            level += 1
        return self._rows(self.levels[-1][0])

    def candidates(self, run: Run, digests: DataFrame) -> DataFrame:
        """Those of ``digests`` (digest) that the filter of a run lets through."""
        slot = _slot(F.col("digest"), run.slots)
        bits = self._filter(run)
        bits = F.broadcast(bits) if run.slots <= MOST_BROADCAST_BITS else bits
        return digests.withColumn("bucket", F.floor(slot / BITMAP)).join(bits, "bucket").where(_has(F.col("seen"), slot)).select("digest")

    def lookup(self, digests: DataFrame) -> tuple[DataFrame, list[Run]]:
        """The rows under some digests in all runs, one for each run that has them, and the runs that had to be read."""
        read, found = [], []
        for runs in self.levels:
            for run in runs:
                maybe = stored(self.candidates(run, digests), "candidates")
                if not maybe.isEmpty():
                    read.append(run)
                    found.append(self._rows(run).drop("members").join(maybe, "digest", "left_semi"))
        empty = digests.where("false").select("digest", F.lit(None).cast("long").alias("least_id"), F.lit(None).cast("long").alias("largest_id"), F.lit(0).cast("long").alias("group_size"))
        return reduce(DataFrame.unionByName, found, empty), read


def verified_apart(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """The digests among ``hits`` under which more than one text is found: bytes are compared, not digests.

    ``docs`` has digest and text.  A group is of one text exactly when its smallest and largest text are equal; both are
    partial aggregates, so a group of any size sends one row per task.
    """
    keys = hits.select(F.xxhash64("digest").alias("_h"))
    n = keys.count()
    keyed = docs.withColumn("_h", F.xxhash64("digest"))
    suspects = keyed.join(F.broadcast(keys) if n <= BROADCAST_HITS else keys, "_h", "left_semi")
    return suspects.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select("digest")


def decisions(docs: DataFrame, keep: str = "min", digest: str = "sha256") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, copies, row), one row per distinct document.

    ``copies`` counts the rows that repeat it, and ``row`` is a short hash of its text.

    Of equal texts the row with the smallest (``keep="min"``) or largest (``"max"``) doc_id stays.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be 'min' or 'max', not {keep!r}")
    spark = docs.sparkSession
    texts = docs.select("doc_id", text_of(F.col("text")).alias("text")).withColumn("digest", DIGESTS[digest](F.col("text")))
    sha = F.lower(F.hex("digest")) if digest == "sha256" else F.sha2("text", 256)
    row = F.xxhash64("text").alias("row")
    entries = texts.select("doc_id", "digest", sha.alias("text_sha256"), row).groupBy("doc_id", "digest", "text_sha256", "row").agg(F.count(F.lit(1)).alias("copies"))

    log = stored(entries, "entries")
    n = log.count()
    memtables = min(max(LEAST_MEMTABLES, -(-n // MEMTABLE_ROWS)), MOST_MEMTABLES)
    index = DigestIndex(spark, memtable_rows=max(1, -(-n // memtables)))
    if n:
        index.flush(log.select("digest", "doc_id", "copies"), memtables)
    merged = index.merged() if n else log.select("digest", F.col("doc_id").alias("least_id"), F.col("doc_id").alias("largest_id"), F.col("copies").alias("group_size"), F.lit(1).cast("long").alias("members"))
    apart = stored(verified_apart(texts.select("digest", "text"), merged.where("members > 1 OR group_size > 1")), "apart")

    keep_id = F.col("largest_id" if keep == "max" else "least_id")
    out = lambda df: df.select("doc_id", keep_id.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256", "copies", "row")
    if apart.isEmpty():
        return out(log.join(merged.select("digest", "least_id", "largest_id", "group_size"), "digest"))
    # A collision: those digests are grouped by the texts themselves.
    sound = out(log.join(apart, "digest", "left_anti").join(merged.select("digest", "least_id", "largest_id", "group_size"), "digest"))
    mixed = texts.join(apart, "digest", "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    by_text = mixed.groupBy("text").agg(F.min("doc_id").alias("least_id"), F.max("doc_id").alias("largest_id"), F.sum("copies").alias("group_size"))
    return sound.unionByName(out(mixed.join(by_text, "text").withColumns({"text_sha256": F.sha2("text", 256), "row": F.xxhash64("text")})))


def exact_dedup(docs: DataFrame, keep: str = "min", digest: str = "sha256") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per distinct document."""
    return decisions(docs, keep, digest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def deduplicated(docs: DataFrame, keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, as they are: one of each text, also where a row repeats."""
    found = stored(decisions(docs, keep), "decisions")
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"), F.col("row").alias("_text")]
    out = without(docs, found.where("NOT kept").select(*key))
    repeated = found.where("kept AND copies > 1").select(*key)
    if repeated.isEmpty():
        return out
    again = wrapped(docs).join(repeated, ["_id", "_text"], "left_semi")
    one = again.groupBy("_id", "_text").agg(F.first("whole").alias("whole")).select("whole.*")
    return without(out, repeated).unionByName(one)
