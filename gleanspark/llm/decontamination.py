"""Benchmark decontamination: SimHash fingerprints of item-sized windows, a multi-index over Hamming blocks, exact check.

A window is as long as an item (or the whole text, if that is shorter) and may begin at every word.  A similarity of 3/4
needs six sevenths of the item's shingles in the window, so a start counts only where so many of the window's shingles
occur in items of its length; every start that has them is a window, whatever their order.  Every distinct window gets a
180-bit SimHash of its shingles, each weighted by how often it occurs.  Fingerprints are cut into ten blocks of 18 bits.
Two fingerprints at distance 39 or less agree in some block up to three bits: the index holds, for each block of each item,
all values within two bits, and a window looks up all values within one bit, so an equi-join finds every item within the
radius, and of unlike pairs about 4 %.  Candidates are verified by the weighted Jaccard similarity (sum of smaller over sum
of larger counts), 3/4 or more.  At a similarity of just 3/4 about one window in twenty lies beyond the radius, at 0.8 one in
a hundred; an item is found if one of its windows is.

Only DataFrame functions are used.  Shingles have five words, lower-cased; an item or text with fewer words has its whole
sequence as its one shingle.  Defined cases: null and empty texts and items match nothing; items that repeat are found
each under its own id; of equally similar windows the first is named; rows that repeat count once; texts of any length are
read whole; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import once, stored, without

#: Tables up to this many rows are broadcast, larger ones joined by a shuffle: of the benchmark and its index (tens of bytes a
#: row), of texts with windows and of windows with items (hundreds of bytes a row).
BROADCAST_ROWS, BROADCAST_ZONES, BROADCAST_WINDOWS = 500_000, 100_000, 20_000
SIZE = 5
#: Blocks of a fingerprint, bits of a block, and how many of them the index and the look-up change.
BLOCKS, BITS, ITEM_FLIPS, WINDOW_FLIPS = 10, 18, 2, 1
NEAR = ITEM_FLIPS + WINDOW_FLIPS
#: Distances up to this are found without exception: some block differs in at most NEAR bits.
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Bits that one shingle hash gives to a fingerprint.
_PER_HASH = 60


def words_of(text: Column) -> Column:
    """Lower-cased words; an empty array for a null or blank text."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))


def grams(words: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words, in order."""

    def run(w: Column) -> Column:
        n = F.size(w)
        return F.when(n < k, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, k))))

    return once(words, run)


def shingles(words: Column) -> Column:
    """Hashes of the five-word shingles in order, or of the whole sequence if it is shorter."""
    return once(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < SIZE, F.array(F.xxhash64(w))).otherwise(grams(w, SIZE)))


def fingerprint(hashes: Column) -> Column:
    """The blocks of a SimHash; a bit is set where more than half of the shingles (with repetition) have it set."""

    def again(j: int) -> Callable[[Column], Column]:
        return lambda h: F.xxhash64(h, F.lit(j))

    several = once(hashes, lambda hs: F.array(hs, *[F.transform(hs, again(j)) for j in range(1, BLOCKS * BITS // _PER_HASH)]))

    def run(hs: Column) -> Column:
        def bit(b: Column) -> Column:
            own = F.get(hs, F.floor(b / _PER_HASH).cast("int"))
            ones = once(b % _PER_HASH, lambda at: F.aggregate(own, F.lit(0), lambda a, h: a + F.getbit(h, at).cast("int")))
            return F.when(ones * 2 > F.size(own), F.lit(1)).otherwise(F.lit(0))

        return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS * BITS - 1)), bit)

    def cut(bs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: reduce(lambda x, y: x + y, [F.get(bs, b * BITS + k) * F.lit(1 << k) for k in range(BITS)]))

    return once(once(several, run), cut)


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def masks(flips: int) -> list[int]:
    """All blocks with at most ``flips`` bits set."""
    return [sum(1 << k for k in at) for n in range(flips + 1) for at in combinations(range(BITS), n)]


def _nearby(flips: int) -> list[str | Column]:
    """block, and value: every value within ``flips`` bits of the block's ``own``."""
    return ["block", F.explode(F.array(*[F.col("own").bitwiseXOR(F.lit(m)) for m in masks(flips)])).alias("value")]


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of shingle hashes, counted with repetition."""

    def run(x: Column, y: Column) -> Column:
        both = F.array_intersect(x, y)
        plain = (F.size(F.array_distinct(x)) == F.size(x)) & (F.size(F.array_distinct(y)) == F.size(y))
        counted = F.aggregate(both, F.lit(0), lambda s, h: s + F.least(F.size(F.filter(x, lambda v: v == h)), F.size(F.filter(y, lambda v: v == h))))
        return once(F.when(plain, F.size(both)).otherwise(counted), lambda s: s / (F.size(x) + F.size(y) - s))

    return once(a, lambda x: once(b, lambda y: run(x, y)))


def _bounded(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    return F.broadcast(df) if rows <= (most or BROADCAST_ROWS) else df


def _starts(num: int, den: int) -> Column:
    """Starts of the windows whose shingles occur often enough in items, from ``at`` (sorted places), ``n_words`` and ``len``."""
    size = F.least("len", F.lit(SIZE))
    own, others = F.least("n_words", "len") - size + 1, F.col("len") - size + 1
    need = F.ceil((own + others) * num / (num + den)).cast("int")
    last = F.greatest(F.col("n_words") - F.col("len"), F.lit(0))

    def run(at: Column, need: Column, own: Column) -> Column:
        def between(i: Column) -> Column:
            # All starts of windows that hold the places i to i + need - 1.
            low, high = F.greatest(F.get(at, i + need - 1) - own + 1, F.lit(0)), F.least(F.get(at, i), last)
            return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

        return F.when(F.size(at) >= need, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(at) - need, F.lit(0))), between)))).otherwise(F.array().cast("array<int>"))

    return once(F.struct(F.col("at").alias("at"), need.alias("need"), own.alias("own")), lambda x: run(x["at"], x["need"], x["own"]))


def windows_of(docs: DataFrame, bench: DataFrame, num: int, den: int) -> DataFrame | None:
    """(doc_id, row, len, start, hashes): every window that holds enough shingles of items of its length; None without items."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", F.xxhash64(text).alias("row"), text.alias("text"))
    sizes = sorted({min(r[0], SIZE) for r in bench.select(F.least("len", F.lit(SIZE))).distinct().collect()})  # five values at most
    if not sizes:
        return None
    anchors = bench.select("len", F.explode("item_shingles").alias("gram")).distinct()
    n_anchors = bench.agg(F.sum(F.size("item_shingles"))).first()[0]
    hits = []
    for k in sizes:
        # Only numbers go along with each place: an array beside it would be copied for every word.  The outer form, whose
        # nulls meet nothing, spares a filter that would compute the array again.
        cut = texts.select("doc_id", "row", words_of(F.col("text")).alias("words")).select("doc_id", "row", F.size("words").alias("n_words"), grams(F.col("words"), k).alias("grams"))
        places = cut.select("doc_id", "row", "n_words", F.posexplode_outer("grams").alias("pos", "gram"))
        hits.append(places.join(_bounded(anchors.where(F.least("len", F.lit(SIZE)) == k), n_anchors), "gram").select("doc_id", "row", "n_words", "len", "pos"))
    at = reduce(DataFrame.unionByName, hits).groupBy("doc_id", "row", "n_words", "len").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    zones = at.select("doc_id", "row", "len", _starts(num, den).alias("starts")).where(F.size("starts") > 0)
    zones = stored(zones.groupBy(F.col("doc_id").alias("z_doc"), F.col("row").alias("z_row")).agg(F.collect_list(F.struct("len", "starts")).alias("zones")), "zones")
    found = texts.join(_bounded(zones, zones.count(), BROADCAST_ZONES), F.col("doc_id").eqNullSafe(F.col("z_doc")) & (F.col("row") == F.col("z_row"))).select("doc_id", "row", "zones", words_of(F.col("text")).alias("words"))
    found = found.select("doc_id", "row", "zones", *[grams(F.col("words"), k).alias(f"grams{k}") for k in sizes]).select("*", F.explode("zones").alias("z")).select("*", F.col("z.len").alias("len"), F.explode("z.starts").alias("start"))
    window = reduce(lambda rest, k: F.when(F.least("len", F.lit(SIZE)) == k, F.slice(f"grams{k}", F.col("start") + 1, F.col("len") - k + 1)).otherwise(rest), sizes, F.lit(None).cast("array<bigint>"))
    return found.select("doc_id", "row", "len", "start", window.alias("hashes")).distinct()


def candidates(keyed: DataFrame, marked: DataFrame, n_items: int) -> DataFrame:
    """(window, item_id) of all pairs of one length that agree in some block up to NEAR bits: at least all within RADIUS.

    ``keyed`` has window, len and blocks, ``marked`` item_id, len and blocks.
    """
    index = marked.select("item_id", "len", F.posexplode("blocks").alias("block", "own")).select("item_id", "len", *_nearby(ITEM_FLIPS))
    probes = keyed.select("window", "len", F.posexplode("blocks").alias("block", "own")).select("window", "len", *_nearby(WINDOW_FLIPS))
    return probes.join(_bounded(index, n_items * BLOCKS * len(masks(ITEM_FLIPS))), ["len", "block", "value"]).select("window", "item_id").distinct()


def contaminated(docs: DataFrame, items: DataFrame, num: int = 3, den: int = 4) -> DataFrame:
    """(doc_id, row, item_id, n_windows, start, similarity): items found in texts; ``row`` tells apart texts under one id.

    ``start`` is the word (from 0) at which the most similar window begins.
    """
    bench = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).select("item_id", F.size("words").alias("len"), shingles(F.col("words")).alias("item_shingles")).distinct()
    windows = windows_of(docs, bench, num, den)
    if windows is None:
        return docs.where("false").select("doc_id", F.lit(0).cast("long").alias("row"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).cast("long").alias("n_windows"), F.lit(0).alias("start"), F.lit(0.0).alias("similarity"))
    windows = stored(windows, "windows")
    # Fingerprints depend on the shingles alone: equal windows of different texts are fingerprinted and verified once.
    distinct = windows.select("len", "hashes").distinct().select(F.monotonically_increasing_id().alias("window"), "len", "hashes", fingerprint(F.col("hashes")).alias("blocks"))
    keyed = stored(distinct, "fingerprints")
    marked = stored(bench.withColumn("blocks", fingerprint(F.col("item_shingles"))), "items")
    n_items = marked.count()
    pairs = candidates(keyed, marked, n_items)
    close = pairs.join(keyed, "window").join(_bounded(marked.select("item_id", "len", "item_shingles", F.col("blocks").alias("item_blocks")), n_items), ["item_id", "len"]).where(distance(F.col("blocks"), F.col("item_blocks")) <= RADIUS)
    like = stored(close.withColumn("similarity", similarity(F.col("hashes"), F.col("item_shingles"))).where(F.col("similarity") * den >= num).select("len", "hashes", "item_id", "similarity").distinct(), "similar")
    return (
        windows.join(_bounded(like, like.count(), BROADCAST_WINDOWS), ["len", "hashes"])
        .groupBy("doc_id", "row", "item_id")
        .agg(F.count(F.lit(1)).alias("n_windows"), F.max(F.struct("similarity", (-F.col("start")).alias("at"))).alias("best"))
        .select("doc_id", "row", "item_id", "n_windows", (-F.col("best.at")).alias("start"), F.col("best.similarity").alias("similarity"))
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, as they are, in whose text no item is found."""
    dirty = contaminated(docs, items)
    return without(docs, dirty.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"), F.col("row").alias("_text")))
