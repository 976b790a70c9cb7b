"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix with its transpose.

1. Blocks.  Texts are cut into blocks of a few MB; each block is a slab of the incidence matrix.  Its n-gram hashes are
   dealt to column ranges in sorted byte planes: an n-gram of one document with its row, one of several documents once with
   its count, so that an n-gram of any frequency sends one entry a block.
2. Columns.  A range adds up each column and returns, to each block, the columns that several documents hold.  An n-gram
   of a single document can't be part of an overlap and goes no further.
3. Rows.  A block puts its rows together again.  A document with ``n`` n-grams of which fewer than ``3n/4`` are shared
   links with nothing (size-derived bound) and leaves.  Equal sets become one class.
4. Candidates.  With columns ordered by frequency, two linked rows meet in the first ``n - ceil(3n/4) + 1`` entries of both.
   In each such column one pivot is paired with every other row (a star, linear in the column), overlaps are accumulated
   over the whole rows, and links are contracted to components.
5. Components that meet.  A column may still hold several components.  Its rows are first gathered: of the rows that agree
   in two min-hashes, for each of eight such pairs, one is paired with every other (stars again).  Where a row outside still
   meets many others a column, rounds of random matchings follow: a row goes, with a few of its columns, into small groups, in
   which one row is paired with every other; the columns double from round to round while the rows outside become fewer.
   Rows that link with a small share of all others thus grow together before any is held against all.  Then every row belongs to the ball of a row that it links
   with, the one with most links; a component has few such centres.  Rows outside a column's largest component meet the
   centres of the others, under the size and position bounds.  A row that links with the centre is connected to its whole
   ball; otherwise the Jaccard distance, which is a metric, leaves only those rows of the ball that lie at least as far
   from the centre as the row does, less 1/4, and those that it meets in a column within the bounds are verified.  So no pair of different components that
   could link is left out, and texts put together from the same passages cost rows times centres, not rows times rows.
6. Components of all links, and of all copies through their class.

The threshold is 3/4 of the union by default.  Defined cases: a null or empty text has an empty set and links with
nothing; texts of any length are read whole; equal sets are linked; of equally good pivots and centres the first node is
taken, which changes no component; rows that repeat are members of one class, each with its own result row; a null doc_id
is never a component's name while another is there; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import discard, slices, stored, without
from gleanspark.llm.components import connected_components, joined_by
from gleanspark.llm.shingles import buffers, mix, shingle_sets

#: Bytes of text in a block and in the share of a column range, and the most documents of a block.
BLOCK_BYTES, RANGE_BYTES, BLOCK_DOCS = 3_000_000, 12_000_000, 60_000
_MANY = 0xFFFF
#: Pairs of min-hashes by which the rows of columns with several components are gathered.
GATHERINGS = 8
#: Rounds of random matchings at most, a row's columns in the first one and the rows of a group; a round is due while rows
#: outside meet more than so many others a column, and while the round before linked one row of so many.
MATCHINGS, MATCHED_COLUMNS, MATCHED_ROWS, CROWD, WORTHWHILE = 24, 8, 3, 64, 64

ENTRIES = "r int, kind int, blk long, toks binary, idx binary, more binary"
_NAMES = ["r", "kind", "blk", "toks", "idx", "more"]


def _planes(a: np.ndarray) -> bytes:
    """Byte planes of sorted integers: the high ones compress well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def _unplaned(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


def _block(ids: pa.Array, marks: pa.Array, texts: pa.Array, blk: int, ranges: int, size: int) -> pa.RecordBatch:
    toks, sizes = shingle_sets(*buffers(texts), size)
    toks >>= np.uint64(8)  # 56 bits are kept: one byte plane less to deal
    docs = np.repeat(np.arange(len(sizes)), sizes)
    # Two independent sums name a set.
    name = np.zeros((len(sizes), 2), dtype=np.uint64)
    for k, salt in enumerate((0x1234567, 0xFEDCBA9)):
        total = np.r_[np.uint64(0), np.cumsum(mix(toks ^ np.uint64(salt)))]
        ends = np.cumsum(sizes)
        name[:, k] = total[ends] - total[ends - sizes]
    order = np.argsort(toks, kind="stable")
    toks, docs = toks[order], docs[order].astype(np.uint16)
    new = np.flatnonzero(np.r_[True, toks[1:] != toks[:-1]]) if len(toks) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.r_[new, len(toks)])
    many = np.repeat(counts > 1, counts)
    rows = [
        (blk % ranges, 1, blk, sizes.astype(np.int32).tobytes(), ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).tobytes(), name.tobytes() + marks.to_numpy(zero_copy_only=False).tobytes() + ids.is_null().to_numpy(zero_copy_only=False).tobytes()),
        (blk % ranges, 2, blk, _planes(toks[many]), _planes(docs[many]), b""),
    ]
    heads, owners = toks[new], np.where(counts > 1, np.uint16(_MANY), docs[new])
    bounds = np.searchsorted(_range_of(heads, ranges), np.arange(ranges + 1))
    for r in np.flatnonzero(np.diff(bounds)):
        part = slice(bounds[r], bounds[r + 1])
        c = counts[part]
        rows.append((int(r), 0, blk, _planes(heads[part]), _planes(owners[part]), c[c > 1].astype(np.uint32).tobytes()))
    return _rows(rows)


def _range_of(toks: np.ndarray, ranges: int) -> np.ndarray:
    return ((toks >> np.uint64(24)) * np.uint64(ranges)) >> np.uint64(32)


def _to_blocks(ranges: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, starts = buffers(batch.column("text"))
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(starts, starts[at] + BLOCK_BYTES, "right")) - 1
                to = min(max(to, at + 1), at + BLOCK_DOCS, batch.num_rows)
                piece = batch.slice(at, to - at)
                blk = xxhash.xxh64_intdigest(f"{part}:{nth}") >> 1
                yield _block(piece.column("doc_id"), piece.column("row"), piece.column("text"), blk, ranges, size)
                at, nth = to, nth + 1

    return run


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: the columns that several documents hold, with their frequency, back to each block."""
    toks, idx, weights, blks = [], [], [], []
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        passed = kinds != 0
        if passed.any():
            yield batch.filter(pa.array(passed))
        for row in batch.filter(pa.array(~passed)).to_pylist():
            t, o = _unplaned(row["toks"], np.uint64), _unplaned(row["idx"], np.uint16)
            w = np.ones(len(t), dtype=np.int64)
            w[o == _MANY] = np.frombuffer(row["more"], np.uint32)
            toks.append(t)
            idx.append(o)
            weights.append(w)
            blks.append(row["blk"])
    if not toks:
        return
    sizes = [len(t) for t in toks]
    t = np.concatenate(toks)
    order = np.argsort(t, kind="stable")
    s = t[order]
    new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    total = np.add.reduceat(np.concatenate(weights)[order], new)
    df = np.empty(len(t), dtype=np.int64)
    df[order] = np.repeat(total, np.diff(np.r_[new, len(s)]))
    df = np.minimum(df, 2**32 - 1).astype(np.uint32)
    at, rows = 0, []
    for blk, own, o, n in zip(blks, toks, idx, sizes, strict=True):
        d = df[at : at + n]
        at += n
        if (keep := d > 1).any():
            rows.append((0, 3, blk, _planes(own[keep]), _planes(o[keep]), _planes(d[keep])))
    if rows:
        yield _rows(rows)


def _to_rows(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        sizes = ids = names = marks = null = None
        pairs, found = [], []
        for row in table.select(["kind", "toks", "idx", "more"]).to_pylist():
            if row["kind"] == 1:
                sizes, ids = np.frombuffer(row["toks"], np.int32), np.frombuffer(row["idx"], np.int64)
                k, more = len(sizes), row["more"]
                names, marks, null = more[: 16 * k], np.frombuffer(more[16 * k : 24 * k], np.int64), np.frombuffer(more[24 * k :], bool)
            elif row["kind"] == 2:
                pairs.append((_unplaned(row["toks"], np.uint64), _unplaned(row["idx"], np.uint16)))
            else:
                found.append((_unplaned(row["toks"], np.uint64), _unplaned(row["idx"], np.uint16), _unplaned(row["more"], np.uint32)))
        t, o, d = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind) for k, kind in enumerate((np.uint64, np.uint16, np.uint32)))
        several = o == _MANY
        heads, heads_df = t[several], d[several]
        by = np.argsort(heads)
        heads, heads_df = heads[by], heads_df[by]
        lt, lo = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, kind) for k, kind in enumerate((np.uint64, np.uint16)))
        t, o, d = np.r_[t[~several], lt], np.r_[o[~several], lo].astype(np.int64), np.r_[d[~several], heads_df[np.searchsorted(heads, lt)] if len(lt) else np.zeros(0, np.uint32)]
        n = len(sizes)
        shared = np.bincount(o, minlength=n)
        stays = (den * shared >= num * sizes) & (sizes > 0)
        keep = stays[o]
        t, o, d = t[keep], o[keep], d[keep]
        order = np.lexsort((t, d, o))
        lengths = np.where(stays, shared, 0)
        toks = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(t[order].view(np.int64)), mask=pa.array(~stays))
        return pa.table([pa.array(ids, mask=null), pa.array(marks), pa.array([names[16 * i : 16 * i + 16] for i in range(n)], pa.binary()), pa.array(sizes.astype(np.int64)), toks], names=["doc_id", "row", "set", "n", "toks"])

    return run


def incidence(docs: DataFrame, size: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """(doc_id, row, set, n, toks) of every row: the set's name and size, and its shared n-grams, rarest first.

    ``row`` is a short hash of the text; ``toks`` is null where too few n-grams are shared for any link.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = slices(spark, total, RANGE_BYTES)
    blocks = texts.mapInArrow(_to_blocks(ranges, size), ENTRIES)
    columns = blocks.repartitionById(ranges, "r").mapInArrow(_columns, ENTRIES)
    return columns.groupBy("blk").applyInArrow(_to_rows(num, den), "doc_id long, row long, set binary, n long, toks array<long>")


def _bounded(num: int, den: int) -> Column:
    """Whether two rows that meet at positions p and q can still overlap enough."""
    left = F.least(F.col("n") - F.col("pos"), F.col("other_n") - F.col("other_pos"))
    return ((den + num) * left >= num * (F.col("n") + F.col("other_n"))) & (den * F.least("n", "other_n") >= num * F.greatest("n", "other_n"))


def _measured(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) with their overlap, accumulated over the whole rows, and their union."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    met = pairs.join(a, "a").join(b, "b").withColumn("overlap", F.size(F.array_intersect("ta", "tb")).cast("long"))
    return met.select(*pairs.columns, "overlap", (F.col("na") + F.col("nb") - F.col("overlap")).alias("all"))


def _link(num: int, den: int) -> Column:
    return den * F.col("overlap") >= num * F.col("all")


def _balls(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, center, far): to each of ``nodes`` the row with most links among itself and those it links with, and its distance."""
    both = links.select("a", "b", "far").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "far"))
    degree = both.groupBy(F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("links"))
    best = both.join(degree, "b").groupBy(F.col("a").alias("node")).agg(F.max(F.struct("links", (-F.col("b")).alias("at"), "far")).alias("best"))
    own = degree.select(F.col("b").alias("node"), "links")
    at = nodes.join(best, "node", "left").join(own, "node", "left")
    itself = F.col("best").isNull() | (F.struct(F.coalesce("links", F.lit(0)), -F.col("node")) >= F.struct(F.col("best.links"), F.col("best.at")))
    return at.select("node", F.when(itself, F.col("node")).otherwise(-F.col("best.at")).alias("center"), F.when(itself, F.lit(0.0)).otherwise(F.col("best.far")).alias("far"))


def _gathered(named: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, all, overlap): rows of (node, comp) that agree in a pair of min-hashes, each with the first of them."""
    least = lambda k: F.array_min(F.transform("toks", lambda t: F.xxhash64(t, F.lit(k))))
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.xxhash64(least(2 * k), least(2 * k + 1)).alias("h")) for k in range(GATHERINGS)])
    rows = stored(named.join(nodes, "node").select("node", "comp", "n", F.explode(keys).alias("key")).select("node", "comp", "n", "key.k", "key.h"), "minhashes")
    firsts = stored(rows.groupBy("k", "h").agg(F.min(F.struct("node", "comp", "n")).alias("p")).select("k", "h", F.col("p.node").alias("b"), F.col("p.comp").alias("comp_b"), F.col("p.n").alias("nb")), "firsts")
    pairs = rows.join(firsts, ["k", "h"]).where((F.col("comp") != F.col("comp_b")) & (den * F.least("n", "nb") >= num * F.greatest("n", "nb")))
    return _measured(stored(pairs.select(F.col("node").alias("a"), "b").distinct(), "gathered"), nodes)


def _still_mixed(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """(tok, node, n, pos, comp, main, size) of the columns in which several components are; ``main`` is the one with most rows."""
    named = rows.select("tok", "node", "n", "pos").join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    counts = named.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("rows"))
    mixed = counts.groupBy("tok").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("rows", "comp")).alias("main"), F.sum("rows").alias("size")).where("comps > 1").select("tok", "main", "size")
    return stored(named.join(stored(mixed, "mixed"), "tok"), "named")


def _matched(named: DataFrame, nodes: DataFrame, nth: int, num: int, den: int) -> DataFrame:
    """(a, b, overlap, all): rows of different components that meet in a random group of a column, each with one row of it.

    A column's hash says which rows take part with it, so that rows choose the same columns.
    """
    drawn = F.xxhash64("tok", F.lit(nth)).bitwiseAND(F.lit(2**31 - 1)) / 2**31
    takes_part = drawn * F.col("n") * (den - num) < F.lit(MATCHED_COLUMNS * 2**nth * den)
    group = F.pmod(F.xxhash64("node", "tok", F.lit(nth)), F.ceil(F.col("size") / MATCHED_ROWS)).alias("group")
    rows = named.where(takes_part).select("tok", group, "node", "comp", "n", "pos", (F.col("comp") != F.col("main")).alias("outside"))
    one = rows.groupBy("tok", "group").agg(F.min(F.struct("outside", "node", "comp", "n", "pos")).alias("p"))
    one = one.select("tok", "group", F.col("p.node").alias("other"), F.col("p.comp").alias("other_comp"), F.col("p.n").alias("other_n"), F.col("p.pos").alias("other_pos"))
    pairs = rows.join(one, ["tok", "group"]).where((F.col("comp") != F.col("other_comp")) & _bounded(num, den))
    return _measured(stored(pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "matched"), nodes)


def met_components(entries: DataFrame, nodes: DataFrame, links: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(node, component) of all rows that link with any, from the links (a, b, far) of stars; and the last pairs measured."""
    far = (1 - F.col("overlap") / F.col("all")).alias("far")
    comps = stored(connected_components(links.select("a", "b")), "components")
    meeting = _still_mixed(entries, comps)
    gathered = stored(_gathered(meeting.select("node", "comp").distinct(), nodes, num, den).where(_link(num, den)).select("a", "b", far), "gathered")
    named = meeting
    if not gathered.isEmpty():
        links, comps = links.unionByName(gathered), joined_by(comps, gathered.select("a", "b"))
        named = _still_mixed(meeting, comps)
        discard(meeting)
    tried = []
    for nth in range(MATCHINGS):
        outside = named.where("comp <> main").agg(F.count_distinct("node"), F.avg("size")).first()
        if not outside[0] or outside[1] <= CROWD:
            break
        tried.append(stored(_matched(named, nodes, nth, num, den), "tried"))
        matched = tried[-1].where(_link(num, den)).select("a", "b", far)
        found = matched.count()
        if found:
            links, comps = links.unionByName(matched), joined_by(comps, matched.select("a", "b"))
            before, named = named, _still_mixed(named, comps)
            discard(before)
        if found * WORTHWHILE < outside[0]:
            break
    balls = stored(_balls(links, named.select("node").distinct()), "balls")
    members = named.join(balls, "node").select("tok", "center", "comp", "node", "n", "pos", "far")
    held = members.groupBy("tok", "center", "comp").agg(F.max(F.col("n") - F.col("pos")).alias("left"), F.min("n").alias("low"), F.max("n").alias("high"))
    outside = named.where("comp <> main").select("tok", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pos_a"), (F.col("n") - F.col("pos")).alias("left_a"), F.col("comp").alias("comp_a"))
    # The bounds of two rows, as loose as some row of the ball makes them.
    may = ((den + num) * F.least("left", "left_a") >= num * (F.col("low") + F.col("na"))) & (den * F.col("na") >= num * F.col("low")) & (den * F.col("high") >= num * F.col("na"))
    near = outside.join(stored(held, "held"), "tok").where((F.col("comp") != F.col("comp_a")) & may).select("a", F.col("center").alias("b")).distinct()
    centred = stored(_measured(stored(near, "near"), nodes), "centred")
    more = centred.where(_link(num, den)).select("a", "b")
    # Rows that may link with a ball's row though not with its centre.
    comps = joined_by(comps, more)
    comp_of = lambda node, name: comps.select(F.col("node").alias(node), F.col("component").alias(name))
    slack = (den - num) / den + 1e-9
    apart = far.alias("apart")
    reach = balls.where("far > 0").groupBy("center").agg(F.max("far").alias("reach"))
    open_ = centred.where(~_link(num, den)).select("a", F.col("b").alias("center"), apart).join(reach, "center").where(F.col("apart") <= F.col("reach") + slack)
    again = outside.select("tok", "a", F.col("na").alias("other_n"), F.col("pos_a").alias("other_pos")).join(stored(open_, "open"), "a")
    inside = stored(again, "again").join(members.where("far > 0"), ["tok", "center"]).where((F.col("far") >= F.col("apart") - slack) & _bounded(num, den)).select("a", F.col("node").alias("b")).distinct()
    inside = inside.join(comp_of("a", "comp_a"), "a", "left").join(comp_of("b", "comp_b"), "b", "left").where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b"))
    single = stored(_measured(stored(inside.select("a", "b"), "inside"), nodes), "single")
    last = stored(single.where(_link(num, den)).select("a", "b"), "last")
    measured = centred.select("a", "b").unionByName(single.select("a", "b"))
    for pairs in tried:
        measured = measured.unionByName(pairs.select("a", "b"))
    return joined_by(comps, last), measured


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, row) of every row; sets link when den * overlap >= num * union."""
    rows = stored(incidence(docs, size, num, den), "incidence")
    classes = rows.where("toks IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("label"), F.first("n").alias("n"), F.first("toks").alias("toks"))
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    lost = F.col("n") - F.size("toks")
    prefix = F.col("n") - F.ceil(F.col("n") * num / den) + 1 - lost
    every = nodes.select("node", "n", lost.alias("lost"), F.posexplode(F.slice("toks", 1, F.greatest(prefix, F.lit(0)).cast("int"))).alias("k", "tok"))
    # Columns that several classes meet in; those that only copies share are done with.
    met = every.groupBy("tok").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("tok")
    entries = stored(every.select("tok", "node", F.col("n").cast("int").alias("n"), (F.col("lost") + F.col("k")).cast("int").alias("pos")).join(met, "tok", "left_semi"), "entries")
    # Stored, so that the joins below stand on plain shuffles, which Spark can split where a column is long.
    columns = entries.groupBy("tok").agg(F.min(F.struct((F.col("pos") / F.col("n")).alias("share"), "node", "n", "pos")).alias("p"))
    pivots = stored(columns.select("tok", F.col("p.node").alias("other"), F.col("p.n").alias("other_n"), F.col("p.pos").alias("other_pos")), "pivots")
    stars = entries.join(pivots, "tok")
    pair = [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]
    star_pairs = stored(stars.where((F.col("node") != F.col("other")) & _bounded(num, den)).select(*pair).distinct(), "stars")
    discard(pivots)
    links = stored(_measured(star_pairs, nodes).where(_link(num, den)).select("a", "b", (1 - F.col("overlap") / F.col("all")).alias("far")), "links")
    discard(star_pairs)
    comps, _ = met_components(entries, nodes, links, num, den)
    discard(entries)

    members = nodes.select("set", "label", "node").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = members.groupBy("component").agg(F.min("label").alias("component_id"))
    named_sets = members.join(names, "component").select("set", "component_id")
    # Rows that can't link pass the join by: most rows may be such ones.
    kept = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "row"]
    met = rows.where("toks IS NOT NULL").join(named_sets, "set").select(*kept)
    return met.unionByName(rows.where("toks IS NULL").withColumn("component_id", F.lit(None).cast("long")).select(*kept))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, as they are, whose doc_id names its component; rows of one doc_id count as one document."""
    found = near_duplicates(docs).where("NOT doc_id <=> component_id")
    return without(docs, found.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"), F.col("row").alias("_text")))
