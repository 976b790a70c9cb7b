"""Embedding near-dedup: pairs of vectors with a cosine of at least 0.95, by product quantisation.

Index.  Different vectors, made unit vectors, go to the nearest of some coarse centroids (an inverted list each); the residual
is cut into subspaces and stored as a code each, with the exact distance between the vector and what its codes stand for.
Centroids and codewords are fitted on a bounded sample; every vector is indexed.

Balls.  Near copies may hold a large share of all rows, and their pairs must not be listed.  In the order of list and codes,
near copies are neighbours: each batch picks leaders greedily, and rows within half the threshold's angle of a leader join its
ball.  Leaders of balls are dealt and merged the same way until no round gains.  Any two members of a ball are linked, so
they are counted, not compared.

Search.  Balls are compared instead of rows.  A ball probes the lists nearest to its centre; there, distances to quantised
centres come from one table of products with codewords a query and one stored number an item.  A candidate is kept if its
distance can be within the threshold, given both radii and the quantisation error that was stored for it, so within a probed
list nothing is lost.  Pairs are found from either side.  Centres are then compared exactly: two single vectors are linked or
not; two balls are linked in all pairs, in none, or their members are compared exactly, block against block.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components, and those whose number of components
is not the usual one (the most frequent), link with nothing and are kept; equal vectors are one point that counts its rows;
rows that repeat an id are links of one another if their vectors are near; a null id is a row like any other, and is the
smallest of its group only if there is no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import stored
from gleanspark.llm.components import connected_components
from gleanspark.llm.vectors import finite, matrix, usual_size

THRESHOLD = 0.95
#: Vectors that the index is fitted on, items of a list that are aimed at, and lists at most.
SAMPLE, LIST, MOST_LISTS = 65_536, 512, 4096
#: Subspaces, codewords of each, rounds of fitting.
SUBSPACES, CODEWORDS, FIT_ROUNDS = 8, 256, 8
#: Rows among which leaders are picked at once, queries and items that meet in one step, rows of a partition.
PICK, QUERIES, ITEMS, SLICE = 2048, 256, 4096, 100_000
#: What rounding may do to a cosine or an angle, and to a distance in float32.
SURE, ROUGH = 1e-9, 1e-4


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    step = max(1, 4_000_000 // max(1, len(centres)))
    return np.concatenate([(x[i : i + step] @ centres.T - half).argmax(1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, int)


def _fitted(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres of k-means from random starts; one without points stays where it is."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(FIT_ROUNDS):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros(centres.shape)
        np.add.at(sums, own, x)
        centres[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(x.dtype)
    return centres


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, whatever their scale."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Quantiser:
    """Coarse centroids, and codewords of residuals for each subspace; vectors are padded to whole subspaces."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        self.d = sample.shape[1]
        x = self.padded(sample.astype(np.float32))
        self.centres = _fitted(x, lists, 1)
        rest = x - self.centres[_nearest(x, self.centres)]
        self.words = [_fitted(np.ascontiguousarray(part), CODEWORDS, 2 + i) for i, part in enumerate(np.split(rest, SUBSPACES, axis=1))]

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, -x.shape[1] % SUBSPACES)))

    def encode(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, distance to what they stand for) of unit vectors."""
        x = self.padded(u.astype(np.float32))
        own = _nearest(x, self.centres)
        rest = x - self.centres[own]
        codes = np.stack([_nearest(part, w) for part, w in zip(np.split(rest, SUBSPACES, axis=1), self.words, strict=True)], axis=1).astype(np.uint8)
        return own.astype(np.int32), codes, np.sqrt(((rest - self.decoded(codes)) ** 2).sum(1))

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([w[codes[:, m]] for m, w in enumerate(self.words)], axis=1)

    def probes(self) -> int:
        """How many lists a query looks into: more lists, more of them near the edge of a cell."""
        return min(len(self.centres), max(4, math.ceil(2 * math.log2(len(self.centres))) - 4)) if len(self.centres) > 1 else 1

    def squared(self, queries: np.ndarray, item_codes: np.ndarray, item_list: int) -> np.ndarray:
        """Squared distances of queries to quantised items of one list, from tables of products with codewords."""
        q = self.padded(queries)
        items = self.centres[item_list] + self.decoded(item_codes)
        out = (q * q).sum(1)[:, None] + (items * items).sum(1)[None] - 2 * (q @ self.centres[item_list])[:, None]
        for m, (part, w) in enumerate(zip(np.split(q, SUBSPACES, axis=1), self.words, strict=True)):
            out -= 2 * (part @ w.T).take(item_codes[:, m], axis=1)
        return out


def picked(u: np.ndarray, least: float) -> np.ndarray:
    """The leader (row number) of every row: a row that no earlier leader reaches leads those that it reaches itself."""
    leader = np.arange(len(u))
    near = u @ u.T >= least
    free = np.ones(len(u), dtype=bool)
    for i in np.flatnonzero(near.sum(1) > 1):
        if free[i]:
            own = near[i] & free
            leader[own], free[own] = i, False
    return leader


def _ordered(df: DataFrame, rows: int) -> DataFrame:
    """In the order of list and codes, dealt over partitions of about equal size whatever the size of a list."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(20_000, -(-rows // SLICE)))
    keys = [F.col("list"), F.col("codes"), F.col("uid")]
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def _leaders(items: DataFrame, rows: int, d: int, least: float) -> DataFrame:
    """(uid, leader) of items (uid, list, codes, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PICK):
                part = batch.slice(i, PICK)
                uid = part.column("uid").to_numpy()
                yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array(uid[picked(unit(matrix(part.column("v"), d)), least)])], names=["uid", "leader"])

    return _ordered(items, rows).select("uid", "v").mapInArrow(run, "uid long, leader long")


def _cosine(a: Column, b: Column) -> Column:
    """Of vectors that were made unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _balls(items: DataFrame, n: int, d: int, cosine: float) -> DataFrame:
    """(uid, ball): every item within half the threshold's angle of its ball's centre, which is an item too."""
    least = math.cos(math.acos(cosine) / 2) + SURE
    found = stored(_leaders(items, n, d, least), "leaders")
    while True:
        heavy = found.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("leader").alias("uid"))
        tops = stored(items.join(heavy, "uid"), "tops")
        before = tops.count()
        if before < 2:
            return found
        merged = stored(_leaders(tops, before, d, least).where("uid <> leader"), "merged")
        if merged.isEmpty():
            return found
        # Members move to the leader of their leader where it is near enough to themselves.
        top = merged.select(F.col("uid").alias("leader"), F.col("leader").alias("top")).join(tops.select(F.col("uid").alias("top"), F.col("v").alias("tv")), "top")
        moved = found.join(top, "leader", "left").join(items.select("uid", F.col("v").alias("own")), "uid")
        found = stored(moved.select("uid", F.when(_cosine(F.col("own"), F.col("tv")) >= least, F.col("top")).otherwise(F.col("leader")).alias("leader")), "leaders")
        after = found.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()
        if after > 0.9 * before:
            return found


def _packed(df: DataFrame, key: str, fields: list[str], most: int) -> DataFrame:
    """(key, cells): the rows of a key as lists of structs of about ``most`` at most, so that no key is one row."""
    sizes = df.groupBy(key).agg((F.floor(F.count(F.lit(1)) / most) + 1).alias("_n"))
    dealt = df.join(sizes, key).withColumn("_slot", F.pmod(F.xxhash64(fields[0]), F.col("_n")))
    return dealt.groupBy(key, "_slot").agg(F.collect_list(F.struct(*fields)).alias("cells")).drop("_slot")


def _field(cells: pa.Array, name: str) -> pa.Array:
    return cells.field(name)


def _candidates(quantiser: Quantiser, balls: DataFrame, cosine: float) -> DataFrame:
    """(a, b), a < b: balls whose centres may be near enough for members to be linked."""
    spark, d, angle = balls.sparkSession, quantiser.d, math.acos(cosine)
    model, probes = spark.sparkContext.broadcast(quantiser), quantiser.probes()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = model.value
        half = (q.centres * q.centres).sum(1) / 2
        for batch in batches:
            for i in range(0, batch.num_rows, PICK):
                part = batch.slice(i, PICK)
                u = matrix(part.column("v"), d).astype(np.float32)
                # A wide ball looks into twice as many lists: its members may be nearer to others than its centre is.
                wide = part.column("radius").to_numpy() > SURE
                reach = min(len(q.centres), 2 * probes if wide.any() else probes)
                score = q.padded(u) @ q.centres.T - half
                lists = np.argsort(-score, axis=1, kind="stable")[:, :reach].astype(np.int32)
                row, nth = np.nonzero(np.arange(reach)[None] < np.where(wide, 2 * probes, probes)[:, None])
                at = pa.array(row)
                vectors = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * d), len(row), [None, pa.py_buffer(np.ascontiguousarray(u[row]).tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(lists[row, nth]), part.column("uid").take(at), part.column("radius").take(at), vectors.cast(pa.binary())], names=["list", "uid", "radius", "v"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = model.value
        for batch in batches:
            for r in range(batch.num_rows):
                asked, there = batch.column("queries")[r].values, batch.column("items")[r].values
                qid, qr = asked.field("uid").to_numpy(), asked.field("radius").to_numpy()
                u = np.frombuffer(b"".join(asked.field("v").to_pylist()), np.float32).reshape(-1, d)
                iid, ir, ie = (there.field(c).to_numpy() for c in ("uid", "radius", "error"))
                codes = np.frombuffer(b"".join(there.field("codes").to_pylist()), np.uint8).reshape(-1, SUBSPACES)
                for i in range(0, len(u), QUERIES):
                    far = np.minimum(math.pi, angle + qr[i : i + QUERIES, None] + ir[None])
                    bound = 2 * np.sin(far / 2) + ie[None] + ROUGH
                    a, b = np.nonzero(q.squared(u[i : i + QUERIES], codes, batch.column("list")[r].as_py()) <= bound * bound)
                    a, b = qid[i + a], iid[b]
                    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    asked = balls.select("uid", "radius", "v").mapInArrow(ask, "list int, uid long, radius double, v binary")
    queries = _packed(asked, "list", ["uid", "radius", "v"], QUERIES).withColumnRenamed("cells", "queries")
    items = _packed(balls.select("list", "uid", "radius", "error", "codes"), "list", ["uid", "radius", "error", "codes"], ITEMS).withColumnRenamed("cells", "items")
    return queries.join(items, "list").mapInArrow(look_up, "a long, b long").distinct()


def _compared(pairs: DataFrame, members: DataFrame, d: int, cosine: float) -> DataFrame:
    """(ball, uid, n, other) for pairs of balls whose members must be compared: linked rows of the other ball, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                sides = [batch.column(c)[r].values for c in ("la", "lb")]
                ids, weights = zip(*[(s.field("uid").to_numpy(), s.field("weight").to_numpy()) for s in sides], strict=True)
                va, vb = (matrix(s.field("v"), d) for s in sides)
                near = va @ vb.T >= cosine
                for uid, n, own, other in ((ids[0], near @ weights[1], "a", "b"), (ids[1], weights[0] @ near, "b", "a")):
                    some = np.flatnonzero(n)
                    ball = lambda c: pa.array(np.full(len(some), batch.column(c)[r].as_py(), dtype=np.int64))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([ball(own), pa.array(uid[some]), pa.array(n[some].astype(np.int64)), ball(other)], names=["ball", "uid", "n", "other"])

    blocks = stored(_packed(members.join(pairs.select(F.explode(F.array("a", "b")).alias("ball")).distinct(), "ball"), "ball", ["uid", "weight", "v"], 1024), "blocks")
    side = lambda s: blocks.select(F.col("ball").alias(s), F.col("cells").alias(f"l{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "ball long, uid long, n long, other long")


def indexed(points: DataFrame, n: int, d: int, sample: int = SAMPLE, most_lists: int = MOST_LISTS) -> tuple[Quantiser, DataFrame]:
    """The quantiser, and points (uid, v unit vectors, ...) with list, codes and error."""
    share = min(1.0, 1.1 * sample / max(1, n))
    chosen = points.where(F.pmod(F.xxhash64("uid"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("v").toArrow()
    quantiser = Quantiser(matrix(chosen.column("v").combine_chunks(), d) if n else np.zeros((0, d)), max(1, min(most_lists, n // LIST)))
    model = points.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, codes, error = model.value.encode(matrix(batch.column("v"), d))
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SUBSPACES), len(own), [None, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), flat.cast(pa.binary()), pa.array(error.astype(np.float64))], names=[*batch.schema.names, "list", "codes", "error"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return quantiser, points.mapInArrow(run, f"{schema}, list int, codes binary, error double")


def near_vectors(table: DataFrame, cosine: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, most_lists: int = MOST_LISTS) -> DataFrame:
    """(key, n_links, component_id, kept) of every row of ``table``."""
    spark = table.sparkSession
    rows = table.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("vec"))
    good = rows.where(finite(F.col("vec")) & F.exists(F.col("vec"), lambda c: c != 0))
    d = usual_size(good, "vec")
    same = good.where(F.size("vec") == d).groupBy("vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"))
    # Stored, as the numbers must stay the same.
    distinct = stored(same.withColumn("uid", F.monotonically_increasing_id()), "distinct")
    n = distinct.count()

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = unit(matrix(batch.column("vec"), d).astype(np.float64))
            offsets = pa.array(np.arange(0, u.size + 1, d, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("weight"), pa.ListArray.from_arrays(offsets, pa.array(u.ravel()))], names=["uid", "weight", "v"])

    points = distinct.select("vec", "weight", "uid").mapInArrow(units, "uid long, weight long, v array<double>")
    quantiser, items = indexed(points, n, d, sample, most_lists)
    items = stored(items, "items")
    angle = math.acos(cosine)
    members = stored(items.join(_balls(items, n, d, cosine).withColumnRenamed("leader", "ball"), "uid"), "members")
    centres = members.where("uid = ball").select("ball", F.col("v").alias("centre"))
    # Radii, rounded up, and how many rows a ball has; single vectors have radius 0.
    away = F.when(F.col("uid") == F.col("ball"), 0.0).otherwise(F.acos(F.least(F.lit(1.0), _cosine(F.col("v"), F.col("centre")))) + SURE)
    shape = members.join(centres, "ball").groupBy("ball").agg(F.max(away).alias("radius"), F.sum("weight").alias("rows"), F.count(F.lit(1)).alias("points"))
    balls = stored(shape.join(items.select(F.col("uid").alias("ball"), "list", "codes", "error", "v"), "ball").withColumnRenamed("ball", "uid"), "balls")

    side = lambda s: balls.select(F.col("uid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("radius", "rows", "points", "v")])
    found = _candidates(quantiser, balls, cosine).join(side("a"), "a").join(side("b"), "b").withColumn("cosine", F.least(F.lit(1.0), _cosine(F.col("v_a"), F.col("v_b"))))
    between, wide = F.acos("cosine"), F.col("radius_a") + F.col("radius_b")
    single = (F.col("points_a") == 1) & (F.col("points_b") == 1)
    all_ = F.when(single, F.col("cosine") >= cosine).otherwise(between + wide + SURE <= angle)
    near = stored(found.where(F.when(single, F.col("cosine") >= cosine).otherwise(between <= angle + wide + SURE)).select("a", "b", "rows_a", "rows_b", all_.alias("whole")), "near")
    compared = stored(_compared(near.where(~F.col("whole")).select("a", "b"), members.select("ball", "uid", "weight", "v"), d, cosine), "compared")

    whole = near.where("whole")
    by_ball = whole.select(F.col("a").alias("ball"), F.col("rows_b").alias("n")).unionByName(whole.select(F.col("b").alias("ball"), F.col("rows_a").alias("n"))).groupBy("ball").agg(F.sum("n").alias("more"))
    by_point = compared.groupBy("uid").agg(F.sum("n").alias("some"))
    edges = whole.select("a", "b").unionByName(compared.select(F.col("ball").alias("a"), F.col("other").alias("b")))
    component = connected_components(edges).select(F.col("node").alias("ball"), "component")
    linked = members.select("uid", "ball").join(balls.select(F.col("uid").alias("ball"), "rows"), "ball").join(by_ball, "ball", "left").join(component, "ball", "left").join(by_point, "uid", "left")
    of_point = linked.select("uid", (F.col("rows") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("some", F.lit(0))).alias("n_links"), F.coalesce("component", "ball").alias("component"))
    of_point = stored(of_point.join(distinct.select("uid", "vec", "least"), "uid"), "linked")
    smallest = of_point.groupBy("component").agg(F.min("least").alias("component_id"))
    known = of_point.join(smallest, "component").select("vec", "n_links", "component_id")
    out = rows.join(known, "vec", "left")
    lone = F.col("n_links").isNull()
    first = F.when(lone, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), first.alias("component_id"), F.col("id").eqNullSafe(first).alias("kept"))
