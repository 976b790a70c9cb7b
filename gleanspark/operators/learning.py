"""Clusterings and the choice of k.

Rows are clustered by MLlib at any size.  The choice of k runs on samples of at most ``SAMPLE`` vectors a group, and its
runs are independent: they fan out as tasks over (group, k, run), each with NumPy on its sample.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.functions.arrays import distances
from gleanspark.operators import clusters
from gleanspark.sources.storage import stored

#: Fixed values of the choice of k: rows of a sample, rows of a group and separation at least; seed and share of the sample
#: of each run; seeds of the groups' samples (the first is for all groups that aren't named).
SAMPLE, LEAST_GROUP, LEAST_SEPARATION = 600, 20, 0.05
RUNS = [(11, 1.0), (23, 1.0), (101, 0.85), (202, 0.85)]
GROUP_SEEDS = {None: 17, "negative": 29}
#: Why a number of clusters is recommended.
BY_SCORES, BY_SIZE = "Best balance of separation and stability across tested k values", "Insufficient stable signal; using conservative heuristic"
#: Blocks of the silhouette: how many, of how many rows at most (then there are more) and at least (then fewer), and in how
#: many parts each block meets the others.
BLOCKS, BLOCK, LEAST_BLOCK, RIGHT_PARTS = 24, 20_000, 128, 4


def embed(texts: DataFrame, column: str = "review_text", features: int = 256) -> DataFrame:
    """``texts`` with ``embedding``: hashed words, weighted by rarity, of length 1; no model file is needed."""
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\s+")
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features)
    df = tf.transform(words.transform(texts.withColumn("_text", F.coalesce(column, F.lit("")))))
    weighted = IDF(inputCol="_tf", outputCol="_idf").fit(df).transform(df)
    unit = Normalizer(inputCol="_idf", outputCol="_unit", p=2.0).transform(weighted)
    return unit.withColumn("embedding", vector_to_array("_unit").cast("array<float>")).drop("_text", "_words", "_tf", "_idf", "_unit")


def kmeans_labels(rows: DataFrame, k: int, vector: str = "embedding", seed: int = 42, restarts: int = 10) -> DataFrame:
    """``rows`` with ``topic_id`` from MLlib's k-means; the restart of least cost wins; fewer than two rows are one cluster.

    The vectors are stored once, and all restarts read them from there.
    """
    n = rows.limit(2).count()
    if n < 2:
        return rows.withColumn("topic_id", F.lit(0))
    vectors = stored(rows.select(array_to_vector(vector).alias("_v")), "vectors")
    models = [KMeans(k=max(2, k), seed=seed + i, featuresCol="_v", predictionCol="topic_id").fit(vectors) for i in range(restarts)]
    return min(models, key=lambda m: m.summary.trainingCost).transform(rows.withColumn("_v", array_to_vector(vector))).drop("_v")


def lloyd(x: np.ndarray, k: int, seed: int, restarts: int = 10, rounds: int = 100) -> np.ndarray:
    """k-means with k-means++ starts on a sample; the labels of least inertia."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    if len(x) < 2:
        return np.zeros(len(x), dtype=int)
    best, least = None, math.inf
    for _ in range(restarts):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        labels = None
        for _ in range(rounds):
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            new = d.argmin(1)
            if labels is not None and (new == labels).all():
                break
            labels = new
            c = np.vstack([x[labels == j].mean(0) if (labels == j).any() else c[j] for j in range(k)])
        inertia = d.min(1).sum()
        if inertia < least:
            best, least = labels, inertia
    return best


def pairwise_silhouette(x: np.ndarray, labels: np.ndarray) -> float | None:
    ids = np.unique(labels)
    if len(ids) < 2 or len(ids) >= len(x):
        return None
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0))
    mean = np.stack([d[:, labels == c].sum(1) for c in ids], 1)
    sizes = np.array([(labels == c).sum() for c in ids])
    own = np.searchsorted(ids, labels)
    rows = np.arange(len(x))
    single = sizes[own] == 1
    a = mean[rows, own] / np.maximum(sizes[own] - 1, 1)
    other = mean / sizes
    other[rows, own] = np.inf
    b = other.min(1)
    top = np.maximum(a, b)
    return float(np.where(single | (top == 0), 0.0, (b - a) / np.where(top == 0, 1, top)).mean())


def sampled(rows: DataFrame, key: str, group: str, n: int = SAMPLE, seeds: dict | None = None) -> DataFrame:
    """The ``n`` rows of each group with the smallest seeded hash: a fixed, bounded sample."""
    seeds = seeds or GROUP_SEEDS
    seed = F.lit(seeds[None])
    for name, own in seeds.items():
        seed = seed if name is None else F.when(F.col(group) == name, own).otherwise(seed)
    w = Window.partitionBy(group).orderBy(F.md5(F.concat(seed.cast("string"), F.lit(":"), F.col(key).cast("string"))), key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def _flat(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _label_sums(batches):
    """From pairs of blocks: for each point of the left one and each label, the sum of distances to the right ones."""
    found: dict[int, tuple] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            at = batch.column("b")[row].as_py()
            x, y = (_flat(batch, f"{side}x", row).astype(float).reshape(batch.column(f"{side}n")[row].as_py(), -1) for side in "lr")
            _, sums = found.setdefault(at, (tuple(_flat(batch, f"l{c}", row) for c in "ikw"), {}))
            labels, column = np.unique(_flat(batch, "rk", row), return_inverse=True)
            weight = np.zeros((len(y), len(labels)))
            weight[_flat(batch, "ri", row), column] = _flat(batch, "rw", row)
            step = max(1, 250_000 // len(y))
            part = np.vstack([distances(x[i : i + step], y) @ weight for i in range(0, len(x), step)])
            for j, m in enumerate(labels.tolist()):
                sums[m] = sums[m] + part[:, j] if m in sums else part[:, j]
    for at, ((i, k, w), sums) in found.items():
        for m, s in sums.items():
            yield pa.RecordBatch.from_pydict({"b": pa.array(np.full(len(i), at, "int32")), "i": i, "k": k, "w": w, "m": pa.array(np.full(len(i), m, "int32")), "s": s[i]})


def silhouette(rows: DataFrame, label: str = "topic_id", vector: str = "embedding") -> DataFrame:
    """One row, value: the exact Euclidean silhouette of all rows with a vector.

    It is null with under 2 labels or as many labels as points.  Equal vectors are one point with a count for each label;
    points are packed into blocks, and every block meets every other in a task that sums distances by label.
    """
    known = rows.where(F.col(vector).isNotNull()).select(F.col(label).cast("int").alias("k"), F.col(vector).alias("v"))
    n = known.count()
    blocks = max(1, min(max(BLOCKS, -(-n // BLOCK)), n // LEAST_BLOCK))
    cells = known.groupBy("v", "k").agg(F.count(F.lit(1)).alias("w"))
    points = cells.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("k", "w"))).alias("ls"))
    packed = points.groupBy(F.pmod(F.hash("v"), F.lit(blocks)).alias("b")).agg(F.sort_array(F.collect_list(F.struct("v", "ls"))).alias("ps"))  # in order: blocks are made more than once

    def side(s: str, parts: int) -> DataFrame:
        of = lambda c: F.flatten(F.transform("ps", lambda p: F.transform(p["ls"], lambda q: q[c])))
        index = F.flatten(F.transform("ps", lambda p, i: F.transform(p["ls"], lambda q: i)))
        out = packed.select("b", F.size("ps").alias(f"{s}n"), F.flatten(F.transform("ps", lambda p: p["v"])).alias(f"{s}x"), index.alias(f"{s}i"), of("k").alias(f"{s}k"), of("w").alias(f"{s}w"))
        return out.repartitionByRange(min(parts, blocks), "b")

    pairs = side("l", blocks).join(side("r", RIGHT_PARTS).drop("b").hint("shuffle_replicate_nl"))
    sums = pairs.mapInArrow(_label_sums, "b int, i int, k int, w long, m int, s double").groupBy("b", "i", "k", "w", "m").agg(F.sum("s").alias("s"))
    sizes = cells.groupBy(F.col("k").alias("m")).agg(F.sum("w").alias("n"))
    same = F.col("k") == F.col("m")
    point = sums.join(sizes, "m").groupBy("b", "i", "k", "w").agg(
        F.max(F.when(same, F.col("s") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("own"), F.max(F.when(same, F.col("n"))).alias("size"), F.min(F.when(~same, F.col("s") / F.col("n"))).alias("other")
    )
    top = F.greatest("own", "other")
    value = F.when((F.col("size") == 1) | (top == 0), F.lit(0.0)).otherwise((F.col("other") - F.col("own")) / top)
    all_ = point.groupBy("k").agg(F.sum(value * F.col("w")).alias("s"), F.sum("w").alias("n")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"))
    return all_.select(F.when((F.col("labels") >= 2) & (F.col("labels") < F.col("n")), F.col("s") / F.col("n")).alias("value"))


def _tried(jobs: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, k, run, separation, fragmentation, points, labels) of every (group, k, run) in ``jobs``."""
    kind = dict(jobs.dtypes)[group]

    def one(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                x = np.array([v[vector] for v in r.rows], dtype=float)
                seed, share = RUNS[r.run]
                take = np.arange(len(x)) if share >= 1 else np.sort(np.random.default_rng(seed).choice(len(x), max(2, round(share * len(x))), replace=False))
                labels = lloyd(x[take], r.k, seed)
                sizes = np.bincount(labels)
                small = sizes[(sizes > 0) & (sizes < max(8, math.ceil(0.05 * len(take))))].sum() / len(take)
                out.append((getattr(r, group), r.k, r.run, pairwise_silhouette(x[take], labels), float(small), take.tolist(), labels.tolist()))
            yield pd.DataFrame(out, columns=[group, "k", "run", "separation", "fragmentation", "points", "labels"])

    spread = jobs.repartition(64, group, "k", "run")
    return spread.mapInPandas(one, f"{group} {kind}, k int, run int, separation double, fragmentation double, points array<int>, labels array<int>")


def recommend_k(rows: DataFrame, key: str = "recommendation_id", group: str = "sentiment", vector: str = "embedding") -> DataFrame:
    """(group, k, confidence, used_fallback, sample_count, score, margin, reason, tested): the recommended number of clusters.

    For every candidate k two runs over the sample and two over 85 % of it are scored by silhouette, agreement and
    fragmentation; the scores are the operators' of ``clusters``.
    """
    totals = rows.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    sample = sampled(rows.select(group, key, vector), key, group)
    packed = sample.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(key, vector))).alias("rows"))  # at most SAMPLE rows
    jobs = packed.join(totals, group).select(group, "rows", F.explode(clusters.candidate_ks(F.col("total"))).alias("k")).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(RUNS) - 1))).alias("run"))
    # A few dozen runs a group.
    runs = stored(_tried(jobs, group, vector).where(F.col("separation").isNotNull()), "runs")
    cells = runs.select(group, "k", "run", F.explode(F.arrays_zip("points", "labels")).alias("c")).select(group, "k", "run", F.col("c.points").alias("point"), F.col("c.labels").alias("label"))
    agreement = clusters.stability(cells, by=[group, "k"]).withColumnRenamed("value", "stability")
    metrics = runs.join(agreement, [group, "k"], "left").select(group, "k", "separation", F.coalesce("stability", F.lit(0.0)).alias("stability"), "fragmentation")
    scores = clusters.score_k(metrics, [group])
    best = scores.groupBy(group).agg(F.sort_array(F.collect_set("k")).alias("tested"), F.max("separation").alias("separation"), F.max_by(F.struct("k", "normalised", "margin", "confidence"), F.col("is_winner").cast("int")).alias("w"))
    found = totals.join(best, group, "left")
    sound = F.coalesce(F.col("separation") >= LEAST_SEPARATION, F.lit(False))
    return found.select(
        group,
        F.when(sound, F.col("w.k")).otherwise(clusters.fallback_k(F.col("total"))).alias("k"),
        F.when(sound, F.col("w.confidence")).otherwise("low").alias("confidence"),
        (~sound).alias("used_fallback"),
        F.when(F.col("total") >= LEAST_GROUP, F.least("total", F.lit(SAMPLE))).otherwise(0).cast("long").alias("sample_count"),
        F.when(sound, F.round("w.normalised", 4)).otherwise(0.0).alias("score"),
        F.when(sound, F.round("w.margin", 4)).otherwise(0.0).alias("margin"),
        F.when(sound, BY_SCORES).otherwise(BY_SIZE).alias("reason"),
        F.coalesce("tested", F.array().cast("array<int>")).alias("tested"),
    )
