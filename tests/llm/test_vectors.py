"""Operators on embeddings, against brute force."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from gleanspark.llm import centroids, near_vectors, queries, whitening

NAN, INF = float("nan"), float("inf")


def table(spark, rows, size="float"):
    clash = [(i, [float(c) if c is not None else None for c in v] if v is not None else None, 0, "?", "?") for i, v in rows]
    return spark.createDataFrame(clash, f"vec_id long, embedding array<{size}>, label int, uid string, id string").repartition(3)


def bad(d):
    return [(900, None), (901, [None] + [1.0] * (d - 1)), (902, [NAN] + [1.0] * (d - 1)), (903, [INF] + [1.0] * (d - 1)), (904, [])]


def components(near):
    root = list(range(len(near)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(near), strict=True):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(len(near))]


def test_eigenvectors_of_close_and_equal_eigenvalues():
    rng = np.random.default_rng(1)
    for values in ([5, 3, 1], [4, 4, 4, 1], [1e6, 1 + 1e-9, 1, 1 - 1e-9, 1e-3], [2, 2 - 1e-13, 2 - 2e-13, 1, 0, 0], list(np.linspace(1, 1 + 1e-5, 20))):
        values = np.sort(np.array(values, dtype=float))[::-1]
        q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
        a = (q * values) @ q.T
        found, x = whitening.eigenvectors((a + a.T) / 2)
        assert np.allclose(found, values, rtol=1e-12, atol=1e-14 * values[0])
        assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-15 * 4
        assert np.abs(a @ x - x * found).max() < 4e-15 * values[0]


def test_whitening(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 40)) * np.linspace(0.1, 2, 40) @ np.linalg.qr(rng.normal(size=(40, 40)))[0]
    x[300:] = x[299]  # one vector in many rows
    rows = list(enumerate(x.tolist())) + bad(40) + [(905, [1.0] * 3), (None, x[0].tolist()), (5, x[1].tolist())]
    out = whitening.whitening(table(spark, rows, "double"))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.toPandas()
    grid = np.floor(64 * np.vstack([x, x[:2]])) + 1_000_000
    n = len(grid)
    assert len(got) == n * 32 and set(got.n) == {n} and got.vec_id.isna().sum() == 32
    y = grid - grid.mean(0)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    one = got[(got.vec_id < 400) & (got.vec_id != 5)].sort_values(["vec_id", "component"])
    w = one.whitened.to_numpy().reshape(-1, 32)
    expected = np.delete((y @ vectors[:, :32] / np.sqrt(values[:32]))[:400], 5, axis=0)
    assert np.abs(w - expected * np.sign((w * expected).sum(0))).max() < 1e-9
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, grid.sum(0), strict=True)) for row in grid[:400]]
    assert one.deviation.to_numpy().reshape(-1, 32)[:, 0].tolist() == [e for i, e in enumerate(exact) if i != 5]
    assert np.allclose(one.explained.to_numpy()[:32], values[:32] / values.sum(), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9


def test_whitening_without_variance(spark):
    assert whitening.whitening(table(spark, bad(4))).count() == 0
    assert whitening.whitening(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = whitening.whitening(table(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1e30, 2.0])], "double")).collect()
    assert [r.component for r in flat] == [1, 1, 1] and all(r.deviation is None or r.deviation > 0 for r in flat)


def k_means(kept, k=8, rounds=10):
    x = np.array([[math.floor(1024 * np.float64(c)) for c in v] for _, v in kept])
    order = sorted(range(len(kept)), key=lambda i: (hashlib.sha256(f"3:{kept[i][0]}".encode()).hexdigest(), x[i].tolist()))
    c = x[order[:k]]
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        own = d.argmin(1)
        if r < rounds:
            c = np.array([[s // (own == j).sum() for s in x[own == j].sum(0).tolist()] if (own == j).any() else c[j].tolist() for j in range(len(c))])
    best = d.min(1)
    digest = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c]
    return sorted((i, int(own[j]), int(best[j]), int(best[own == own[j]].sum()), int(best.sum()), digest[own[j]]) for j, (i, _) in enumerate(kept))


@pytest.mark.parametrize("n", [0, 5, 700])
def test_centroids(spark, n, monkeypatch):
    monkeypatch.setattr(centroids, "CHUNK", 256)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 64)).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[:1]  # a third are copies
    kept = list(enumerate(x.tolist())) + ([(3, x[1].tolist())] if n else [])
    got = centroids.centroid_clusters(table(spark, kept + bad(64) + [(906, [1.0] * 63)]))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == (k_means(kept) if n else [])


def test_blocks_lose_nothing():
    rng = np.random.default_rng(4)
    for high in (2, 40, 10**6):
        x = rng.integers(-high, high, size=(300, 19))
        blocks = centroids.encoded(x)
        assert (np.concatenate([words[codes] for _, words, codes in blocks], axis=1) == x).all()
        assert all(words.shape[1] == 1 or 4 * len(words) <= len(x) for _, words, _ in blocks)


def planted(rng, n, d, wide):
    """Random vectors, pairs around the threshold, chains, tight groups and groups wider than a ball, and copies."""
    x = [rng.normal(size=d) for _ in range(n)]
    for i in range(0, n, 3):
        u = x[i] / np.linalg.norm(x[i])
        for _ in range(2):
            w = rng.normal(size=d)
            w -= (w @ u) * u
            cosine = rng.uniform(0.93, 0.97)
            x.append(3 * (cosine * u + math.sqrt(1 - cosine**2) * w / np.linalg.norm(w)))
    for spread, m in ((0.05, 150), (wide, 120)):
        base = rng.normal(size=d)
        x += [base + spread * rng.normal(size=d) for _ in range(m)]
    return np.array([*x, *[x[0]] * 60, *[x[-1]] * 3]).astype(np.float32)


@pytest.mark.parametrize("d,n,lists,pick", [(64, 600, 16, 64), (10, 300, 8, 2048), (64, 200, 1, 16)])
def test_near_vectors(spark, monkeypatch, d, n, lists, pick):
    monkeypatch.setattr(near_vectors, "LIST", 40)
    monkeypatch.setattr(near_vectors, "PICK", pick)
    x = planted(np.random.default_rng(5), n, d, 0.2)
    x = x[np.random.default_rng(6).permutation(len(x))]
    rows = list(enumerate(x.tolist())) + [(2000, [0.0] * d), (2001, [1.0] * (d + 1))] + [(i + 2000, v) for i, v in bad(d)]
    got = near_vectors.near_vectors(table(spark, rows), most_lists=lists)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    found = {r.vec_id: r for r in got.collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    links = np.array([found[i].n_links for i in range(len(x))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.99 * near.sum()
    if (links == near.sum(1)).all():
        assert [found[i].component_id for i in range(len(x))] == components(near)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())
    assert all(found[i].n_links == 0 and found[i].kept for i in (2000, 2001, 2900, 2901, 2902, 2903, 2904))


def test_near_vectors_rows_that_repeat(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.99, 0.01, 0.0, 0.0]
    rows = [(7, a), (7, a), (7, b), (None, b), (3, [0.0, 1.0, 0.0, 0.0]), (None, [0.0, 0.0, 1.0, 0.0]), (9, [0.0, 0.0, 0.0, 1e-40])]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in near_vectors.near_vectors(table(spark, rows)).collect())
    assert got == sorted([("7", 3, "7", True)] * 3 + [("None", 3, "7", False), ("3", 0, "3", True), ("None", 0, "None", True), ("9", 0, "9", True)])
    assert near_vectors.near_vectors(table(spark, [])).count() == 0
    assert near_vectors.near_vectors(table(spark, bad(4))).count() == 5


@pytest.mark.parametrize("name", ["op12_centroid_clustering", "op13_embedding_near_dedup"])
def test_same_as_sql(spark, tables, same, name):
    same(queries.QUERIES[name](spark, tables), queries.ORACLE_SQL[name])
