"""Density clusters of a small matrix, point by point: what the distributed operator is held against."""

from __future__ import annotations

import numpy as np


def density(x: np.ndarray, least: int = 3) -> np.ndarray:
    """Density clusters: single linkage over the Euclidean distances, condensed at ``least`` points, by excess of mass.

    Noise is -1.  With one neighbour as core the mutual reachability is the plain distance.
    """
    n = len(x)
    if n < 2 or n < least:
        return np.full(n, -1)
    near, parent, inside = np.full(n, np.inf), np.zeros(n, dtype=int), np.zeros(n, dtype=bool)
    edges, at = [], 0
    for _ in range(n - 1):
        inside[at] = True
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        closer = (d < near) & ~inside
        near[closer], parent[closer] = d[closer], at
        at = int(np.where(inside, np.inf, near).argmin())
        edges.append((near[at], parent[at], at))
    size, kids, height, nxt = [1] * n, {}, {}, n
    root = {i: i for i in range(n)}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for d, a, b in sorted(edges):
        a, b = find(a), find(b)
        kids[nxt], height[nxt] = (a, b), max(d, 1e-12)
        root[a] = root[b] = root[nxt] = nxt
        size.append(size[a] + size[b])
        nxt += 1

    def members(i: int) -> list[int]:
        out, todo = [], [i]
        while todo:
            j = todo.pop()
            out.append(j) if j < n else todo.extend(kids[j])
        return out

    # Condensed tree: a cluster lives from the split that makes it until it splits into two of at least ``least`` points.
    clusters, todo = [], [(nxt - 1, 0.0, None)]
    while todo:
        top, birth, above = todo.pop()
        me, node, mass = len(clusters), top, 0.0
        clusters.append({"top": top, "above": above, "below": []})
        if above is not None:
            clusters[above]["below"].append(me)
        while True:
            if node < n:
                break
            lam = 1 / height[node]
            big = [c for c in kids[node] if size[c] >= least]
            if len(big) == 1:
                mass += (size[node] - size[big[0]]) * (lam - birth)
                node = big[0]
                continue
            mass += size[node] * (lam - birth)
            todo += [(c, lam, me) for c in big]
            break
        clusters[me]["mass"] = mass
    chosen = set()
    for i in range(len(clusters) - 1, 0, -1):  # the root is never a cluster
        c = clusters[i]
        below = sum(clusters[j]["best"] for j in c["below"])
        if c["mass"] >= below:
            c["best"] = c["mass"]
            drop = list(c["below"])
            while drop:
                j = drop.pop()
                chosen.discard(j)
                drop += clusters[j]["below"]
            chosen.add(i)
        else:
            c["best"] = below
    labels = np.full(n, -1)
    for number, i in enumerate(sorted(chosen)):
        labels[members(clusters[i]["top"])] = number
    return labels
