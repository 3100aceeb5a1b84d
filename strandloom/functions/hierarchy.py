"""Agglomerative clustering of a distance matrix that fits the driver (rows of a short dimension, such as samples)."""

from __future__ import annotations

import numpy as np

MOST = 5_000


def linkage(d: np.ndarray, method: str = "complete") -> list[tuple[int, int, float, int]]:
    """Merges (a, b, distance, size) in order; leaves are 0..n-1, the i-th merge makes cluster n + i.

    Nearest neighbours are kept per cluster, so a merge costs O(n).  Equal distances go to the
    lowest pair of places.
    """
    n = len(d)
    if n > MOST:
        raise ValueError(f"more than {MOST} items")
    if method not in ("single", "complete", "average"):
        raise ValueError(method)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    ids, size, alive = list(range(n)), [1] * n, np.ones(n, bool)
    out = []
    for step in range(n - 1):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = int(min(i, j)), int(max(i, j))
        h = float(d[i, j])
        out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), h, size[i] + size[j]))
        if method == "single":
            new = np.minimum(d[i], d[j])
        elif method == "complete":
            new = np.maximum(d[i], d[j])
        else:
            new = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        alive[j] = False
        dead = ~alive
        d[i, dead] = d[dead, i] = np.inf
        size[i] += size[j]
        ids[i] = n + step
    return out


def cut(merges: list[tuple[int, int, float, int]], n: int, k: int) -> np.ndarray:
    """Cluster numbers from 0, in order of first member, after all but the last ``k - 1`` merges."""
    parent = list(range(n + len(merges)))
    for i, (a, b, _, _) in enumerate(merges[: max(0, n - k)]):
        parent[a] = parent[b] = n + i

    def top(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    tops = [top(i) for i in range(n)]
    order = {t: i for i, t in enumerate(dict.fromkeys(tops))}
    return np.array([order[t] for t in tops])
