"""Pairwise sequence alignment: local and global with affine gaps, vectorised by anti-diagonal-free rows.

A row of the scoring table is filled with numpy: the vertical and diagonal parts are
elementwise, the horizontal gap part a running maximum, which affine gaps allow because
opening again inside a gap never pays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT = "score double, start_a int, end_a int, start_b int, end_b int, aligned_a string, aligned_b string, identity double"


def align(a: str, b: str, match: float = 2.0, mismatch: float = -1.0, gap_open: float = 3.0, gap_extend: float = 1.0, local: bool = True) -> tuple:
    """Best alignment of ``a`` and ``b`` as a tuple of the fields of ``RESULT``.

    A gap of n costs gap_open + (n - 1) * gap_extend (so equal values give linear gaps).
    Comparison ignores case.  Empty strings align with score 0 locally, and as one gap
    globally.
    """
    n, m = len(a), len(b)
    x = np.frombuffer(a.upper().encode("utf-32-le"), dtype=np.uint32)
    y = np.frombuffer(b.upper().encode("utf-32-le"), dtype=np.uint32)
    low = -1e18
    h = np.zeros((n + 1, m + 1))
    v = np.full((n + 1, m + 1), low)  # ends with a gap in b
    g = np.full((n + 1, m + 1), low)  # ends with a gap in a
    if not local:
        steps = -(gap_open + np.arange(max(n, m)) * gap_extend)
        h[0, 1:] = g[0, 1:] = steps[:m]
        h[1:, 0] = v[1:, 0] = steps[:n]
    j = np.arange(m + 1)
    for i in range(1, n + 1):
        v[i] = np.maximum(h[i - 1] - gap_open, v[i - 1] - gap_extend)
        if not local:
            v[i, 0] = h[i, 0]
        best = v[i].copy()
        best[1:] = np.maximum(best[1:], h[i - 1, :-1] + np.where(y == x[i - 1], match, mismatch))
        if local:
            best = np.maximum(best, 0)
            best[0] = 0
        # Horizontal gap ending at j from any k < j: best[k] - open - (j - k - 1) * extend.
        run = np.maximum.accumulate(best + j * gap_extend)
        g[i, 1:] = run[:-1] - gap_open - (j[1:] - 1) * gap_extend
        h[i] = np.maximum(best, g[i])
    if local:
        i, k = map(int, np.unravel_index(int(np.argmax(h)), h.shape))
    else:
        i, k = n, m
    score, end_a, end_b = float(h[i, k]), i, k
    oa: list[str] = []
    ob: list[str] = []
    state = "h"
    eps = 1e-9
    while (i > 0 or k > 0) and not (local and state == "h" and h[i, k] <= 0):
        if state == "h":
            s = match if i and k and x[i - 1] == y[k - 1] else mismatch
            if i and k and abs(h[i, k] - (h[i - 1, k - 1] + s)) < eps:
                oa.append(a[i - 1])
                ob.append(b[k - 1])
                i, k = i - 1, k - 1
            else:
                state = "v" if i and abs(h[i, k] - v[i, k]) < eps else "g"
        elif state == "v":
            back = abs(v[i, k] - (h[i - 1, k] - gap_open)) < eps
            oa.append(a[i - 1])
            ob.append("-")
            i -= 1
            state = "h" if back or i == 0 else "v"
        else:
            back = abs(g[i, k] - (h[i, k - 1] - gap_open)) < eps
            oa.append("-")
            ob.append(b[k - 1])
            k -= 1
            state = "h" if back or k == 0 else "g"
    ra, rb = "".join(reversed(oa)), "".join(reversed(ob))
    same = sum(p == q for p, q in zip(ra.upper(), rb.upper()))
    return score, i, end_a, k, end_b, ra, rb, same / len(ra) if ra else 0.0


def align_udf(local: bool = True, **costs: float):
    """Arrow UDF of two string columns giving the ``RESULT`` struct; null if either is null."""

    @F.pandas_udf(RESULT)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        names = [c.split()[0] for c in RESULT.split(", ")]
        rows = [align(p, q, local=local, **costs) if p is not None and q is not None else (None,) * len(names) for p, q in zip(a, b)]
        return pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("start_a", "end_a", "start_b", "end_b")})

    return run


def local_align(a: Column, b: Column, **costs: float) -> Column:
    return align_udf(True, **costs)(a, b)


def global_align(a: Column, b: Column, **costs: float) -> Column:
    return align_udf(False, **costs)(a, b)
