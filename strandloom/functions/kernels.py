"""Distribution functions and numeric kernels, in plain Python and numpy, and Arrow UDFs over them."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 0.0
    if math.isinf(x):
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * front)
    b = x + 1 - a
    c = 1 / TINY
    d = 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = TINY if abs(d) < TINY else d
        c = b + an / c
        c = TINY if abs(c) < TINY else c
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return max(0.0, 1 - front * h)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(100_000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + num * d
        d = TINY if abs(d) < TINY else d
        d = 1 / d
        c = 1 + num / c
        c = TINY if abs(c) < TINY else c
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def poisson_pmf(k: float, lam: float) -> float:
    if k < 0 or lam < 0:
        return 0.0
    if lam == 0:
        return 1.0 if k == 0 else 0.0
    return math.exp(k * math.log(lam) - lam - math.lgamma(k + 1))


def poisson_cdf(k: float, lam: float) -> float:
    """P(X <= k)."""
    k = math.floor(k)
    if k < 0:
        return 0.0
    return 1.0 if lam <= 0 else 1 - gamma_p(k + 1, lam)


def poisson_sf(k: float, lam: float) -> float:
    """P(X > k), accurate in the tail."""
    k = math.floor(k)
    if k < 0:
        return 1.0
    return 0.0 if lam <= 0 else gamma_p(k + 1, lam)


def binomial_cdf(k: float, n: float, p: float) -> float:
    k, n = math.floor(k), round(n)
    if k < 0:
        return 0.0
    return 1.0 if k >= n else 1 - beta_i(k + 1, n - k, p)


def binomial_sf(k: float, n: float, p: float) -> float:
    """P(X > k)."""
    k, n = math.floor(k), round(n)
    if k < 0:
        return 1.0
    return 0.0 if k >= n else beta_i(k + 1, n - k, p)


def log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric_tail(total: int, marked: int, drawn: int, hits: int, drop_last: bool = False) -> float:
    """P(at least ``hits`` marked among ``drawn``); ``drop_last`` leaves out the largest term, 1 without hits."""
    if hits <= 0:
        return 1.0
    top = min(marked, drawn)
    s = 0.0
    for i in range(hits, top + (0 if drop_last else 1)):
        if drawn - i <= total - marked:
            s += math.exp(log_choose(marked, i) + log_choose(total - marked, drawn - i) - log_choose(total, drawn))
    return min(1.0, s)


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_p(df / 2, x / 2)


def t_two_sided(t: float, df: float) -> float:
    return beta_i(df / 2, 0.5, df / (df + t * t))


def f_sf(x: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def ncx2_cdf(x: float, nu: float, lam: float) -> float:
    """Non-central chi-square distribution function as a Poisson mixture summed from its mode outwards."""
    if x <= 0:
        return 0.0
    half = lam / 2
    mode = int(half)
    total = 0.0
    for step, j in ((1, mode), (-1, mode - 1)):
        while j >= 0:
            w = poisson_pmf(j, half)
            add = w * gamma_p(nu / 2 + j, x / 2)
            total += add
            if w < 1e-17 or (add < 1e-17 * max(total, TINY) and step == 1):
                break
            j += step
    return min(1.0, total)


def skellam_cdf(k: float, l1: float, l2: float) -> float:
    """P(X - Y <= k) for Poisson X (mean l1) and Y (mean l2)."""
    k = math.floor(k)
    if l2 <= 0:
        return poisson_cdf(k, l1)
    if l1 <= 0:
        return 1 - poisson_cdf(-k - 1, l2)
    return ncx2_cdf(2 * l2, -2 * k, 2 * l1) if k < 0 else 1 - ncx2_cdf(2 * l1, 2 * (k + 1), 2 * l2)


def skellam_sf(k: float, l1: float, l2: float) -> float:
    """P(X - Y > k), accurate in the right tail."""
    k = math.floor(k)
    if l2 <= 0:
        return poisson_sf(k, l1)
    if l1 <= 0:
        return poisson_cdf(-k - 1, l2)
    return ncx2_cdf(2 * l1, 2 * (k + 1), 2 * l2) if k >= 0 else 1 - skellam_cdf(k, l1, l2)


def skellam_pmf(k: int, l1: float, l2: float) -> float:
    lo = max(0, -k)
    mode = max(lo, int(math.sqrt(l1 * l2 + k * k / 4) - k / 2))
    total = 0.0
    for step, j in ((1, mode), (-1, mode - 1)):
        while j >= lo:
            w = poisson_pmf(j + k, l1) * poisson_pmf(j, l2)
            total += w
            if w < 1e-18 * max(total, TINY):
                break
            j += step
    return total


def scan_pvalue(k: float, lam: float, w: float, t: float) -> float:
    """P of a window of width ``w`` with at least ``k`` counts somewhere in length ``t`` at rate ``lam``; 1 for k <= 2."""
    k = int(k + 1e-9)  # summed weights of whole counts may fall short by rounding
    if k <= 2:
        return 1.0
    m = lam * w
    if m <= 0:
        return 0.0
    a = (k - m) / k
    p = 1 - poisson_cdf(k - 1, m) * math.exp(-a * lam * (t - w) * poisson_pmf(k - 1, m))
    return min(1.0, max(0.0, p))


def critical_count(w: float, t: float, lam: float, alpha: float) -> int:
    """Least count whose scan p value is below ``alpha``."""
    hi = 3
    while scan_pvalue(hi, lam, w, t) >= alpha:
        hi *= 2
    lo = max(3, hi // 2)
    while lo < hi:
        mid = (lo + hi) // 2
        if scan_pvalue(mid, lam, w, t) < alpha:
            hi = mid
        else:
            lo = mid + 1
    return lo


def poisson_enrichment(a: float, b: float, lam_sample: float, lam_ctrl: float, w: float) -> float:
    """P(X > a) with the sample's rate raised by the control's local excess, never lowered."""
    expected = lam_ctrl * w
    ratio = b / expected if expected > 0 else 1.0
    return poisson_sf(a, max(1.0, ratio) * lam_sample * w)


def binomial_enrichment(a: float, b: float, sample_total: float, ctrl_total: float) -> float:
    """P(X > a) among a + b counts; 1 for few counts."""
    if a + b <= 2 or sample_total + ctrl_total < 2 or sample_total == 0:
        return 1.0
    return binomial_sf(a, a + b, sample_total / (sample_total + ctrl_total))


def skellam_score(count: float, control: float, lam: float, lam_ctrl: float) -> float:
    """P(difference >= observed); 1 where the rate is not positive or the count below it."""
    if lam <= 0 or count < lam:
        return 1.0
    return skellam_sf(count - control - 1, lam, lam_ctrl)


XX1, XX2, XX3, XX4, XX5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * XX2
    h = (h ^ (h >> np.uint64(29))) * XX3
    return h ^ (h >> np.uint64(32))


def xxhash64_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of bigints ``x``, carried on from the hashes ``seed``; all as unsigned 64-bit arrays."""
    return _mixed(_turned((seed + (XX5 + np.uint64(8))) ^ (_turned(x * XX2, 31) * XX1), 27) * XX1 + XX4)


def xxhash64_int(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """As ``xxhash64_long`` for ints, given as unsigned 64-bit numbers below 2^32."""
    return _mixed(_turned((seed + (XX5 + np.uint64(4))) ^ (x * XX1), 23) * XX2 + XX3)


def fullest_places(drawn: np.ndarray, width: int, rounds: int) -> np.ndarray:
    """Of every round, how many items its fullest place has: item with hash h goes to place xxhash64(round, h) modulo ``width``.

    ``drawn`` are the items' hashes, at least one, as unsigned 64-bit numbers; rounds count from 1.
    """
    with np.errstate(over="ignore"):
        out, m = np.ones(rounds, np.int64), len(drawn)
        some = max(1, (1 << 17) // m)
        for lo in range(0, rounds, some):
            n = np.arange(lo + 1, min(lo + some, rounds) + 1, dtype=np.uint64)
            h = xxhash64_int(n[:, None], drawn[None, :]).view(np.int64)
            at = h - (h // width) * width
            if m > width:
                out[lo : lo + len(n)] = [np.bincount(x).max() for x in at]
                continue
            at = np.sort(at.astype(np.int32) if width < 1 << 31 else at, axis=1)
            # A place has more than k items where sorted places k apart are equal.
            rows, k = np.arange(len(n)), 1
            while len(rows) and k < m:
                more = (at[rows, k:] == at[rows, :-k]).any(axis=1) if len(rows) < len(n) else (at[:, k:] == at[:, :-k]).any(axis=1)
                rows = rows[more]
                k += 1
                out[lo + rows] = k
    return out


def arrow_udf(fn: Callable[..., float], kind: str = "double") -> Callable[..., Column]:
    """A function of columns that applies a scalar kernel in Arrow batches; each distinct argument tuple of a batch is computed once. Null in, null out."""

    def call(*cols: Column | str) -> Column:
        @F.pandas_udf(kind)
        def run(*args: pd.Series) -> pd.Series:
            memo: dict[tuple, float | None] = {}
            out = []
            for t in zip(*[c.tolist() for c in args]):
                if t not in memo:
                    memo[t] = fn(*t) if all(x is not None and x == x for x in t) else None
                out.append(memo[t])
            return pd.Series(out, dtype="float64" if kind == "double" else "Int64")

        return run(*cols)

    return call


# --- arrays in numpy ---------------------------------------------------------------------


def lowess(x: np.ndarray, y: np.ndarray, span: float = 0.3) -> np.ndarray:
    """Local linear regression with tricube weights over the nearest ``span`` share of points."""
    n = len(x)
    k = min(n, max(2, int(math.ceil(span * n))))
    order = np.argsort(x, kind="stable")
    xs, ys = x[order].astype(float), y[order].astype(float)
    fit = np.empty(n)
    lo = 0
    for i in range(n):
        while lo + k < n and xs[i] - xs[lo] > xs[lo + k] - xs[i]:
            lo += 1
        u, v = xs[lo : lo + k], ys[lo : lo + k]
        h = max(xs[i] - u[0], u[-1] - xs[i], 1e-12)
        w = (1 - np.minimum(np.abs(u - xs[i]) / h, 1) ** 3) ** 3
        w = w if w.sum() > 0 else np.ones_like(w)
        mx, my = np.average(u, weights=w), np.average(v, weights=w)
        sxx = np.sum(w * (u - mx) ** 2)
        fit[i] = my + (np.sum(w * (u - mx) * (v - my)) / sxx * (xs[i] - mx) if sxx > 1e-12 else 0.0)
    out = np.empty(n)
    out[order] = fit
    return out
