import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import kernels as K
from strandloom.operators import expression as E
from strandloom.operators import matrix as M
from strandloom.operators import stats as S
from strandloom.operators.ordered import Ordered


def pois(k, lam):
    return math.exp(-lam) * lam**k / math.factorial(k)


@pytest.mark.parametrize("k,lam", [(0, 0.5), (3, 2.0), (10, 4.0), (2, 9.0), (-1, 1.0)])
def test_poisson(k, lam):
    want = sum(pois(i, lam) for i in range(k + 1))
    assert K.poisson_cdf(k, lam) == pytest.approx(want, abs=1e-12)
    assert K.poisson_sf(k, lam) == pytest.approx(1 - want, abs=1e-12)


@pytest.mark.parametrize("k,n,p", [(3, 10, 0.3), (0, 5, 0.5), (9, 10, 0.9), (10, 10, 0.2)])
def test_binomial(k, n, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert K.binomial_cdf(k, n, p) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("k,a,b", [(0, 2.0, 3.0), (4, 5.0, 1.0), (-3, 1.5, 2.5), (7, 3.0, 3.0)])
def test_skellam(k, a, b):
    want = sum(pois(x, a) * pois(y, b) for x in range(80) for y in range(80) if x - y <= k)
    assert K.skellam_cdf(k, a, b) == pytest.approx(want, abs=1e-10)
    assert K.skellam_sf(k, a, b) == pytest.approx(1 - want, abs=1e-10)
    assert K.skellam_pmf(k, a, b) == pytest.approx(sum(pois(y + k, a) * pois(y, b) for y in range(max(0, -k), 60)), abs=1e-12)


def test_hypergeometric_exact_and_short():
    full = K.hypergeometric_tail(50, 10, 8, 3)
    want = sum(math.comb(10, i) * math.comb(40, 8 - i) for i in range(3, 9)) / math.comb(50, 8)
    assert full == pytest.approx(want, rel=1e-10)
    assert K.hypergeometric_tail(50, 10, 8, 3, drop_last=True) < full
    assert K.hypergeometric_tail(50, 10, 8, 0) == 1


def test_scan_statistic_edges():
    assert K.scan_pvalue(2, 0.1, 10, 1000) == 1
    assert 0 <= K.scan_pvalue(9, 0.01, 100, 1e6) <= 1
    k = K.critical_count(100, 1e6, 0.01, 0.05)
    assert K.scan_pvalue(k, 0.01, 100, 1e6) < 0.05 <= K.scan_pvalue(k - 1, 0.01, 100, 1e6)


def test_t_and_f_tails():
    assert K.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert K.f_sf(4.0, 2, 10) == pytest.approx(1.8**-5, rel=1e-9)  # closed form for two numerator degrees
    assert K.chi2_sf(5.0, 3) == pytest.approx(0.1717971, abs=1e-6)


def test_mann_whitney_golden(spark):
    df = spark.createDataFrame([("k", "a" if i <= 10 else "b", float(i)) for i in range(1, 21)], "k string, g string, v double")
    r = S.mann_whitney(df, ["k"], "g", "v", "a", "b").first()
    assert r["z"] == pytest.approx(-3.779644730092272, abs=1e-12)
    assert r["p"] == pytest.approx(1.5705228423079642e-4, rel=1e-4)


def test_quantile_normalisation_by_rank_means(spark):
    rnd = random.Random(4)
    x = [[rnd.random() for _ in range(3)] for _ in range(5)]
    df = spark.createDataFrame([(f"r{i}", f"c{j}", x[i][j]) for i in range(5) for j in range(3)], "row string, col string, value double")
    a = np.array(x)
    means = np.sort(a, 0).mean(1)
    want = means[a.argsort(0).argsort(0)]
    got = {(r["row"], r["col"]): r["value"] for r in M.quantile_normalise(df).collect()}
    assert all(got[f"r{i}", f"c{j}"] == pytest.approx(want[i, j]) for i in range(5) for j in range(3))


def test_ordered_running_and_neighbours(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["x", "x", "y", None]), i, rnd.randrange(-5, 6)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)
    got = {r["i"]: (r["s"], r["m"]) for r in Ordered(df, ["k"], ["i"]).running({"s": ("sum", F.col("v")), "m": ("min", F.col("v"))}).collect()}
    nxt = {r["i"]: r["v_next"] for r in Ordered(df, ["k"], ["i"]).neighbour(["v"]).collect()}
    prev = {r["i"]: r["v_next"] for r in Ordered(df, ["k"], ["i"]).neighbour(["v"], -1).collect()}
    for k in ("x", "y", None):
        own = [r for r in rows if r[0] == k]
        for n, (_, i, _) in enumerate(own):
            vals = [r[2] for r in own[: n + 1]]
            assert got[i] == (sum(vals), min(vals))
            assert nxt[i] == (own[n + 1][2] if n + 1 < len(own) else None)
            assert prev[i] == (own[n - 1][2] if n else None)


def test_max_subsum_cases(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, -2.0, 3.0, 4.0, -9.0, 7.0])] + [("n", i, v) for i, v in enumerate([-1.0, -2.0])], "k string, i int, v double")
    got = {r["k"]: (r["sum"], r["start"], r["end"]) for r in S.max_subsum(df, ["k"], "i", "v").collect()}
    assert got == {"a": (7.0, 2, 3), "n": (0.0, 0, -1)}


def test_hochberg_and_bh(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.8]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    adj = {r["i"]: r["p_adj"] for r in S.hochberg(df, "p", tie="i").collect()}
    s = sorted(p, reverse=True)
    want, low = {}, 1.0
    for k, x in enumerate(s, 1):
        low = min(low, k * x)
        want[p.index(x)] = min(1.0, low)
    assert adj == pytest.approx(want)
    assert S.bh_cutoff(df, "p", 0.05).first()["cutoff"] == pytest.approx(0.04)
    assert S.bh_cutoff(df, "p", 1e-9).first()["cutoff"] == 0


def test_histogram_clamp_and_drop(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (9.99,), (10.0,), (25.0,), (None,), (float("nan"),)], "v double")
    assert {r["bin"]: r["n"] for r in S.histogram(df, [], "v", 0.0, 10.0, 2).collect()} == {0: 2, 1: 3}
    assert {r["bin"]: r["n"] for r in S.histogram(df, [], "v", 0.0, 10.0, 2, clamp=False).collect()} == {0: 1, 1: 2}


def test_enrichment_matches_walk(spark):
    rnd = random.Random(6)
    genes = [(f"g{i}", rnd.uniform(-3, 3)) for i in range(60)]
    sets = [(f"s{k}", rnd.choice(genes)[0]) for k in range(4) for _ in range(rnd.randrange(2, 20))] + [("none", "zz")]
    got = {r["set"]: r["es"] for r in E.running_enrichment(spark.createDataFrame(genes, "gene string, score double"), spark.createDataFrame(sets, "set string, gene string")).collect()}
    ranked = sorted(genes, key=lambda g: (-g[1], g[0]))
    for k in {s for s, _ in sets} - {"none"}:
        own = {g for s, g in sets if s == k}
        tot = sum(abs(v) for g, v in ranked if g in own)
        run, hi, lo = 0.0, 0.0, 0.0
        for g, v in ranked:
            run += abs(v) / tot if g in own else -1 / (len(ranked) - len(own))
            hi, lo = max(hi, run), min(lo, run)
        assert got[k] == pytest.approx(hi if hi >= -lo else lo)
    assert "none" not in got


def test_kmeans_separates_and_empty(spark):
    rows = [(f"r{i}", [float(i % 2) * 10 + (i % 3) * 0.1, 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "row string, profile array<double>")
    got = {r["row"]: r["cluster"] for r in E.kmeans(df, 2, seed=3).collect()}
    assert len({got[f"r{i}"] for i in range(0, 30, 2)}) == 1 or len(set(got.values())) == 2
    assert E.kmeans(df.limit(0), 2).count() == 0


def test_kmeans_settles_after_many_rounds(spark):
    x = np.random.default_rng(0).random(10_000)
    df = spark.createDataFrame([(f"r{i}", [float(v)]) for i, v in enumerate(x)], "row string, profile array<double>")
    c = {r["row"]: r["cluster"] for r in E.kmeans(df, 20, seed=1).collect()}
    c = np.array([c[f"r{i}"] for i in range(len(x))])
    centres = np.array([[x[c == k].mean()] for k in range(20)])
    assert (E._distances(x[:, None], centres, "euclidean").argmin(1) == c).all()
    with pytest.raises(RuntimeError):
        E.kmeans(df, 20, seed=1, rounds=5)


def test_silhouette_matches_pairs(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(20, 3))
    lab = [i % 3 for i in range(20)]
    p = spark.createDataFrame([(f"r{i}", x[i].tolist()) for i in range(20)], "row string, profile array<double>")
    c = spark.createDataFrame([(f"r{i}", lab[i]) for i in range(20)], "row string, cluster int")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    s = []
    for i in range(20):
        m = [np.mean([d[i, j] for j in range(20) if lab[j] == k and j != i]) for k in range(3)]
        a, b = m[lab[i]], min(v for k, v in enumerate(m) if k != lab[i])
        s.append((b - a) / max(a, b))
    got = {r["cluster"]: r["silhouette"] for r in E.silhouette(p, c).collect()}
    for k in range(3):
        assert got[k] == pytest.approx(np.mean([s[i] for i in range(20) if lab[i] == k]))


def test_lowess_recovers_line():
    x = np.arange(30.0)
    assert np.allclose(K.lowess(x, 2 * x + 1, 0.4), 2 * x + 1)
