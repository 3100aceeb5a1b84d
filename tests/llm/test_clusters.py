from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import clusters as K
from strandloom.operators.graph import components


def brute(x, names, r=0.9):
    n = len(x)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            m = ~np.isnan(x[i]) & ~np.isnan(x[j])
            a, b = x[i][m], x[j][m]
            if len(a) > 1 and np.ptp(a) > 1e-9 and np.ptp(b) > 1e-9 and np.corrcoef(a, b)[0, 1] >= r:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(names[i])
    return {(a, b) for g in groups.values() for a in g for b in g if a < b}


def table(spark, v, names):
    rows = [(names[i], f"c{j:02d}", float(v[i, j]), "x") for i in range(v.shape[0]) for j in range(v.shape[1]) if not np.isnan(v[i, j])]
    rows += rows[:7] + [(names[0], None, 1.0, "x"), (None, "c00", 1.0, "x"), (names[1], "c00", float("nan"), "x"), (names[2], "c00", None, "x")]
    return spark.createDataFrame(rows, "row string, col string, value double, vec string").repartition(5)


def made(seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, 30))
    x = [base[0] + rng.normal(size=30) * 0.15 for _ in range(60)]  # one cluster with a third of all rows
    x += [base[k] * (1 + 0.3 * i) + 5 * i + rng.normal(size=30) * 0.15 for k in range(1, 5) for i in range(5)]
    step = base[5].copy()
    for _ in range(12):  # a chain whose ends aren't alike
        step = step + rng.normal(size=30) * 0.3
        x.append(step.copy())
    x += [rng.normal(size=30) for _ in range(80)]
    x += [np.full(30, 2.0)] * 3 + [x[70].copy(), x[70].copy()]
    v = np.exp2(np.array(x) + 8) - 1
    v[rng.random(v.shape) < 0.04] = np.nan
    v[-5:-2] = 3.0
    v[-1] = v[70] = v[-2]
    return v, [f"r{i:03d}" for i in range(len(v))]


@pytest.mark.parametrize("bucket_rows,hot_rows", [(2048, 1 << 17), (16, 1 << 17), (16, 20)])
def test_clusters_match_brute_force(spark, bucket_rows, hot_rows):
    v, names = made()
    m = K.cluster_rows(table(spark, v, names), "row", "col", "value", bucket_rows=bucket_rows, hot_rows=hot_rows)
    got = {tuple(r) for r in K.cluster_pairs(m, chunk=7).collect()}
    assert got == brute(np.log2(1 + v), names)


def linked(spark, x):
    """Share of the pairs (0, 1), (2, 3), ... of rows that the links of ``similar_links`` join."""
    rows = [(i, [None if np.isnan(c) else float(c) for c in r]) for i, r in enumerate(x)]
    links = K.similar_links(spark.createDataFrame(rows, "id long, vec array<double>").repartition(4))
    pivot = {r["id"]: r["pivot"] for r in components(links).collect()}
    return np.mean([pivot.get(i, i) == pivot.get(i + 1, i + 1) for i in range(0, len(x), 2)])


def limit_pairs(n, d, r, seed=3):
    """2 n rows, pairs that correlate at exactly ``r``."""
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, d))
    a -= a.mean(1, keepdims=True)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    e = rng.normal(size=(n, d))
    e -= e.mean(1, keepdims=True)
    e -= (e * a).sum(1, keepdims=True) * a
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    return np.stack([a, r * a + np.sqrt(1 - r * r) * e], 1).reshape(2 * n, d)


@pytest.mark.parametrize("d,r", [(40, 0.9001), (12, 0.9001), (300, 0.905)])
def test_recall_of_links(spark, d, r):
    """Through the operator: at least 0.999 of the pairs at the limit; wide rows are hashed in fewer columns."""
    assert linked(spark, limit_pairs(1500, d, r)) >= 0.999


@pytest.mark.parametrize("share", [0.025, 0.05, 0.1, 0.3])
def test_recall_with_lost_cells(spark, share):
    assert linked(spark, lossy_pairs(1500, share, 11)) >= 0.999


def test_sketches_bound_the_correlation():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 30)) * rng.choice([1, 8], (400, 1))
    y = x + rng.normal(size=x.shape) * rng.uniform(0.1, 1.2, (400, 1))
    y[::7, 3] = 90.0
    for z in (x, y):
        z[rng.random(z.shape) < 0.1] = np.nan
    x[5], y[6] = 2.0, np.nan
    ok, _ = K.alike_rows(x, y, 0.9)
    qx, qy = K.sketch(x), K.sketch(y)
    sure, maybe = K.judge_rows(qx, qy, 0.9)
    assert (ok[sure]).all() and (sure | maybe)[ok].all() and 100 < sure.sum() and maybe.sum() < 60
    all_sure, all_maybe = K.judge_all(qx, qy, 0.9)
    assert (all_sure.diagonal() == sure).all() and (all_maybe.diagonal() == maybe).all()


def test_pivots_are_local_minima(spark):
    rng = np.random.default_rng(5)
    edges = {tuple(sorted(map(int, rng.choice(60, 2, replace=False)))) for _ in range(150)}
    r = {e: float(rng.uniform(0.9, 1)) for e in edges}
    df = spark.createDataFrame([(a, b, r[a, b]) for a, b in edges], "a long, b long, r double")
    got = {x["id"]: x["pivot"] for x in K.pivot_rounds(df).collect()}
    rank = {x["id"]: (x["h"], x["id"]) for x in spark.range(60).select("id", F.xxhash64("id").alias("h")).collect()}
    near = defaultdict(dict)
    for (a, b), v in r.items():
        near[a][b] = near[b][a] = v
    left, pivots = set(near), set()
    for x in sorted(near, key=rank.get):  # one by one in the order of hashes
        if x in left:
            pivots.add(x)
            left -= {x, *near[x]}
    assert set(got) == set(near)
    for x, p in got.items():
        mine = {k: v for k, v in near[x].items() if k in pivots}
        assert p == (x if x in pivots else max(mine, key=mine.get))
    assert K.pivot_rounds(df.limit(0)).count() == 0


def lossy_pairs(n, share, seed, d=40):
    """2 n rows of normal cells, pairs 0.9 to 1 alike over the columns both have, ``share`` of the cells of each row lost."""
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < 2 * n:
        a = rng.normal(size=d)
        b = a + rng.normal(size=d) * 0.4
        for x in (a, b):
            x[rng.permutation(d)[: round(share * d)]] = np.nan
        m = ~np.isnan(a) & ~np.isnan(b)
        if m.sum() > 2 and np.corrcoef(a[m], b[m])[0, 1] >= 0.9:
            rows += [a, b]
    return np.array(rows)


@pytest.mark.parametrize("share", [0.2, 0.3, 0.5])
@pytest.mark.parametrize("bucket_rows", [2048, 64])
def test_rows_with_many_lost_cells_match_brute_force(spark, share, bucket_rows):
    x = np.concatenate([lossy_pairs(120, share, 5), np.random.default_rng(6).normal(size=(60, 40))])
    names = [f"r{i:03d}" for i in range(len(x))]
    v = np.exp2(x + 8) - 1
    m = K.cluster_rows(table(spark, v, names), "row", "col", "value", bucket_rows=bucket_rows)
    assert {tuple(r) for r in K.cluster_pairs(m).collect()} == brute(np.log2(1 + v), names)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["id"]: r["pivot"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140)) and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_descriptions(spark):
    v, names = made()
    m = K.cluster_rows(table(spark, v, names), "row", "col", "value")
    d = {r["medoid"]: (r["size"], r["typical"]) for r in K.describe_clusters(m).collect()}
    sizes = sorted(s for s, _ in d.values())
    assert sizes[-1] >= 60 and all(len(t) == min(3, s) and t[0] == k for k, (s, t) in d.items())


def test_empty_and_tiny(spark):
    schema = "row string, col string, value double"
    assert K.cluster_rows(spark.createDataFrame([], schema), "row", "col", "value").count() == 0
    one = K.cluster_rows(spark.createDataFrame([("a", "c", 1.0)], schema), "row", "col", "value")
    assert [r["row"] for r in one.collect()] == ["a"] and K.cluster_pairs(one).count() == 0
