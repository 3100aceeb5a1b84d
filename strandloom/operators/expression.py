"""Differential expression, permutations of labels, gene-set enrichment and k-means on long matrices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators import stats as S
from strandloom.operators.ordered import Ordered
from strandloom.session import bounded_broadcast, stage


def permuted_labels(samples: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(permutation, col, group): group labels dealt anew to the samples, group sizes kept.

    ``samples`` is (col, group), one row a sample.
    """
    s = samples.select("col", "group", F.row_number().over(Window.orderBy("col")).alias("_i"))  # one row a sample
    r = s.select("col", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("permutation"))
    r = r.withColumn("_i", F.row_number().over(Window.partitionBy("permutation").orderBy(F.xxhash64(F.lit(seed), "permutation", "col"), "col")))
    return r.join(s.select("_i", "group"), "_i").select("permutation", "col", "group")


def compare(m: DataFrame, samples: DataFrame, a: str, b: str, rounds: int = 0, seed: int = 0, logged: bool = True, tuning: float = 0.0) -> DataFrame:
    """Per row: t, fold, p, and from ``rounds`` label permutations empirical p, FDR and FWER of |t|."""
    j = m.join(bounded_broadcast(samples), "col")
    obs = S.fold_change(S.tuned_t(S.moments(j, ["row"], "group", "value", a, b), tuning), logged).withColumn("abs_t", F.abs("t"))
    if not rounds:
        return obs
    obs = stage(obs.filter(F.col("t").isNotNull()), "observed")
    perm = bounded_broadcast(permuted_labels(samples, rounds, seed))
    null = S.tuned_t(S.moments(m.join(perm, "col"), ["permutation", "row"], "group", "value", a, b), tuning).select("permutation", "row", F.abs("t").alias("abs_t")).filter(F.col("abs_t").isNotNull())
    null = stage(null, "null")
    out = S.family_wise(obs, null, "abs_t", "permutation")
    fdr = S.permutation_fdr(obs, null, "abs_t", rounds)
    per_row = null.join(obs.select("row", F.col("abs_t").alias("_o")), "row").groupBy("row").agg(((F.sum((F.col("abs_t") >= F.col("_o")).cast("int")) + 1) / (F.count("*") + 1)).alias("p_perm"))
    return out.join(fdr, "abs_t").join(per_row, "row", "left")


def running_enrichment(ranked: DataFrame, sets: DataFrame, weighted: bool = True) -> DataFrame:
    """(set, size, es): greatest deviation of the running sum over genes from the top score down, sign kept.

    ``ranked`` is (gene, score), ``sets`` (set, gene).  Hits add |score| / their total, misses take
    1 / (N - n).  Sets without a ranked gene, or holding all of them, give no row.  Only the
    hits are visited: between two hits the sum falls by a known amount, so its extremes lie
    just before and at hits.
    """
    r = Ordered(ranked.filter(F.col("score").isNotNull()), [], ["-score", "gene"]).row_number("_k")
    n_all = r.agg(F.count("*").alias("_all"))
    hit = sets.select("set", "gene").distinct().join(r, "gene").join(F.broadcast(n_all))
    w = Window.partitionBy("set").orderBy("_k")
    all_ = Window.partitionBy("set")
    weight = F.abs("score") if weighted else F.lit(1.0)
    hit = hit.withColumn("_w", weight).withColumn("_size", F.count("*").over(all_)).withColumn("_tot", F.sum("_w").over(all_))
    hit = hit.filter((F.col("_size") < F.col("_all")) & (F.col("_tot") > 0))
    i = F.row_number().over(w)
    misses = (F.col("_k") - i) / (F.col("_all") - F.col("_size"))
    up = F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("_tot")
    d = hit.withColumn("_at", up - misses).withColumn("_before", up - F.col("_w") / F.col("_tot") - misses)
    g = d.groupBy("set").agg(F.max("_size").alias("size"), F.max("_at").alias("_hi"), F.min("_before").alias("_lo"))
    return g.select("set", "size", F.when(F.col("_hi") >= -F.col("_lo"), F.col("_hi")).otherwise(F.col("_lo")).alias("es"))


def gene_set_max_mean(ranked: DataFrame, sets: DataFrame) -> DataFrame:
    return S.max_mean(sets.select("set", "gene").distinct().join(ranked, "gene"), ["set"], "score")


def restandardise(scores: DataFrame, permuted: DataFrame, key: str, value: str) -> DataFrame:
    """(x - mean of permutations) / sd of permutations, per key."""
    m = permuted.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return scores.join(m, key).withColumn("restandardised", (F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).drop("_m", "_s")


def set_enrichment(sets: DataFrame, selected: DataFrame, universe: int) -> DataFrame:
    """(set, size, hits, p): upper hypergeometric tail of the selected genes in each set."""
    n_sel = selected.select("gene").distinct().agg(F.count("*").alias("_sel"))
    s = sets.select("set", "gene").distinct()
    h = s.join(selected.select("gene").distinct().withColumn("_h", F.lit(1)), "gene", "left")
    g = h.groupBy("set").agg(F.count("*").alias("size"), F.count("_h").alias("hits")).join(F.broadcast(n_sel))
    return g.withColumn("p", S.hyper_p(F.lit(universe), "size", "_sel", "hits")).drop("_sel")


def signatures(m: DataFrame, samples: DataFrame, top: int) -> DataFrame:
    """(group, row, rank, diff): for every group the rows whose mean exceeds the mean of all other samples most."""
    j = m.join(bounded_broadcast(samples), "col").groupBy("row", "group").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("row")
    d = j.withColumn("diff", F.col("s") / F.col("n") - (F.sum("s").over(w) - F.col("s")) / F.nullif(F.sum("n").over(w) - F.col("n"), F.lit(0)))
    part = d.filter(F.col("diff").isNotNull()).withColumn("_p", F.pmod(F.xxhash64("row"), F.lit(64)))
    few = part.withColumn("_k", F.row_number().over(Window.partitionBy("group", "_p").orderBy(F.col("diff").desc(), "row"))).filter(F.col("_k") <= top)
    k = few.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.col("diff").desc(), "row"))).filter(F.col("rank") <= top)
    return k.select("group", "row", "rank", "diff")


def _distances(x: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Rows of ``x`` against rows of ``c``."""
    if metric == "euclidean":
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0))
    if metric == "manhattan":
        return np.stack([np.abs(x - y).sum(1) for y in c], 1)
    if metric == "pearson":
        u = [m - m.mean(1, keepdims=True) for m in (x, c)]
        u = [m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300) for m in u]
        return 1 - u[0] @ u[1].T
    if metric == "js":
        h = lambda p: -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(-1)
        return np.stack([np.sqrt(np.maximum(h((x + y) / 2) - (h(x) + h(y)) / 2, 0)) for y in c], 1)
    raise ValueError(metric)


def kmeans(profiles: DataFrame, k: int, metric: str = "euclidean", seed: int = 0, rounds: int = 10_000) -> DataFrame:
    """(row, cluster): assignments repeated until none changes, from ``k`` rows drawn by ``seed``.

    ``profiles`` is (row, profile); rows with a null in the profile are left out.  Centres are
    ``k`` arrays on the driver, assignment is numpy over Arrow batches, and new centres are
    one aggregation of its result.  Equal distances go to the lower cluster.  Assignments that
    come back after others, or don't settle in ``rounds``, are an error.
    """
    ok = stage(profiles.filter(F.forall("profile", lambda x: x.isNotNull())), "profiles")
    centres = np.array([r["profile"] for r in ok.orderBy(F.xxhash64(F.lit(seed), "row"), "row").limit(k).collect()], dtype=float)
    if not len(centres):
        return ok.select("row", F.lit(0).alias("cluster"))
    width = centres.shape[1]

    def assigned(c: np.ndarray) -> DataFrame:
        @F.pandas_udf("int")
        def nearest(p: pd.Series) -> pd.Series:
            return pd.Series(_distances(np.stack(p.to_numpy()).astype(float), c, metric).argmin(1).astype("int32") if len(p) else [], dtype="int32")

        return ok.withColumn("cluster", nearest("profile"))

    before, seen = None, set()
    placed = assigned(centres)
    for _ in range(rounds):
        means = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row", "cluster")).alias("h"), *[F.avg(F.get("profile", F.lit(i))).alias(f"m{i}") for i in range(width)]).collect()
        now = sorted((r["cluster"], r["n"], r["h"]) for r in means)
        if now == before:
            break
        if tuple(now) in seen:
            raise RuntimeError("assignments go in circles")
        seen.add(tuple(now))
        before = now
        centres = centres.copy()
        for r in means:
            centres[r["cluster"]] = [r[f"m{i}"] for i in range(width)]
        placed = assigned(centres)
    else:
        raise RuntimeError("assignments did not settle")
    return placed.select("row", "cluster")


def silhouette(profiles: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, n, silhouette) with squared Euclidean distances, from cluster sums alone (no pairs)."""
    j = profiles.join(clusters, "row")
    sq = F.aggregate("profile", F.lit(0.0), lambda s, x: s + x * x)
    base = stage(j.select("row", "cluster", "profile", sq.alias("q")), "silhouette")
    cells = base.select("cluster", F.posexplode("profile").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("s"))
    sums = cells.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("y"))
    tot = base.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("q").alias("q")).join(sums, "cluster")
    all_ = tot.agg(F.collect_list(F.struct("cluster", "n", "q", "y")).alias("t"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    d = base.join(F.broadcast(all_)).select("cluster", F.transform("t", lambda c: F.struct(c["cluster"].alias("c"), c["n"].alias("n"), (F.col("q") * c["n"] + c["q"] - 2 * dot(F.col("profile"), c["y"])).alias("d"))).alias("d"))
    own = F.get(F.filter("d", lambda c: c["c"] == F.col("cluster")), F.lit(0))
    a = F.try_divide(own["d"], own["n"] - 1)
    b = F.array_min(F.transform(F.filter("d", lambda c: c["c"] != F.col("cluster")), lambda c: c["d"] / c["n"]))
    s = F.when(own["n"] == 1, 0.0).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return d.select("cluster", s.alias("s")).groupBy("cluster").agg(F.count("*").alias("n"), F.avg("s").alias("silhouette"))
