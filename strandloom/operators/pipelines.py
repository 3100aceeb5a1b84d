"""Composite analyses: several samples at once, permutations of samples or places, enrichment pipelines."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import expression as E
from strandloom.operators import matrix as M
from strandloom.operators import scores as SC
from strandloom.operators import setops
from strandloom.operators import stats as S
from strandloom.operators import windows as W
from strandloom.operators.join import overlap_join
from strandloom.session import bounded_broadcast, stage, table_broadcast


def sample_windows(reads: DataFrame, sizes: DataFrame, size: int, overlap: int, sample: str) -> DataFrame:
    """(sample, chrom, start_pos, end_pos, count): weighted reads per window and sample, in one pass over all samples."""
    step = W._step(size, overlap)
    ok = reads.filter(F.col("chrom").isNotNull() & (F.col("end_pos") > F.col("start_pos")) & F.col(sample).isNotNull())
    hit = ok.select(F.col(sample).alias("sample"), "chrom", "weight", F.explode(W._hit_windows(F.col("start_pos"), F.col("end_pos"), size, step)).alias("_w"))
    c = hit.groupBy("sample", "chrom", "_w").agg(F.sum("weight").alias("count"))
    out = c.select("sample", "chrom", (F.col("_w") * step).alias("start_pos"), (F.col("_w") * step + size).alias("end_pos"), "count")
    return out.join(table_broadcast(sizes.select("chrom", "length")), "chrom").filter(F.col("end_pos") <= F.col("length")).drop("length")


def group_windows(counts: DataFrame, groups: DataFrame, a: str, b: str, rounds: bool = True, tuning: float = 0.0) -> DataFrame:
    """(chrom, start_pos, end_pos, t, p_perm): t statistic of normalised counts between sample groups, and the share of all label assignments with as large a |t|.

    ``groups`` is (sample, group); samples without reads in a window count as 0.  All ways of
    choosing group ``a``'s samples are tried, so this is meant for few samples (at most 5,000 ways).
    """
    g = [(r["sample"], r["group"]) for r in groups.collect()]
    names = [s for s, _ in g]
    k = sum(x == a for _, x in g)
    if not 0 < k < len(g):  # nothing to compare
        none = counts.sparkSession.createDataFrame([], "t double, p_perm double")
        return counts.select("chrom", "start_pos", "end_pos").limit(0).join(none if rounds else none.drop("p_perm"))
    if math.comb(len(names), k) > 5_000:
        raise ValueError("too many sample permutations")
    total = counts.groupBy("sample").agg(F.sum("count").alias("_t"))
    norm = counts.join(bounded_broadcast(total), "sample").withColumn("v", F.try_divide(F.col("count") * 1e6, F.col("_t")))
    place = ["chrom", "start_pos", "end_pos"]
    wide = norm.groupBy(*place).agg(*[F.coalesce(F.sum(F.when(F.col("sample") == s, F.col("v"))), F.lit(0.0)).alias(f"s{i}") for i, s in enumerate(names)])

    def t_of(chosen: Sequence[int]):
        x = [F.col(f"s{i}") for i in range(len(names)) if i in chosen]
        y = [F.col(f"s{i}") for i in range(len(names)) if i not in chosen]
        mean = lambda c: sum(c[1:], c[0]) / len(c)
        ss = lambda c, m: sum(((v - m) * (v - m) for v in c[1:]), (c[0] - m) * (c[0] - m))
        mx, my = mean(x), mean(y)
        pooled = F.sqrt((ss(x, mx) + ss(y, my)) / max(1, len(names) - 2))
        return F.try_divide(mx - my, pooled * math.sqrt(1 / len(x) + 1 / len(y)) + tuning)

    real = tuple(i for i, (_, x) in enumerate(g) if x == a)
    out = wide.withColumn("t", t_of(real))
    if rounds:
        ways = list(itertools.combinations(range(len(names)), k))
        beat = sum((F.when(F.abs(t_of(w)) >= F.abs(F.col("t")) - 1e-9, 1).otherwise(0) for w in ways), F.lit(0))
        out = out.withColumn("p_perm", beat / len(ways))
    return out.select(*place, "t", *(["p_perm"] if rounds else []))


def multi_sample_peaks(reads: DataFrame, sizes: DataFrame, size: int, overlap: int, sample: str, alpha: float, least_samples: int) -> DataFrame:
    """(chrom, start_pos, end_pos, samples): windows scan-significant in at least ``least_samples`` samples, merged."""
    c = sample_windows(reads, sizes, size, overlap, sample)
    st = reads.filter(F.col(sample).isNotNull()).groupBy(F.col(sample).alias("sample"), "chrom").agg(F.sum("weight").alias("_n")).join(sizes.select("chrom", "length"), "chrom")
    j = c.join(bounded_broadcast(st), ["sample", "chrom"]).withColumn("p", SC.scan_p("count", F.col("_n") / F.col("length"), F.lit(float(size)), F.col("length").cast("double")))
    hit = stage(j.filter(F.col("p") < alpha).groupBy("chrom", "start_pos", "end_pos").agg(F.count("*").alias("samples")).filter(F.col("samples") >= least_samples), "peaks")
    m = setops.merged(hit)
    return overlap_join(m, hit, "inner", contained="right").groupBy("chrom", "start_pos", "end_pos").agg(F.max("samples_r").alias("samples"))


def scan_null(reads: DataFrame, sizes: DataFrame, size: int, rounds: int, seed: int) -> DataFrame:
    """(permutation, max_count): greatest window count after moving all reads at random."""
    r = W.relocate(reads.select("rec_id", "chrom", "start_pos", "end_pos", "weight"), sizes, "rec_id", seed, rounds=rounds)
    hit = r.filter(F.col("start_pos").isNotNull()).select("permutation", "chrom", "weight", F.explode(W._hit_windows(F.col("start_pos"), F.col("end_pos"), size, size)).alias("_w"))
    return hit.groupBy("permutation", "chrom", "_w").agg(F.sum("weight").alias("n")).groupBy("permutation").agg(F.max("n").alias("max_count"))


def normalised_counts(regions: DataFrame, reads: DataFrame, key: str, parents: DataFrame | None = None, fragment: float | None = None) -> DataFrame:
    """(key, count, per_fragment, over_parent): raw weighted count, count over (length / fragment size), and average over the parent's average.

    ``parents`` has the same keys; without it the last column is null.  The fragment factor is 1 without a size.
    """
    n = overlap_join(regions, reads, "inner").groupBy(key, (F.col("end_pos") - F.col("start_pos")).alias("_l")).agg(F.sum("weight_r").alias("count"))
    factor = F.col("_l") / fragment if fragment else F.lit(1.0)
    out = n.withColumn("per_fragment", F.col("count") / factor)
    if parents is None:
        return out.select(key, "count", "per_fragment", F.lit(None).cast("double").alias("over_parent"))
    p = overlap_join(parents, reads, "inner").groupBy(key, (F.col("end_pos") - F.col("start_pos")).alias("_pl")).agg(F.sum("weight_r").alias("_pc"))
    return out.join(p, key, "left").select(key, "count", "per_fragment", F.try_divide(F.col("count") / F.col("_l"), F.col("_pc") / F.col("_pl")).alias("over_parent"))


def count_matrix(regions: DataFrame, reads: DataFrame, key: str, sample: str) -> DataFrame:
    """Long matrix (row, col, value): weighted reads of every sample over every region, per million reads of the sample."""
    total = reads.filter(F.col(sample).isNotNull()).groupBy(F.col(sample).alias("col")).agg(F.sum("weight").alias("_t"))
    c = overlap_join(regions, reads, "inner").groupBy(F.col(key).alias("row"), F.col(f"{sample}_r").alias("col")).agg(F.sum("weight_r").alias("_c"))
    return c.join(bounded_broadcast(total), "col").select("row", "col", F.try_divide(F.col("_c") * 1e6, F.col("_t")).alias("value"))


def batch_fold(m: DataFrame, batches: DataFrame) -> DataFrame:
    """Values less the median of their row within their batch (``batches`` is (col, batch))."""
    j = m.join(bounded_broadcast(batches), "col")
    med = j.groupBy("row", "batch").agg(F.median("value").alias("_m"))  # one row's cells of one batch
    return j.join(med, ["row", "batch"]).select("row", "col", (F.col("value") - F.col("_m")).alias("value"))


def time_series(m: DataFrame, times: DataFrame) -> DataFrame:
    """(row, from_time, to_time, fold): difference of mean values between consecutive time points (``times`` is (col, time))."""
    from pyspark.sql import Window

    a = m.join(bounded_broadcast(times), "col").groupBy("row", "time").agg(F.avg("value").alias("v"))
    w = Window.partitionBy("row").orderBy("time")
    return a.withColumn("from_time", F.lag("time").over(w)).withColumn("fold", F.col("v") - F.lag("v").over(w)).filter(F.col("from_time").isNotNull()).select("row", "from_time", F.col("time").alias("to_time"), "fold")


def gsea(m: DataFrame, samples: DataFrame, sets: DataFrame, a: str, b: str, rounds: int, seed: int) -> DataFrame:
    """(set, size, es, nes, p, fdr): running enrichment of t-ranked rows, against label permutations.

    ``nes`` divides by the mean size of the permuted scores of the same sign.
    """
    labels = E.permuted_labels(samples, rounds, seed).unionByName(samples.select(F.lit(0).alias("permutation"), "col", "group"))
    t = S.tuned_t(S.moments(m.join(bounded_broadcast(labels), "col"), ["permutation", "row"], "group", "value", a, b)).filter(F.col("t").isNotNull()).select("permutation", F.col("row").alias("gene"), F.col("t").alias("score"))
    t = stage(t, "ranked")
    es = stage(_enrichment_by(t, sets), "es")
    null = es.filter("permutation > 0")
    scale = null.groupBy("set").agg(F.avg(F.when(F.col("es") >= 0, F.col("es"))).alias("_pos"), F.avg(F.when(F.col("es") < 0, -F.col("es"))).alias("_neg"))
    j = es.join(scale, "set").withColumn("nes", F.try_divide("es", F.when(F.col("es") >= 0, F.col("_pos")).otherwise(F.col("_neg"))))
    j = stage(j, "nes")
    obs = j.filter("permutation = 0").select("set", "size", "es", "nes")
    same = j.filter("permutation > 0").select("set", F.col("es").alias("_e")).join(obs.select("set", "es"), "set").filter((F.col("_e") >= 0) == (F.col("es") >= 0))
    p = same.groupBy("set").agg((F.sum((F.abs("_e") >= F.abs("es")).cast("int")) / F.count("*")).alias("p"))
    fdr = S.permutation_fdr(obs.filter("nes is not null").select(F.abs("nes").alias("v")), j.filter("permutation > 0 and nes is not null").select(F.abs("nes").alias("v")), "v", rounds)
    return obs.join(p, "set", "left").withColumn("v", F.abs("nes")).join(fdr, "v", "left").drop("v")


def _enrichment_by(ranked: DataFrame, sets: DataFrame) -> DataFrame:
    """``running_enrichment`` for every permutation at once."""
    from pyspark.sql import Window

    from strandloom.operators.ordered import Ordered

    r = Ordered(ranked, ["permutation"], ["-score", "gene"]).row_number("_k")
    n = ranked.groupBy("permutation").agg(F.count("*").alias("_all"))
    hit = sets.select("set", "gene").distinct().join(r, "gene").join(bounded_broadcast(n), "permutation")
    w, all_ = Window.partitionBy("permutation", "set").orderBy("_k"), Window.partitionBy("permutation", "set")
    hit = hit.withColumn("_w", F.abs("score")).withColumn("_size", F.count("*").over(all_)).withColumn("_tot", F.sum("_w").over(all_)).filter((F.col("_size") < F.col("_all")) & (F.col("_tot") > 0))
    misses = (F.col("_k") - F.row_number().over(w)) / (F.col("_all") - F.col("_size"))
    up = F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("_tot")
    d = hit.withColumn("_at", up - misses).withColumn("_before", up - F.col("_w") / F.col("_tot") - misses)
    g = d.groupBy("permutation", "set").agg(F.max("_size").alias("size"), F.max("_at").alias("_hi"), F.min("_before").alias("_lo"))
    return g.select("permutation", "set", "size", F.when(F.col("_hi") >= -F.col("_lo"), F.col("_hi")).otherwise(F.col("_lo")).alias("es"))


def pattern_enrichment(m: DataFrame, pattern: DataFrame, sets: DataFrame) -> DataFrame:
    """Running enrichment of rows ranked by their correlation with a pattern over the columns (``pattern`` is (col, x))."""
    c = m.join(bounded_broadcast(pattern), "col").groupBy(F.col("row").alias("gene")).agg(M.corr_of("value", "x").alias("score")).filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return E.running_enrichment(c, sets)


def page_confidence(obs: DataFrame, null: DataFrame, value: str, rounds: int) -> DataFrame:
    """``confidence``: 1 - (mean permuted rows at least as large) / (observed rows at least as large), at least 0."""
    f = S.permutation_fdr(obs, null, value, rounds)
    return obs.join(f, value).withColumn("confidence", 1 - F.col("fdr")).drop("fdr")
