"""Window scores: counts, coverage, ratios and their p values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import kernels as K
from strandloom.operators import windows as W
from strandloom.session import table_broadcast

scan_p = K.arrow_udf(K.scan_pvalue)
poisson_p = K.arrow_udf(K.poisson_enrichment)
binomial_p = K.arrow_udf(K.binomial_enrichment)
binomial_upper = K.arrow_udf(lambda n, total, p: K.binomial_sf(n - 1, total, p))
binomial_lower = K.arrow_udf(K.binomial_cdf)
skellam_p = K.arrow_udf(K.skellam_score)
critical = K.arrow_udf(K.critical_count, "long")


def rpkm(count: Column, total: Column, length: Column) -> Column:
    return F.try_divide(count * 1e9, total * length)


def rpk(count: Column, length: Column) -> Column:
    return F.try_divide(count, length / 1000)


def ratio(a: Column, b: Column) -> Column:
    """Ratio of two RPKM values with 0.001 added to each."""
    return (a + 0.001) / (b + 0.001)


def enrichment_over_control(a: Column, b: Column, total_a: Column, total_b: Column) -> Column:
    return F.try_divide(F.try_divide(a, total_a), F.try_divide(b, total_b))


def global_stats(reads: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chrom, length, count, lambda): weighted reads per chromosome and their rate; unknown chromosomes are left out."""
    c = reads.groupBy("chrom").agg(F.sum("weight").alias("count"))
    return sizes.join(c, "chrom", "left").select("chrom", "length", F.coalesce("count", F.lit(0.0)).alias("count"), F.try_divide(F.coalesce("count", F.lit(0.0)), "length").alias("lambda"))


def window_counts(reads: DataFrame, sizes: DataFrame, size: int, overlap: int, fully_contained: bool = False) -> DataFrame:
    """Weighted reads of every window that has any."""
    inside = (F.col("r_start_pos") >= F.col("start_pos")) & (F.col("r_end_pos") <= F.col("end_pos"))
    w = F.when(inside, F.col("r_weight")).otherwise(0.0) if fully_contained else F.col("r_weight")
    return W.scan(reads, sizes, size, overlap, [F.sum(w).alias("count")])


def scored_windows(reads: DataFrame, sizes: DataFrame, size: int, overlap: int) -> DataFrame:
    """Window counts with RPKM, enrichment over the chromosome's rate and the scan-statistic p value."""
    stats = global_stats(reads, sizes)
    total = stats.agg(F.sum("count").alias("total"))
    c = window_counts(reads, sizes, size, overlap).join(table_broadcast(stats.withColumnRenamed("count", "chrom_count")), "chrom").join(F.broadcast(total))
    n = F.lit(float(size))
    c = c.withColumn("rpkm", rpkm(F.col("count"), F.col("total"), n)).withColumn("enrichment", F.try_divide(F.col("count") / n, "lambda"))
    return c.withColumn("scan_p", scan_p(F.col("count"), F.col("lambda"), n, F.col("length").cast("double")))


def two_sample_windows(sample: DataFrame, control: DataFrame, sizes: DataFrame, size: int, overlap: int) -> DataFrame:
    """Per window of either sample: both counts, ratio of RPKM, and Poisson, binomial and Skellam p values."""
    keys = ["chrom", "start_pos", "end_pos"]
    a = window_counts(sample, sizes, size, overlap).withColumnRenamed("count", "a")
    b = window_counts(control, sizes, size, overlap).withColumnRenamed("count", "b")
    j = a.join(b, keys, "full").fillna(0.0, ["a", "b"])
    sa = global_stats(sample, sizes).select("chrom", F.col("count").alias("region_a"), F.col("lambda").alias("la"))
    sb = global_stats(control, sizes).select("chrom", F.col("count").alias("region_b"), F.col("lambda").alias("lb"))
    ta, tb = sa.agg(F.sum("region_a").alias("total_a")), sb.agg(F.sum("region_b").alias("total_b"))
    j = j.join(sa, "chrom").join(sb, "chrom").join(F.broadcast(ta)).join(F.broadcast(tb))
    n = F.lit(float(size))
    ra, rb = rpkm(F.col("a"), F.col("total_a"), n), rpkm(F.col("b"), F.col("total_b"), n)
    p = F.try_divide(F.col("total_a"), F.col("total_a") + F.col("total_b"))
    return j.select(
        *keys, "a", "b", "region_a", "region_b", "total_a", "total_b", ratio(ra, rb).alias("ratio"), F.log2(ratio(ra, rb)).alias("log2_ratio"),
        enrichment_over_control(F.col("a"), F.col("b") + 1, F.col("total_a"), F.col("total_b")).alias("enrichment"),
        poisson_p(F.col("a"), F.col("b"), F.col("la"), F.col("lb"), n).alias("poisson_p"),
        binomial_p(F.col("a"), F.col("b"), F.col("region_a"), F.col("region_b")).alias("binomial_p"),
        binomial_upper(F.round("a"), F.round(F.col("a") + F.col("b")), p).alias("binomial_enrich_p"), binomial_lower(F.round("a"), F.round(F.col("a") + F.col("b")), p).alias("binomial_deplete_p"),
        skellam_p(F.col("a"), F.col("b"), F.col("la") * n, F.col("lb") * n).alias("skellam_p"),
    )


def list_scores() -> list[Column]:
    """Aggregates over the intervals of a window, for ``windows.scan``: count, sum of scores, of lengths, starts and ends inside."""
    o_start = F.when(F.col("r_strand") == "-", F.col("r_end_pos")).otherwise(F.col("r_start_pos"))
    o_end = F.when(F.col("r_strand") == "-", F.col("r_start_pos")).otherwise(F.col("r_end_pos"))
    inside = lambda c: F.sum(F.when((c > F.col("start_pos")) & (c < F.col("end_pos")), 1).otherwise(0))
    return [F.count("*").alias("n"), F.sum("r_score").alias("sum_score"), F.sum(F.col("r_end_pos") - F.col("r_start_pos")).alias("sum_length"), inside(o_start).alias("starts_in"), inside(o_end).alias("ends_in")]
