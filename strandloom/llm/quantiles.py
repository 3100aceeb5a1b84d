"""Exact percentiles per group of very large columns, and summaries that can be put together.

Exact form: one range sort of all values by (group, value, row hash), so that a hot
group and long runs of ties are spread over many partitions.  The rows of each
(partition, group) are counted; prefix sums of these counts say where every group's
positions lie, so the order statistics wanted are fetched by (partition, place) and
neighbouring ones are interpolated.  The error bound is 0 (double arithmetic).

Mergeable form: counts per (group, part, logarithmic bucket).  Adding the counts of
parts gives the summary of their union; a percentile read from it lies within the
relative error ``alpha`` of an order statistic at its position.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import bounded_broadcast, stage


def valid_values(df: DataFrame, group: str, value: str, once: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows whose value is finite and above 0, one per ``once`` columns (the least ``keep`` columns and value).

    A null group is no group; nulls in other key columns are values of their own.
    """
    v = F.col(value).cast("double")
    # abs(v) < infinity is false for NaN too, which Spark sorts above infinity.
    ok = df.filter(F.col(group).isNotNull() & (v > 0) & (v < float("inf")))
    least = F.min(F.struct(*keep, v.alias("_v"))).alias("_least")
    return ok.groupBy(*once).agg(least).select(*once, *[F.col(f"_least.{k}").alias(k) for k in keep], F.col("_least._v").alias(value))


def exact_percentiles(df: DataFrame, group: str, value: str, probs: Sequence[float]) -> DataFrame:
    """(group, prob, n, percentile) of ``value`` per ``group``, linearly interpolated between order statistics.

    Null values and null groups don't count; a group without values gives no row; an
    empty frame gives no rows.  Ties are order statistics like any others.
    """
    rows = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    # The last sort key only splits long runs of one value over partitions.
    spread = rows.withColumn("_t", F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()))
    placed = spread.repartitionByRange("g", "v", "_t").sortWithinPartitions("g", "v", "_t")
    placed = placed.select("g", "v", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("at"))
    sorted_rows = stage(placed, "sorted")
    counts = sorted_rows.groupBy("g", "pid").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    w = Window.partitionBy("g").orderBy("pid")
    offsets = counts.select("g", "pid", "n", "first", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("g")).alias("total"))
    where = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    want = offsets.select("*", where).withColumn("pos", F.col("prob") * (F.col("total") - 1))
    want = want.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))))
    want = want.filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
    want = want.select("g", "prob", "pos", "rank", "total", "pid", (F.col("first") + F.col("rank") - F.col("before")).alias("at"))
    hit = sorted_rows.select("pid", "at", "v").join(bounded_broadcast(want), ["pid", "at"])
    lo, hi = F.min_by("v", "rank"), F.max_by("v", "rank")
    frac = F.max(F.col("pos") - F.floor("pos"))
    out = hit.groupBy("g", "prob").agg(F.max("total").alias("n"), (lo + (hi - lo) * frac).alias("percentile"))
    return out.withColumnRenamed("g", group)


def log_bucket(value: Column, alpha: float) -> Column:
    """Number of the bucket (gamma^(b-1), gamma^b] with gamma = (1 + alpha) / (1 - alpha)."""
    return F.ceil(F.log(value) / math.log((1 + alpha) / (1 - alpha))).cast("long")


def summaries(df: DataFrame, keys: Sequence[str], value: str, alpha: float = 0.01) -> DataFrame:
    """(keys, bucket, n): counts of positive values in logarithmic buckets; other values are left out.

    Summaries of parts are put together by adding ``n`` per (group, bucket).
    """
    ok = df.filter((F.col(value) > 0) & (F.col(value) < float("inf")))
    return ok.groupBy(*keys, log_bucket(F.col(value), alpha).alias("bucket")).agg(F.count("*").alias("n"))


def summary_percentiles(summary: DataFrame, group: str, probs: Sequence[float], alpha: float = 0.01) -> DataFrame:
    """(group, prob, n, percentile) from summaries of any number of parts, within ``alpha`` of the order statistic at floor(prob * (n - 1))."""
    merged = summary.groupBy(group, "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(group).orderBy("bucket")  # buckets per group are bounded by the range of doubles
    cum = merged.select(group, "bucket", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy(group)).alias("total"))
    at = cum.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    gamma = (1 + alpha) / (1 - alpha)
    hit = at.filter(F.col("upto") > F.floor(F.col("prob") * (F.col("total") - 1)))
    mid = F.pow(F.lit(gamma), F.min("bucket")) * (2 / (1 + gamma))
    return hit.groupBy(group, "prob").agg(F.max("total").alias("n"), mid.alias("percentile"))
