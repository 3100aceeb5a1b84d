"""Set algebra of interval tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import periods
from strandloom.operators.join import overlap_join


def merged(df: DataFrame, by: list[str] | None = None, touching: bool = False) -> DataFrame:
    """(by, start_pos, end_pos): overlapping intervals united per ``by`` (default the chromosome).

    ``touching`` also unites intervals of which one starts where another ends.  Null keys and
    invalid intervals are left out.
    """
    by = by or ["chrom"]
    keyed = df.filter(" AND ".join(f"{c} IS NOT NULL" for c in by)).withColumn("_key", F.to_json(F.struct(*by)) if len(by) > 1 else F.col(by[0]))
    if touching:
        out = periods.periods_and_gaps(keyed, "_key").filter("kind = 'period'")
    else:
        # Doubling coordinates and pulling ends in by a half leaves touching intervals apart.
        half = keyed.filter(F.col("end_pos") > F.col("start_pos")).select("_key", (F.col("start_pos") * 2).alias("start_pos"), (F.col("end_pos") * 2 - 1).alias("end_pos"))
        p = periods.periods_and_gaps(half, "_key").filter("kind = 'period'")
        out = p.select("key", (F.col("start_pos") / 2).cast("long").alias("start_pos"), ((F.col("end_pos") + 1) / 2).cast("long").alias("end_pos"))
    if len(by) == 1:
        return out.select(F.col("key").alias(by[0]), "start_pos", "end_pos")
    types = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in by)
    return out.select(F.from_json("key", types).alias("k"), "start_pos", "end_pos").select("k.*", "start_pos", "end_pos")


def complement(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """Parts of every chromosome of ``sizes`` (chrom, length) that ``df`` leaves uncovered."""
    edge = sizes.select("chrom", F.inline(F.array(F.struct(F.lit(-1).cast("long").alias("start_pos"), F.lit(0).cast("long").alias("end_pos")), F.struct(F.col("length").alias("start_pos"), (F.col("length") + 1).alias("end_pos")))))
    known = df.select("chrom", "start_pos", "end_pos").join(sizes.select("chrom"), "chrom", "left_semi")
    gaps = periods.periods_and_gaps(known.unionByName(edge), "chrom").filter("kind = 'gap'")
    return gaps.select(F.col("key").alias("chrom"), "start_pos", "end_pos")


def intersect_pairs(a: DataFrame, b: DataFrame, **kw) -> DataFrame:
    """The left row of every overlapping pair, its bounds cut to the common part."""
    j = overlap_join(a, b, "inner", **kw)
    return j.withColumn("start_pos", F.greatest("start_pos", "start_pos_r")).withColumn("end_pos", F.least("end_pos", "end_pos_r"))


def subtract(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, chrom, start_pos, end_pos): pieces of every row of ``a`` that no row of ``b`` covers."""
    cover = merged(b, touching=True)
    hit = overlap_join(a.select(key, "chrom", "start_pos", "end_pos"), cover, "left")
    per = hit.groupBy(key, "chrom", "start_pos", "end_pos").agg(F.array_sort(F.collect_list(F.when(F.col("start_pos_r").isNotNull(), F.struct(F.col("start_pos_r").alias("start"), F.col("end_pos_r").alias("end"))))).alias("cut"))
    starts = F.concat(F.array(F.col("start_pos")), F.transform("cut", lambda x: x["end"]))
    ends = F.concat(F.transform("cut", lambda x: x["start"]), F.array(F.col("end_pos")))
    pieces = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(F.greatest(s, F.col("start_pos")).alias("s"), F.least(e, F.col("end_pos")).alias("e"))), lambda p: p["s"] < p["e"])
    return per.select(key, "chrom", F.inline(pieces)).withColumnsRenamed({"s": "start_pos", "e": "end_pos"})


def base_coverage(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bases covered at least once, per ``by``."""
    by = by or ["chrom"]
    return merged(df, by).groupBy(*by).agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"))


def clusters(df: DataFrame, key: str) -> DataFrame:
    """(key, chrom, cluster_start, cluster_end): the merged interval each row lies in."""
    m = merged(df)
    j = overlap_join(df.select(key, "chrom", "start_pos", "end_pos"), m, "inner", contained="left")
    return j.select(key, "chrom", F.col("start_pos_r").alias("cluster_start"), F.col("end_pos_r").alias("cluster_end"))
