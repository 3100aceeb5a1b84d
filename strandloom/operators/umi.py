"""Duplicate marking by molecular barcode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.ordered import Ordered


def barcode(name: Column, n: int) -> Column:
    """The last ``n`` characters of a read name; any N makes them one degenerate code."""
    code = F.substring(name, -n, n)
    return F.when(code.contains("N"), "N" * n).otherwise(code)


def mark_duplicates(reads: DataFrame, n: int, name: str = "name") -> DataFrame:
    """``duplicate``: true for all but the first row of every (chrom, start, end, barcode).

    The first row is the one with the least rec_id.  Unmapped reads are no duplicates.
    The first of each group is found by an aggregation with map-side combine, so a place
    covered by a third of all rows is no slow task.
    """
    key = ["chrom", "start_pos", "end_pos", "_code"]
    r = reads.withColumn("_code", barcode(F.col(name), n))
    mapped = F.col("chrom").isNotNull() & F.col("start_pos").isNotNull()
    first = r.filter(mapped & F.col("_code").isNotNull()).groupBy(*key).agg(F.min("rec_id").alias("rec_id")).select("rec_id").withColumn("_first", F.lit(True))
    j = r.join(first, "rec_id", "left")
    return j.withColumn("duplicate", mapped & F.col("_code").isNotNull() & F.col("_first").isNull()).drop("_code", "_first")


def clear_duplicate_flag(flag: Column) -> Column:
    return flag.bitwiseAND(~1024)


def set_duplicate_flag(flag: Column, duplicate: Column) -> Column:
    return F.when(duplicate, flag.bitwiseOR(1024)).otherwise(clear_duplicate_flag(flag))


def expected_distinct(k: Column, codes: int) -> Column:
    """Expected number of different barcodes among ``k`` molecules with ``codes`` equally likely ones."""
    return codes * (1 - F.pow(1 - F.lit(1.0) / codes, k))


def saturation(reads: DataFrame, n: int, name: str = "name") -> DataFrame:
    """(chrom, start_pos, end_pos, reads, barcodes, molecules): per place, molecules estimated from the barcodes seen.

    With all 4^n codes seen the estimate is the number of reads.
    """
    codes = 4**n
    g = reads.filter(F.col("chrom").isNotNull()).withColumn("_c", barcode(F.col(name), n)).groupBy("chrom", "start_pos", "end_pos").agg(F.count("*").alias("reads"), F.count_distinct("_c").alias("barcodes"))
    est = F.ln(1 - F.col("barcodes") / codes) / F.ln(F.lit(1 - 1 / codes))
    return g.withColumn("molecules", F.when(F.col("barcodes") >= codes, F.col("reads").cast("double")).otherwise(F.least(est, F.col("reads").cast("double"))))


def unmark_saturated(marked: DataFrame, n: int, name: str = "name") -> DataFrame:
    """``mark_duplicates`` output with as many duplicates of each place un-marked as collisions are expected there, lowest rec_id first."""
    place = ["chrom", "start_pos", "end_pos"]
    sat = saturation(marked, n, name).withColumn("_free", F.round(F.col("molecules") - F.col("barcodes")).cast("long")).filter(F.col("_free") > 0).select(*place, "_free")
    dup = marked.filter("duplicate").join(sat, place)
    back = Ordered(dup, place, ["rec_id"]).row_number("_i").filter(F.col("_i") <= F.col("_free")).select("rec_id").withColumn("_back", F.lit(True))
    return marked.join(back, "rec_id", "left").withColumn("duplicate", F.col("duplicate") & F.col("_back").isNull()).drop("_back")


def threshold_fit(sat: DataFrame) -> DataFrame:
    """One row: slope, intercept and mean squared error of barcodes against reads per place."""
    fit = sat.agg(F.regr_slope("barcodes", "reads").alias("slope"), F.regr_intercept("barcodes", "reads").alias("intercept"))
    e = F.col("barcodes") - F.col("slope") * F.col("reads") - F.col("intercept")
    return sat.join(F.broadcast(fit)).groupBy("slope", "intercept").agg(F.avg(e * e).alias("mse"))
