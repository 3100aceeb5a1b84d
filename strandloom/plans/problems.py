"""Queries of the general data-pipeline problems: hot keys, bad rows, covered periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import balance, periods, rejects
from strandloom.plans.tables import Registry, chrom_key, table
from strandloom.session import table_broadcast

R = Registry()


def _spelled(spark: SparkSession, d: str) -> DataFrame:
    """Chromosome key to the spelling of chrom_sizes."""
    sizes = table(spark, d, "chrom_sizes").filter(F.col("chrom").isNotNull())
    return sizes.groupBy(chrom_key("chrom").alias("key")).agg(F.min("chrom").alias("spelled"), F.max("length").alias("length"))


def read_keys(spark: SparkSession, d: str) -> DataFrame:
    """One row per key of every read: field, value, weight.  Null keys give no row."""
    name = F.struct(F.lit("name").alias("key_field"), F.regexp_replace("name", "/[12]$", "").alias("key_value"))
    chrom = F.struct(F.lit("chrom").alias("key_field"), chrom_key("chrom").alias("key_value"))
    r = table(spark, d, "reads").select("weight", F.inline(F.array(name, chrom)))
    return r.filter(F.col("key_value").isNotNull())


def key_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows and summed weight of every read name and chromosome."""
    sums = balance.balanced_sums(read_keys(spark, d), ["key_field", "key_value"], {"weight": F.col("weight")})
    named = sums.join(table_broadcast(_spelled(spark, d)).withColumn("key_field", F.lit("chrom")).withColumnRenamed("key", "key_value"), ["key_field", "key_value"], "left")
    return named.select("key_field", F.coalesce("spelled", "key_value").alias("key_value"), F.col("n").alias("n_rows"), "weight")


KEYS_SQL = """
keys AS (
  SELECT 'name' AS key_field, regexp_replace(name, '/[12]$', '') AS key_value, weight FROM reads
  UNION ALL
  SELECT 'chrom', coalesce(c.chrom, lower(trim(r.chrom))), r.weight
  FROM reads r LEFT JOIN chrom_sizes c ON lower(trim(r.chrom)) = lower(c.chrom)
)"""


@R.add("p1_found", f"""
WITH {KEYS_SQL}
SELECT key_field, key_value FROM keys WHERE key_value IS NOT NULL
GROUP BY 1, 2 HAVING count(*) * 50 >= (SELECT count(*) FROM reads)
""")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    total = table(spark, d, "reads").agg(F.count("*").alias("total"))
    return key_totals(spark, d).join(F.broadcast(total)).filter(F.col("n_rows") * 50 >= F.col("total")).select("key_field", "key_value")


@R.add("p1_key_totals", f"""
WITH {KEYS_SQL}
SELECT key_field, key_value, count(*) AS n_rows, round(sum(coalesce(weight, 0)), 3) AS weight
FROM keys WHERE key_value IS NOT NULL GROUP BY 1, 2
""")
def p1_key_totals(spark: SparkSession, d: str) -> DataFrame:
    return key_totals(spark, d).withColumn("weight", F.round("weight", 3))


@R.add("p1_depth_by_chrom", """
SELECT c.chrom, count(*) AS n_rows, round(sum(coalesce(r.weight, 0) * coalesce(r.end_pos - r.start_pos, 0)) / max(c.length) * 1e6, 4) AS depth_ppm
FROM reads r JOIN chrom_sizes c ON lower(trim(r.chrom)) = lower(c.chrom) GROUP BY 1
""")
def p1_depth_by_chrom(spark: SparkSession, d: str) -> DataFrame:
    """Every read meets its chromosome's row by a fragment-replicate join."""
    reads = table(spark, d, "reads").select(chrom_key("chrom").alias("key"), "weight", "start_pos", "end_pos")
    plan = balance.plan_load(reads, ["key"])
    j = balance.balanced_join(reads, _spelled(spark, d), ["key"], plan=plan)
    depth = F.try_divide(F.sum(F.coalesce(F.col("weight") * (F.col("end_pos") - F.col("start_pos")), F.lit(0.0))), F.max("length")) * 1e6
    return j.groupBy(F.col("spelled").alias("chrom")).agg(F.count("*").alias("n_rows"), F.round(depth, 4).alias("depth_ppm"))


def parsed_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "annotation_lines").select("line_id", "raw_line", "layout")
    return rejects.parse_lines(lines, table(spark, d, "chrom_sizes"))


@R.add("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    _, bad = rejects.split_rows(parsed_lines(spark, d))
    return bad.select("line_id", rejects.reason(F.col("errors")).alias("reason"))


@R.add("p4_valid_lines")
def p4_valid_lines(spark: SparkSession, d: str) -> DataFrame:
    """Valid annotation lines as typed BED columns and track lines as their name."""
    good, _ = rejects.split_rows(parsed_lines(spark, d))
    f = lambda i: F.get("fields", F.lit(i))
    return good.select(
        "line_id", "kind", f(0).alias("chrom"), f(1).cast("long").alias("start_pos"), f(2).cast("long").alias("end_pos"),
        F.coalesce(f(3), F.get(F.filter("track", lambda w: w["k"] == "name")["v"], F.lit(0))).alias("name"), f(4).cast("double").alias("score"), f(5).alias("strand"), F.size("track").alias("n_track_keys"),
    )


@R.add("p4_error_counts")
def p4_error_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each rule is broken, over all failed lines."""
    _, bad = rejects.split_rows(parsed_lines(spark, d))
    return bad.select("kind", F.explode("errors").alias("error")).groupBy("kind", "error").agg(F.count("*").alias("n"))


def stored_intervals(spark: SparkSession, d: str) -> DataFrame:
    """intervals with chromosomes as spelled in chrom_sizes (unknown ones without case and blanks)."""
    iv = table(spark, d, "intervals").select("interval_id", "chrom", "start_pos", "end_pos", "name", "score", "strand").withColumn("key", chrom_key("chrom"))
    j = iv.join(table_broadcast(_spelled(spark, d).drop("length")), "key", "left")
    return j.withColumn("chrom", F.coalesce("spelled", "key")).drop("key", "spelled")


PERIODS_SQL = """
iv AS (
  SELECT coalesce(c.chrom, lower(trim(i.chrom))) AS chrom, start_pos, end_pos
  FROM intervals i LEFT JOIN chrom_sizes c ON lower(trim(i.chrom)) = lower(c.chrom)
  WHERE i.chrom IS NOT NULL AND end_pos > start_pos
), far AS (
  SELECT *, max(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv
), isl AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR start_pos > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS g FROM far
), per AS (
  SELECT chrom, g, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM isl GROUP BY 1, 2
), gaps AS (
  SELECT chrom, end_pos AS start_pos, lead(start_pos) OVER (PARTITION BY chrom ORDER BY start_pos) AS end_pos FROM per
)"""


@R.add("p5_found", f"""
WITH {PERIODS_SQL}
SELECT 'period' AS kind, chrom, start_pos, end_pos FROM per
UNION ALL SELECT 'gap', chrom, start_pos, end_pos FROM gaps WHERE end_pos - start_pos <= 10000
""")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = periods.periods_and_gaps(stored_intervals(spark, d), "chrom").withColumnRenamed("key", "chrom")
    return out.filter((F.col("kind") == "period") | (F.col("end_pos") - F.col("start_pos") <= 10_000))


@R.add("p5_coverage_steps", """
WITH ev AS (
  SELECT coalesce(c.chrom, lower(trim(i.chrom))) AS chrom, unnest([start_pos, end_pos]) AS pos, unnest([1, -1]) AS delta
  FROM intervals i LEFT JOIN chrom_sizes c ON lower(trim(i.chrom)) = lower(c.chrom)
  WHERE i.chrom IS NOT NULL AND end_pos > start_pos
), s AS (SELECT chrom, pos, sum(delta) AS delta FROM ev GROUP BY 1, 2)
SELECT chrom, pos, CAST(sum(delta) OVER (PARTITION BY chrom ORDER BY pos) AS BIGINT) AS active FROM s
""")
def p5_coverage_steps(spark: SparkSession, d: str) -> DataFrame:
    """Number of intervals covering each stretch, from ``pos`` on."""
    return periods.sweep(stored_intervals(spark, d), "chrom").select(F.col("key").alias("chrom"), "pos", "active")
