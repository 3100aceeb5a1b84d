"""Interval algebra on the stored intervals: joins, nearest features, set operations, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import blocks as B
from strandloom.operators import join as J
from strandloom.operators import peaks as P
from strandloom.operators import scores as SC
from strandloom.operators import setops as S
from strandloom.operators import stats as T
from strandloom.operators import windows as W
from strandloom.operators.ordered import Ordered
from strandloom.plans.problems import stored_intervals
from strandloom.plans.tables import Registry, table

R = Registry()

IV = """
iv AS (
  SELECT interval_id, coalesce(c.chrom, lower(trim(i.chrom))) AS chrom, start_pos, end_pos, name, score, strand
  FROM intervals i LEFT JOIN chrom_sizes c ON lower(trim(i.chrom)) = lower(c.chrom)
  WHERE i.chrom IS NOT NULL AND end_pos > start_pos
), pl AS (SELECT * FROM iv WHERE strand = '+'), mi AS (SELECT * FROM iv WHERE strand = '-')"""
HIT = "a.chrom = b.chrom AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos"


def iv(spark: SparkSession, d: str) -> DataFrame:
    return stored_intervals(spark, d).filter(F.col("chrom").isNotNull() & (F.col("end_pos") > F.col("start_pos"))).select("interval_id", "chrom", "start_pos", "end_pos", "name", "score", "strand")


def plus(spark: SparkSession, d: str) -> DataFrame:
    return iv(spark, d).filter(F.col("strand") == "+")


def minus(spark: SparkSession, d: str) -> DataFrame:
    return iv(spark, d).filter(F.col("strand") == "-")


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chrom_sizes").select("chrom", "length").filter(F.col("chrom").isNotNull() & (F.col("length") > 0))


# --- joins -------------------------------------------------------------------------------


@R.add("overlap_inner", f"WITH {IV} SELECT a.interval_id AS a_id, b.interval_id AS b_id, greatest(a.start_pos, b.start_pos) AS start_pos, least(a.end_pos, b.end_pos) AS end_pos FROM pl a JOIN mi b ON {HIT}")
def overlap_inner(spark, d):
    j = S.intersect_pairs(plus(spark, d), minus(spark, d))
    return j.select(F.col("interval_id").alias("a_id"), F.col("interval_id_r").alias("b_id"), "start_pos", "end_pos")


@R.add("overlap_semi", f"WITH {IV} SELECT interval_id FROM pl a WHERE EXISTS (SELECT 1 FROM mi b WHERE {HIT})")
def overlap_semi(spark, d):
    return J.overlap_join(plus(spark, d), minus(spark, d), "left_semi").select("interval_id")


@R.add("overlap_anti", f"WITH {IV} SELECT interval_id FROM pl a WHERE NOT EXISTS (SELECT 1 FROM mi b WHERE {HIT})")
def overlap_anti(spark, d):
    return J.overlap_join(plus(spark, d), minus(spark, d), "left_anti").select("interval_id")


@R.add("overlap_count", f"WITH {IV} SELECT a.interval_id, count(b.interval_id) AS n, count(DISTINCT (b.start_pos, b.end_pos)) FILTER (b.interval_id IS NOT NULL) AS n_places FROM pl a LEFT JOIN mi b ON {HIT} GROUP BY 1")
def overlap_count(spark, d):
    out = J.count_overlaps(plus(spark, d).select("interval_id", "chrom", "start_pos", "end_pos"), minus(spark, d), ["interval_id"], [F.count("*").alias("n"), F.count_distinct("start_pos_r", "end_pos_r").alias("n_places")])
    return out.select("interval_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_places", F.lit(0)).alias("n_places"))


@R.add("overlap_same_strand", f"WITH {IV} SELECT a.interval_id AS a_id, b.interval_id AS b_id FROM iv a JOIN iv b ON {HIT} AND a.strand = b.strand WHERE a.interval_id < b.interval_id")
def overlap_same_strand(spark, d):
    i = iv(spark, d)
    j = J.overlap_join(i, i, "inner", strand=True, residual=F.col("interval_id") < F.col("interval_id_r"))
    return j.select(F.col("interval_id").alias("a_id"), F.col("interval_id_r").alias("b_id"))


@R.add("overlap_within_100", f"WITH {IV} SELECT interval_id FROM pl a WHERE EXISTS (SELECT 1 FROM mi b WHERE a.chrom = b.chrom AND a.start_pos < b.end_pos + 100 AND b.start_pos - 100 < a.end_pos)")
def overlap_within_100(spark, d):
    return J.overlap_join(plus(spark, d), minus(spark, d), "left_semi", slack=100).select("interval_id")


@R.add("contained_in", f"WITH {IV} SELECT a.interval_id AS child, b.interval_id AS parent FROM pl a JOIN mi b ON a.chrom = b.chrom AND b.start_pos <= a.start_pos AND a.end_pos <= b.end_pos")
def contained_in(spark, d):
    j = J.overlap_join(plus(spark, d), minus(spark, d), "inner", contained="left")
    return j.select(F.col("interval_id").alias("child"), F.col("interval_id_r").alias("parent"))


@R.add("largest_parent", f"""
WITH {IV} SELECT child AS interval_id, parent FROM (
  SELECT a.interval_id AS child, b.interval_id AS parent, row_number() OVER (PARTITION BY a.interval_id ORDER BY b.end_pos - b.start_pos DESC, b.interval_id) AS k
  FROM pl a JOIN mi b ON a.chrom = b.chrom AND b.start_pos <= a.start_pos AND a.end_pos <= b.end_pos) WHERE k = 1
""")
def largest_parent(spark, d):
    return J.largest_parent(plus(spark, d), minus(spark, d), "interval_id", "interval_id")


@R.add("parent_children", f"""
WITH {IV} SELECT b.interval_id AS parent, list_sort(list(a.interval_id)) AS children
FROM pl a JOIN mi b ON a.chrom = b.chrom AND b.start_pos <= a.start_pos AND a.end_pos <= b.end_pos GROUP BY 1
""")
def parent_children(spark, d):
    j = J.overlap_join(plus(spark, d), minus(spark, d), "inner", contained="left")
    return j.groupBy(F.col("interval_id_r").alias("parent")).agg(F.array_sort(F.collect_list("interval_id")).alias("children"))


NEAR = f"""
WITH {IV}, c AS (
  SELECT a.interval_id, b.interval_id AS near, greatest(0, greatest(a.start_pos, b.start_pos) - least(a.end_pos, b.end_pos)) AS distance,
         ({HIT}) AS o, b.end_pos <= a.start_pos AS before, b.start_pos AS bs, b.end_pos AS be
  FROM pl a JOIN mi b ON a.chrom = b.chrom
), r AS (
  SELECT *, row_number() OVER (PARTITION BY interval_id ORDER BY o DESC, distance, CASE WHEN o THEN 0 WHEN before THEN 1 ELSE 2 END, CASE WHEN o THEN bs END, CASE WHEN o THEN be END, near) AS k FROM c
)"""


@R.add("nearest", f"{NEAR} SELECT interval_id, near AS interval_id_near, distance FROM r WHERE k = 1")
def nearest(spark, d):
    return J.nearest(plus(spark, d), minus(spark, d), "interval_id", "interval_id")


@R.add("nearest_upstream", f"""
WITH {IV}, t AS (SELECT * FROM iv WHERE strand IN ('+', '-')), o AS (SELECT * FROM iv WHERE strand = '*'), c AS (
  SELECT a.interval_id, b.interval_id AS near, CASE WHEN a.strand = '+' THEN a.start_pos - b.end_pos ELSE b.start_pos - a.end_pos END AS distance FROM t a JOIN o b ON a.chrom = b.chrom
) SELECT interval_id, near AS interval_id_near, distance FROM (SELECT *, row_number() OVER (PARTITION BY interval_id ORDER BY distance, near) AS k FROM c WHERE distance >= 0) WHERE k = 1
""")
def nearest_upstream(spark, d):
    i = iv(spark, d)
    return J.nearest(i.filter(F.col("strand").isin("+", "-")), i.filter(F.col("strand") == "*"), "interval_id", "interval_id", side="upstream")


@R.add("nearest_downstream", f"""
WITH {IV}, t AS (SELECT * FROM iv WHERE strand IN ('+', '-')), o AS (SELECT * FROM iv WHERE strand = '*'), c AS (
  SELECT a.interval_id, b.interval_id AS near, CASE WHEN a.strand = '-' THEN a.start_pos - b.end_pos ELSE b.start_pos - a.end_pos END AS distance FROM t a JOIN o b ON a.chrom = b.chrom
) SELECT interval_id, near AS interval_id_near, distance FROM (SELECT *, row_number() OVER (PARTITION BY interval_id ORDER BY distance, near) AS k FROM c WHERE distance >= 0) WHERE k = 1
""")
def nearest_downstream(spark, d):
    i = iv(spark, d)
    return J.nearest(i.filter(F.col("strand").isin("+", "-")), i.filter(F.col("strand") == "*"), "interval_id", "interval_id", side="downstream")


@R.add("distance_histogram", f"{NEAR} SELECT CAST(floor(distance / 500) AS BIGINT) AS bin, count(*) AS n FROM r WHERE k = 1 GROUP BY 1")
def distance_histogram(spark, d):
    n = J.nearest(plus(spark, d), minus(spark, d), "interval_id", "interval_id")
    return n.groupBy(F.floor(F.col("distance") / 500).alias("bin")).agg(F.count("*").alias("n"))


@R.add("reciprocal_overlap", f"WITH {IV}, p AS (SELECT a.interval_id AS a_id, b.interval_id AS b_id, (least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)) AS o, a.end_pos - a.start_pos AS la, b.end_pos - b.start_pos AS lb FROM pl a JOIN mi b ON {HIT}) SELECT a_id, b_id, round(o / la, 6) AS share_a FROM p WHERE o >= 0.5 * la AND o >= 0.5 * lb")
def reciprocal_overlap(spark, d):
    x, y = B.single(F.col("start_pos"), F.col("end_pos")), B.single(F.col("start_pos_r"), F.col("end_pos_r"))
    j = J.overlap_join(plus(spark, d), minus(spark, d), "inner").filter(B.reciprocal_overlap(x, y, 0.5))
    return j.select(F.col("interval_id").alias("a_id"), F.col("interval_id_r").alias("b_id"), F.round(B.percent_overlap(x, y), 6).alias("share_a"))


@R.add("score_over_region", f"WITH {IV} SELECT a.interval_id, sum(b.score) AS score_sum, avg(b.score) AS score_avg, min(b.start_pos) AS peak_start, max(b.end_pos) AS peak_end FROM pl a JOIN mi b ON {HIT} GROUP BY 1")
def score_over_region(spark, d):
    j = J.overlap_join(plus(spark, d), minus(spark, d), "inner")
    return j.groupBy("interval_id").agg(F.sum("score_r").alias("score_sum"), F.avg("score_r").alias("score_avg"), F.min("start_pos_r").alias("peak_start"), F.max("end_pos_r").alias("peak_end"))


@R.add("classify_by_overlap", f"""
WITH {IV} SELECT a.interval_id, list_extract(['equal', 'contained', 'contains', 'overlap', 'antisense', 'intergenic'], min(CASE WHEN b.interval_id IS NULL THEN 6 WHEN a.strand <> b.strand THEN 5
  WHEN a.start_pos = b.start_pos AND a.end_pos = b.end_pos THEN 1 WHEN a.start_pos >= b.start_pos AND a.end_pos <= b.end_pos THEN 2 WHEN a.start_pos <= b.start_pos AND a.end_pos >= b.end_pos THEN 3 ELSE 4 END)) AS class
FROM pl a LEFT JOIN (SELECT * FROM iv WHERE name LIKE 'NX%') b ON {HIT} GROUP BY 1
""")
def classify_by_overlap(spark, d):
    from strandloom.operators.assembly import classify

    ref = iv(spark, d).filter(F.col("name").startswith("NX"))
    return classify(plus(spark, d), ref, "interval_id", "interval_id")


# --- set operations ----------------------------------------------------------------------

ISLANDS = """far AS (SELECT *, max(end_pos) OVER (PARTITION BY {k} ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {t}),
isl AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_pos {op} reach THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS g FROM far),
m AS (SELECT {k}, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n FROM isl GROUP BY {k}, g)"""


@R.add("merge_overlapping", f"WITH {IV}, {ISLANDS.format(k='chrom', t='iv', op='>=')} SELECT chrom, start_pos, end_pos FROM m")
def merge_overlapping(spark, d):
    return S.merged(iv(spark, d))


@R.add("merge_by_strand", f"WITH {IV}, {ISLANDS.format(k='chrom, strand', t='(SELECT * FROM iv WHERE strand IS NOT NULL)', op='>')} SELECT chrom, strand, start_pos, end_pos FROM m")
def merge_by_strand(spark, d):
    return S.merged(iv(spark, d), ["chrom", "strand"], touching=True)


@R.add("base_coverage", f"WITH {IV}, {ISLANDS.format(k='chrom', t='iv', op='>')} SELECT chrom, CAST(sum(end_pos - start_pos) AS BIGINT) AS bases FROM m GROUP BY 1")
def base_coverage(spark, d):
    return S.base_coverage(iv(spark, d))


@R.add("interval_clusters", f"WITH {IV}, {ISLANDS.format(k='chrom', t='iv', op='>=')} SELECT i.interval_id, i.chrom, m.start_pos AS cluster_start, m.end_pos AS cluster_end FROM iv i JOIN m ON i.chrom = m.chrom AND i.start_pos >= m.start_pos AND i.end_pos <= m.end_pos")
def interval_clusters(spark, d):
    return S.clusters(iv(spark, d), "interval_id")


@R.add("complement", f"""
WITH {IV}, e AS (SELECT chrom, start_pos, end_pos FROM iv WHERE chrom IN (SELECT chrom FROM chrom_sizes) UNION ALL SELECT chrom, -1, 0 FROM chrom_sizes UNION ALL SELECT chrom, length, length + 1 FROM chrom_sizes),
{ISLANDS.format(k='chrom', t='e', op='>')}, g AS (SELECT chrom, end_pos AS start_pos, lead(start_pos) OVER (PARTITION BY chrom ORDER BY start_pos) AS end_pos FROM m)
SELECT chrom, start_pos, end_pos FROM g WHERE end_pos IS NOT NULL
""")
def complement(spark, d):
    return S.complement(iv(spark, d), sizes(spark, d))


@R.add("subtract", f"""
WITH {IV}, {ISLANDS.format(k='chrom', t='mi', op='>')}, cut AS (
  SELECT a.interval_id, a.chrom, a.start_pos AS s0, a.end_pos AS e0, list_sort(list({{'s': m.start_pos, 'e': m.end_pos}}) FILTER (m.start_pos IS NOT NULL)) AS c
  FROM pl a LEFT JOIN m ON a.chrom = m.chrom AND a.start_pos < m.end_pos AND m.start_pos < a.end_pos GROUP BY 1, 2, 3, 4
), pieces AS (
  SELECT interval_id, chrom, s0, e0, unnest(range(0, coalesce(len(c), 0) + 1)) AS i, c FROM cut
)
SELECT interval_id, chrom, CAST(greatest(s0, CASE WHEN i = 0 THEN s0 ELSE c[i].e END) AS BIGINT) AS start_pos, CAST(least(e0, CASE WHEN i = coalesce(len(c), 0) THEN e0 ELSE c[i + 1].s END) AS BIGINT) AS end_pos
FROM pieces WHERE greatest(s0, CASE WHEN i = 0 THEN s0 ELSE c[i].e END) < least(e0, CASE WHEN i = coalesce(len(c), 0) THEN e0 ELSE c[i + 1].s END)
""")
def subtract(spark, d):
    return S.subtract(plus(spark, d), minus(spark, d), "interval_id")


@R.add("set_union", f"WITH {IV} SELECT chrom, start_pos, end_pos FROM pl UNION ALL SELECT chrom, start_pos, end_pos FROM mi")
def set_union(spark, d):
    c = ["chrom", "start_pos", "end_pos"]
    return plus(spark, d).select(c).unionByName(minus(spark, d).select(c))


@R.add("set_exact_intersection", f"WITH {IV} SELECT chrom, start_pos, end_pos FROM pl INTERSECT SELECT chrom, start_pos, end_pos FROM mi")
def set_exact_intersection(spark, d):
    c = ["chrom", "start_pos", "end_pos"]
    return plus(spark, d).select(c).intersect(minus(spark, d).select(c))


@R.add("set_exact_difference", f"WITH {IV} SELECT chrom, start_pos, end_pos FROM pl EXCEPT SELECT chrom, start_pos, end_pos FROM mi")
def set_exact_difference(spark, d):
    c = ["chrom", "start_pos", "end_pos"]
    return plus(spark, d).select(c).distinct().join(minus(spark, d).select(c), c, "left_anti")


@R.add("dedup_structures", f"WITH {IV} SELECT chrom, strand, start_pos, end_pos, count(*) AS n, min(interval_id) AS first_id FROM iv GROUP BY ALL")
def dedup_structures(spark, d):
    return iv(spark, d).groupBy("chrom", "strand", "start_pos", "end_pos").agg(F.count("*").alias("n"), F.min("interval_id").alias("first_id"))


@R.add("coverage_segments", f"""
WITH {IV}, ev AS (SELECT chrom, unnest([start_pos, end_pos]) AS pos, unnest([1, -1]) AS delta FROM iv), s AS (SELECT chrom, pos, sum(delta) AS delta FROM ev GROUP BY 1, 2),
r AS (SELECT chrom, pos AS start_pos, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS end_pos, CAST(sum(delta) OVER (PARTITION BY chrom ORDER BY pos) AS BIGINT) AS depth FROM s)
SELECT * FROM r WHERE depth > 0
""")
def coverage_segments(spark, d):
    return P.coverage_segments(iv(spark, d))


@R.add("coverage_runs", f"""
WITH {IV}, ev AS (SELECT chrom, unnest([start_pos, end_pos]) AS pos, unnest([1, -1]) AS delta FROM iv), s AS (SELECT chrom, pos, sum(delta) AS delta FROM ev GROUP BY 1, 2 HAVING sum(delta) <> 0),
r AS (SELECT chrom, pos AS start_pos, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS end_pos, CAST(sum(delta) OVER (PARTITION BY chrom ORDER BY pos) AS BIGINT) AS depth FROM s)
SELECT * FROM r WHERE depth > 0
""")
def coverage_runs(spark, d):
    """Wiggle spans: neighbouring segments of one depth joined."""
    return P.run_length(P.coverage_segments(iv(spark, d)), "depth")


@R.add("gap_peaks", f"""
WITH {IV}, ev AS (SELECT chrom, unnest([start_pos, end_pos]) AS pos, unnest([1, -1]) AS delta FROM iv), s AS (SELECT chrom, pos, sum(delta) AS delta FROM ev GROUP BY 1, 2),
r AS (SELECT chrom, pos AS start_pos, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS end_pos, CAST(sum(delta) OVER (PARTITION BY chrom ORDER BY pos) AS BIGINT) AS depth FROM s),
dd AS (SELECT *, CASE WHEN start_pos - lag(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos) < 200 THEN 0 ELSE 1 END AS new FROM r WHERE depth >= 2),
gg AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start_pos ROWS UNBOUNDED PRECEDING) AS g FROM dd)
SELECT chrom, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS segments, max(depth) AS max_depth FROM gg GROUP BY chrom, g
""")
def gap_peaks(spark, d):
    return P.gap_peaks(P.coverage_segments(iv(spark, d)), 2, 200)


@R.add("islands_gap_200", f"""
WITH {IV}, {ISLANDS.format(k='chrom', t='iv', op='- 200 >=')} SELECT chrom, start_pos, end_pos, n FROM m
""")
def islands_gap_200(spark, d):
    """Session-like merging: a group closes when the next row starts 200 or more after its end."""
    i = iv(spark, d)
    m = S.merged(i.withColumn("end_pos", F.col("end_pos") + 199), touching=True)
    j = J.overlap_join(i, m, "inner", contained="left")
    return j.groupBy("chrom", F.col("start_pos_r").alias("start_pos")).agg(F.max("end_pos").alias("end_pos"), F.count("*").alias("n"))


# --- windows -----------------------------------------------------------------------------


@R.add("tile_windows", "SELECT chrom, unnest(range(0, length - 1000000 + 1, 500000)) AS start_pos, unnest(range(0, length - 1000000 + 1, 500000)) + 1000000 AS end_pos FROM chrom_sizes WHERE length >= 1000000")
def tile_windows(spark, d):
    return W.tile(sizes(spark, d), 1_000_000, 500_000)


WINDOWS = """w AS (SELECT c.chrom, i.start_pos AS s, i.end_pos AS e, i.strand, i.score, i.interval_id, unnest(range(CAST(greatest(floor((i.start_pos - 1000) / 500) + 1, 0) AS BIGINT), CAST(floor((i.end_pos - 1) / 500) AS BIGINT) + 1)) AS k, c.length FROM iv i JOIN chrom_sizes c ON i.chrom = c.chrom),
ww AS (SELECT *, k * 500 AS start_pos, k * 500 + 1000 AS end_pos FROM w WHERE k * 500 + 1000 <= length)"""


@R.add("window_scan", f"""
WITH {IV}, {WINDOWS}
SELECT chrom, start_pos, end_pos, count(*) AS n, sum(score) AS sum_score, CAST(sum(e - s) AS BIGINT) AS sum_length,
  CAST(sum(CASE WHEN (CASE WHEN strand = '-' THEN e ELSE s END) > start_pos AND (CASE WHEN strand = '-' THEN e ELSE s END) < end_pos THEN 1 ELSE 0 END) AS BIGINT) AS starts_in,
  CAST(sum(CASE WHEN (CASE WHEN strand = '-' THEN s ELSE e END) > start_pos AND (CASE WHEN strand = '-' THEN s ELSE e END) < end_pos THEN 1 ELSE 0 END) AS BIGINT) AS ends_in
FROM ww GROUP BY 1, 2, 3
""")
def window_scan(spark, d):
    """Sliding windows of 1,000 bases every 500: count, sums of scores and lengths, oriented starts and ends inside."""
    return W.scan(iv(spark, d), sizes(spark, d), 1000, 500, SC.list_scores())


@R.add("window_bases_covered", f"""
WITH {IV}, {ISLANDS.format(k='chrom', t='iv', op='>')}, w AS (SELECT c.chrom, i.start_pos AS s, i.end_pos AS e, unnest(range(CAST(floor(i.start_pos / 1000) AS BIGINT), CAST(floor((i.end_pos - 1) / 1000) AS BIGINT) + 1)) AS k, c.length FROM m i JOIN chrom_sizes c ON i.chrom = c.chrom)
SELECT chrom, k * 1000 AS start_pos, k * 1000 + 1000 AS end_pos, CAST(sum(least(e, k * 1000 + 1000) - greatest(s, k * 1000)) AS BIGINT) AS bases FROM w WHERE k * 1000 + 1000 <= length GROUP BY 1, 2, 3
""")
def window_bases_covered(spark, d):
    part = F.least("r_end_pos", "end_pos") - F.greatest("r_start_pos", "start_pos")
    return W.scan(S.merged(iv(spark, d), touching=True), sizes(spark, d), 1000, 0, [F.sum(part).alias("bases")])


@R.add("unmasked_windows", f"""
WITH {IV}, {ISLANDS.format(k='chrom', t='mi', op='>')}, t AS (SELECT chrom, unnest(range(0, length - 10000 + 1, 10000)) AS s FROM chrom_sizes WHERE length >= 10000)
SELECT t.chrom, t.s AS start_pos, t.s + 10000 AS end_pos FROM t WHERE (SELECT coalesce(sum(least(m.end_pos, t.s + 10000) - greatest(m.start_pos, t.s)), 0) FROM m WHERE m.chrom = t.chrom AND m.start_pos < t.s + 10000 AND t.s < m.end_pos) <= 100
""")
def unmasked_windows(spark, d):
    return W.unmasked(W.tile(sizes(spark, d), 10_000), minus(spark, d), 0.01)


@R.add("masked_space_windows", f"""
WITH {IV}, e AS (SELECT chrom, start_pos, end_pos FROM iv WHERE chrom IN (SELECT chrom FROM chrom_sizes) UNION ALL SELECT chrom, -1, 0 FROM chrom_sizes UNION ALL SELECT chrom, length, length + 1 FROM chrom_sizes),
{ISLANDS.format(k='chrom', t='e', op='>')}, g AS (SELECT chrom, end_pos AS s, lead(start_pos) OVER (PARTITION BY chrom ORDER BY start_pos) AS e FROM m), f AS (SELECT * FROM g WHERE e > s),
o AS (SELECT *, sum(e - s) OVER (PARTITION BY chrom ORDER BY s) - (e - s) AS off, sum(e - s) OVER (PARTITION BY chrom) AS total FROM f),
w AS (SELECT chrom, unnest(range(0, CAST(total AS BIGINT) - 5000000 + 1, 5000000)) AS win FROM (SELECT DISTINCT chrom, total FROM o)),
b AS (SELECT o.chrom, w.win, s + greatest(win - off, 0) AS s, s + least(win + 5000000 - off, e - s) AS e FROM o JOIN w ON o.chrom = w.chrom AND off < win + 5000000 AND win < off + e - s)
SELECT chrom, win AS window, CAST(min(s) AS BIGINT) AS start_pos, CAST(max(e) AS BIGINT) AS end_pos, CAST(sum(e - s) AS BIGINT) AS bases, CAST(count(*) AS INTEGER) AS n_blocks FROM b GROUP BY 1, 2
""")
def masked_space_windows(spark, d):
    """Windows of 5 million unmasked bases, as block lists."""
    w = W.masked_windows(sizes(spark, d), iv(spark, d), 5_000_000)
    return w.select("chrom", "window", B.first_start(F.col("blocks")).alias("start_pos"), B.last_end(F.col("blocks")).alias("end_pos"), B.length(F.col("blocks")).alias("bases"), F.size("blocks").alias("n_blocks"))


@R.add("clip_to_chrom", f"WITH {IV} SELECT i.interval_id, i.chrom, greatest(0, i.start_pos - 25000) AS start_pos, least(coalesce(c.length, i.end_pos + 25000), i.end_pos + 25000) AS end_pos FROM iv i LEFT JOIN chrom_sizes c ON i.chrom = c.chrom WHERE greatest(0, i.start_pos - 25000) < least(coalesce(c.length, i.end_pos + 25000), i.end_pos + 25000)")
def clip_to_chrom(spark, d):
    wide = iv(spark, d).withColumn("start_pos", F.col("start_pos") - 25_000).withColumn("end_pos", F.col("end_pos") + 25_000)
    return W.clip_to_chrom(wide, sizes(spark, d)).select("interval_id", "chrom", "start_pos", "end_pos")


@R.add("local_environment", f"""
WITH {IV}, ev AS (SELECT chrom, unnest([start_pos, end_pos]) AS pos, unnest([1, -1]) AS delta FROM iv), s AS (SELECT chrom, pos, sum(delta) AS delta FROM ev GROUP BY 1, 2),
r AS (SELECT chrom, pos AS start_pos, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS end_pos, CAST(sum(delta) OVER (PARTITION BY chrom ORDER BY pos) AS BIGINT) AS depth FROM s), seg AS (SELECT * FROM r WHERE depth > 0)
SELECT a.chrom, a.start_pos, a.end_pos, a.depth, CAST(sum(b.depth * (least(a.start_pos + 5000, b.end_pos) - greatest(greatest(a.start_pos - 5000, 0), b.start_pos))) AS BIGINT) AS env
FROM seg a JOIN seg b ON a.chrom = b.chrom AND greatest(a.start_pos - 5000, 0) < b.end_pos AND b.start_pos < a.start_pos + 5000 GROUP BY 1, 2, 3, 4
""")
def local_environment(spark, d):
    return W.rolling_environment(P.coverage_segments(iv(spark, d)), "depth")


@R.add("relocated_intervals")
def relocated_intervals(spark, d):
    """Every interval moved to a seeded random place on its chromosome that touches no minus-strand interval."""
    return W.relocate(iv(spark, d), sizes(spark, d), "interval_id", seed=11, masks=minus(spark, d)).select("interval_id", "chrom", "start_pos", "end_pos", "permutation")


@R.add("overlap_significance")
def overlap_significance(spark, d):
    return P.overlap_significance(plus(spark, d), minus(spark, d), sizes(spark, d), "interval_id", 20, 5)


@R.add("chance_overlap", f"WITH {IV}, s AS (SELECT chrom, sum(end_pos - start_pos) AS b, count(*) AS n, avg(end_pos - start_pos) AS l FROM mi GROUP BY 1) SELECT a.interval_id, round(1 - pow(1 - least(1, (a.end_pos - a.start_pos + s.l) / c.length), s.n), 9) AS p FROM pl a JOIN s ON a.chrom = s.chrom JOIN chrom_sizes c ON c.chrom = a.chrom")
def chance_overlap(spark, d):
    """Probability that an interval touches any of n features of mean length l placed at random."""
    s = minus(spark, d).groupBy("chrom").agg(F.count("*").alias("n"), F.avg(F.col("end_pos") - F.col("start_pos")).alias("l"))
    j = plus(spark, d).join(s, "chrom").join(sizes(spark, d), "chrom")
    share = F.least(F.lit(1.0), (F.col("end_pos") - F.col("start_pos") + F.col("l")) / F.col("length"))
    return j.select("interval_id", F.round(1 - F.pow(1 - share, "n"), 9).alias("p"))


# --- per-row functions -------------------------------------------------------------------


@R.add("interval_scalars", f"""
WITH {IV} SELECT interval_id, end_pos - start_pos AS span, CAST(floor((end_pos - start_pos) / 2) AS BIGINT) AS mid_offset, start_pos + CAST(floor((end_pos - start_pos) / 2) AS BIGINT) AS mid,
 CASE WHEN strand = '-' THEN end_pos ELSE start_pos END AS o_start, CASE WHEN strand = '-' THEN start_pos ELSE end_pos END AS o_end,
 chrom || ':' || start_pos || '-' || end_pos AS region, CASE WHEN strand IN ('+', '-') THEN strand ELSE '*' END AS strand3,
 greatest(0, CASE WHEN strand = '-' THEN end_pos - 50 ELSE start_pos - 200 END) AS prom_start, CASE WHEN strand = '-' THEN end_pos + 200 ELSE start_pos + 50 END AS prom_end FROM iv
""")
def interval_scalars(spark, d):
    s, e, st = F.col("start_pos"), F.col("end_pos"), F.col("strand")
    p = B.promoter(s, e, st, 200, 50)
    return iv(spark, d).select(
        "interval_id", (e - s).alias("span"), B.offset_midpoint(s, e).alias("mid_offset"), B.midpoint(B.single(s, e)).alias("mid"), B.oriented_start(s, e, st).alias("o_start"), B.oriented_end(s, e, st).alias("o_end"),
        B.region_string(F.col("chrom"), s, e).alias("region"), B.strand_of(st).alias("strand3"), p["start"].alias("prom_start"), p["end"].alias("prom_end"),
    )


@R.add("trimmed_intervals", f"WITH {IV} SELECT interval_id, CASE WHEN strand = '-' THEN start_pos + 3 ELSE start_pos + 5 END AS start_pos, CASE WHEN strand = '-' THEN end_pos - 5 ELSE end_pos - 3 END AS end_pos FROM iv WHERE end_pos - start_pos > 8")
def trimmed_intervals(spark, d):
    t = iv(spark, d).withColumn("b", B.trim(B.single(F.col("start_pos"), F.col("end_pos")), F.coalesce("strand", F.lit("*")), 5, 3)).filter(F.size("b") > 0)
    return t.select("interval_id", B.first_start(F.col("b")).alias("start_pos"), B.last_end(F.col("b")).alias("end_pos"))


@R.add("sorted_intervals", f"WITH {IV} SELECT interval_id, row_number() OVER (PARTITION BY chrom ORDER BY start_pos, end_pos, coalesce(strand, ''), coalesce(name, ''), interval_id) AS place FROM iv")
def sorted_intervals(spark, d):
    """Place of every interval in annotation order on its chromosome."""
    i = iv(spark, d).withColumn("s", F.coalesce("strand", F.lit(""))).withColumn("n", F.coalesce("name", F.lit("")))
    return Ordered(i, ["chrom"], ["start_pos", "end_pos", "s", "n", "interval_id"]).row_number("place").select("interval_id", "place")


@R.add("neighbour_orientation", f"""
WITH {IV}, n AS (SELECT interval_id, strand, end_pos, lead(strand) OVER w AS s2, lead(start_pos) OVER w AS st2, chrom FROM iv WINDOW w AS (PARTITION BY chrom ORDER BY start_pos, end_pos, interval_id))
SELECT interval_id, greatest(0, st2 - end_pos) AS distance, CASE WHEN strand = '+' AND s2 = '-' THEN 'convergent' WHEN strand = '-' AND s2 = '+' THEN 'divergent' WHEN strand = s2 AND strand IN ('+', '-') THEN 'tandem' ELSE 'unknown' END AS class FROM n WHERE st2 IS NOT NULL
""")
def neighbour_orientation(spark, d):
    o = Ordered(iv(spark, d), ["chrom"], ["start_pos", "end_pos", "interval_id"]).neighbour(["strand", "start_pos"])
    n = o.withColumnsRenamed({"strand_next": "s2", "start_pos_next": "st2"}).filter(F.col("st2").isNotNull())
    cls = F.when((F.col("strand") == "+") & (F.col("s2") == "-"), "convergent").when((F.col("strand") == "-") & (F.col("s2") == "+"), "divergent").when((F.col("strand") == F.col("s2")) & F.col("strand").isin("+", "-"), "tandem").otherwise("unknown")
    return n.select("interval_id", F.greatest(F.lit(0).cast("long"), F.col("st2") - F.col("end_pos")).alias("distance"), cls.alias("class"))


@R.add("best_per_cluster", f"WITH {IV}, {ISLANDS.format(k='chrom', t='iv', op='>=')}, j AS (SELECT i.*, m.start_pos AS cs FROM iv i JOIN m ON i.chrom = m.chrom AND i.start_pos >= m.start_pos AND i.end_pos <= m.end_pos WHERE score IS NOT NULL) SELECT chrom, cs AS cluster_start, interval_id FROM (SELECT *, row_number() OVER (PARTITION BY chrom, cs ORDER BY score DESC, interval_id) AS k FROM j) WHERE k = 1")
def best_per_cluster(spark, d):
    """Highest-scoring interval of every locus."""
    c = S.clusters(iv(spark, d), "interval_id").join(iv(spark, d).filter(F.col("score").isNotNull()).select("interval_id", "score"), "interval_id")
    return c.groupBy("chrom", "cluster_start").agg(F.min_by("interval_id", F.struct((-F.col("score")).alias("s"), "interval_id")).alias("interval_id"))


@R.add("score_percentile_top", f"WITH {IV}, q AS (SELECT quantile_cont(score, 0.95) AS q FROM iv WHERE score IS NOT NULL) SELECT interval_id FROM iv, q WHERE score >= q.q")
def score_percentile_top(spark, d):
    i = iv(spark, d)
    q = i.agg(F.percentile("score", F.lit(0.95)).alias("q"))
    return i.join(F.broadcast(q)).filter(F.col("score") >= F.col("q")).select("interval_id")


@R.add("score_histogram", f"WITH {IV} SELECT CAST(greatest(0, least(19, floor(score / 50))) AS INTEGER) AS bin, count(*) AS n, CAST(greatest(0, least(19, floor(score / 50))) AS INTEGER) * 50.0 AS start FROM iv WHERE score IS NOT NULL GROUP BY 1, 3")
def score_histogram(spark, d):
    return T.histogram(iv(spark, d), [], "score", 0.0, 1000.0, 20)


@R.add("histogram_quantiles", f"""
WITH {IV}, h AS (SELECT chrom, CAST(greatest(0, least(99, floor(score / 10))) AS INTEGER) AS bin, count(*) AS n FROM iv WHERE score IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY bin) / sum(n) OVER (PARTITION BY chrom) AS c FROM h) SELECT chrom, min(bin) * 10.0 + 5.0 AS quantile FROM c WHERE c > 0.5 GROUP BY 1
""")
def histogram_quantiles(spark, d):
    h = T.histogram(iv(spark, d), ["chrom"], "score", 0.0, 1000.0, 100)
    return T.bin_quantile(h, ["chrom"], 0.5, 10.0)


@R.add("compare_score_histograms", f"""
WITH {IV}, h AS (SELECT strand, CAST(greatest(0, least(19, floor(score / 50))) AS INTEGER) AS bin FROM iv WHERE score IS NOT NULL AND strand IN ('+', '-')), b AS (SELECT bin, count(*) FILTER (strand = '+') + 1.0 AS x, count(*) FILTER (strand = '-') + 1.0 AS y FROM h GROUP BY 1),
p AS (SELECT x / sum(x) OVER () AS p, y / sum(y) OVER () AS q FROM b) SELECT round(sum(p * ln(p / q)), 9) AS kl, round(sum((p - q) * (p - q) / (p + q)), 9) AS chi2 FROM p
""")
def compare_score_histograms(spark, d):
    """Kullback-Leibler and chi-square distance of the strands' score distributions, pseudo-counts added."""
    return T.compare_histograms(T.histogram(plus(spark, d), [], "score", 0.0, 1000.0, 20), T.histogram(minus(spark, d), [], "score", 0.0, 1000.0, 20), 1.0).select(F.round("kl", 9).alias("kl"), F.round("chi2", 9).alias("chi2"))
