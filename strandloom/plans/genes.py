"""Queries on transcript structures and composite pipelines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import blocks as B
from strandloom.functions import hierarchy as HC
from strandloom.operators import genes as G
from strandloom.operators import matrix as M
from strandloom.operators import pipelines as PL
from strandloom.operators import setops
from strandloom.operators.join import overlap_join
from strandloom.plans.intervals import IV, iv, minus, sizes
from strandloom.plans.matrices import MX, gene_sets, mx, r6, samples
from strandloom.plans.reads import RD, block_string, mapped
from strandloom.plans.tables import Registry, table
from strandloom.plans.texts import TX, transcripts_of_reads

R = Registry()


def spliced(spark: SparkSession, d: str) -> DataFrame:
    return transcripts_of_reads(spark, d).filter(F.size("blocks") > 1)


SP = f"{TX}, sp AS (SELECT * FROM t WHERE len(blocks) > 1)"


@R.add("gene_exons", f"{SP}, x AS (SELECT chrom, strand, unnest(blocks) AS b FROM sp) SELECT DISTINCT chrom, strand, b.start_pos, b.end_pos FROM x")
def gene_exons(spark, d):
    return G.exons(spliced(spark, d), distinct=True)


@R.add("gene_introns", f"{SP} SELECT name, chrom, strand, x.s AS start_pos, x.e AS end_pos FROM (SELECT name, chrom, strand, unnest([{{'s': blocks[i].end_pos, 'e': blocks[i + 1].start_pos}} for i in range(1, len(blocks))]) AS x FROM sp)")
def gene_introns(spark, d):
    return G.introns(spliced(spark, d))


@R.add("gene_lengths", f"{TX} SELECT name, CAST(list_sum([b.end_pos - b.start_pos for b in blocks]) AS BIGINT) AS length, end_pos - start_pos AS span, len(blocks) AS exons FROM t")
def gene_lengths(spark, d):
    return G.lengths(transcripts_of_reads(spark, d)).withColumn("exons", F.col("exons").cast("long"))


@R.add("collapsed_gene_lengths", f"""
WITH {IV}, x AS (SELECT name AS gene, chrom, start_pos, end_pos FROM iv WHERE name IS NOT NULL), far AS (SELECT *, max(end_pos) OVER (PARTITION BY gene, chrom ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
c AS (SELECT gene, greatest(0, end_pos - greatest(start_pos, coalesce(reach, start_pos))) AS n FROM far) SELECT gene, CAST(sum(n) AS BIGINT) AS length FROM c GROUP BY 1
""")
def collapsed_gene_lengths(spark, d):
    t = iv(spark, d).filter(F.col("name").isNotNull()).select(F.col("name").alias("g"), "chrom", B.single(F.col("start_pos"), F.col("end_pos")).alias("blocks"))
    return G.collapsed_lengths(t, "g")


@R.add("unique_structures", f"{TX}, s AS (SELECT chrom, strand, array_to_string([b.start_pos || '-' || b.end_pos for b in blocks], ',') AS b, name FROM t) SELECT chrom, strand, b AS blocks, min(name) AS name, count(*) AS copies FROM s GROUP BY 1, 2, 3")
def unique_structures(spark, d):
    return G.unique_structures(transcripts_of_reads(spark, d)).withColumn("blocks", block_string(F.col("blocks")))


EXO = f"{TX}, e AS (SELECT name, chrom, strand, length(name) AS k, unnest(blocks) AS b, list_sum([b.end_pos - b.start_pos for b in blocks]) AS len, len(blocks) AS nb FROM t)"


@R.add("exon_overlap", f"{EXO} SELECT DISTINCT x.name FROM e x WHERE x.nb > 1 AND EXISTS (SELECT 1 FROM e y WHERE y.nb = 1 AND x.chrom = y.chrom AND x.strand = y.strand AND x.b.start_pos < y.b.end_pos AND y.b.start_pos < x.b.end_pos)")
def exon_overlap(spark, d):
    """Spliced reads that share exon bases with an unspliced one on their strand."""
    t = transcripts_of_reads(spark, d)
    return G.exon_overlap(t.filter(F.size("blocks") > 1), t.filter(F.size("blocks") == 1)).select("name")


@R.add("exon_difference", f"{EXO} SELECT name FROM t WHERE len(blocks) > 1 EXCEPT SELECT x.name FROM e x WHERE x.nb > 1 AND EXISTS (SELECT 1 FROM e y WHERE y.nb = 1 AND x.chrom = y.chrom AND x.strand = y.strand AND x.b.start_pos < y.b.end_pos AND y.b.start_pos < x.b.end_pos)")
def exon_difference(spark, d):
    t = transcripts_of_reads(spark, d)
    return G.exon_overlap(t.filter(F.size("blocks") > 1), t.filter(F.size("blocks") == 1), difference=True).select("name")


@R.add("percent_overlap", f"{EXO}, p AS (SELECT x.name AS a, y.name AS b, sum(least(x.b.end_pos, y.b.end_pos) - greatest(x.b.start_pos, y.b.start_pos)) / max(x.len) AS share FROM e x JOIN e y ON x.chrom = y.chrom AND x.strand = y.strand AND x.b.start_pos < y.b.end_pos AND y.b.start_pos < x.b.end_pos WHERE x.nb > 1 AND y.nb = 1 GROUP BY 1, 2) SELECT a AS a_name, round(max(share), 6) AS share FROM p GROUP BY 1")
def percent_overlap(spark, d):
    t = transcripts_of_reads(spark, d)
    return r6(G.percent_overlap(t.filter(F.size("blocks") > 1), t.filter(F.size("blocks") == 1)).select("a_name", "share"), "share")


@R.add("gene_loci", f"""
WITH {IV}, x AS (SELECT interval_id, chrom, strand, start_pos, end_pos FROM iv WHERE strand IS NOT NULL), far AS (SELECT *, max(end_pos) OVER w AS reach FROM x WINDOW w AS (PARTITION BY chrom, strand ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_pos >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, strand ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS k FROM far)
SELECT CAST(interval_id AS VARCHAR) AS name, min(CAST(interval_id AS VARCHAR)) OVER (PARTITION BY chrom, strand, k) AS locus FROM g
""")
def gene_loci(spark, d):
    """Intervals joined by chains of same-strand overlap (connected components)."""
    t = iv(spark, d).filter(F.col("strand").isNotNull()).select(F.col("interval_id").cast("string").alias("name"), "chrom", "strand", "start_pos", "end_pos", B.single(F.col("start_pos"), F.col("end_pos")).alias("blocks"))
    return G.loci(t)


@R.add("last_30_bases", f"{TX} SELECT name, CASE WHEN strand = '-' THEN start_pos ELSE end_pos - 30 END AS start_pos, CASE WHEN strand = '-' THEN start_pos + 30 ELSE end_pos END AS end_pos FROM t WHERE len(blocks) = 1 AND end_pos - start_pos >= 30")
def last_30_bases(spark, d):
    t = transcripts_of_reads(spark, d).filter((F.size("blocks") == 1) & (F.col("end_pos") - F.col("start_pos") >= 30))
    return G.last_bases(t, 30).select("name", "start_pos", "end_pos")


@R.add("low_repeat_intervals", f"""
WITH {IV}, x AS (SELECT chrom, start_pos, end_pos FROM mi), far AS (SELECT *, max(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
isl AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_pos > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS g FROM far), m AS (SELECT chrom, min(start_pos) AS s, max(end_pos) AS e FROM isl GROUP BY chrom, g)
SELECT a.interval_id FROM pl a WHERE (SELECT coalesce(sum(least(a.end_pos, m.e) - greatest(a.start_pos, m.s)), 0) FROM m WHERE m.chrom = a.chrom AND m.s < a.end_pos AND a.start_pos < m.e) <= 0.5 * (a.end_pos - a.start_pos)
""")
def low_repeat_intervals(spark, d):
    """Plus-strand intervals of which at most half lies in minus-strand ones."""
    t = iv(spark, d).filter(F.col("strand") == "+").select("interval_id", F.col("interval_id").cast("string").alias("name"), "chrom", "strand", B.single(F.col("start_pos"), F.col("end_pos")).alias("blocks"))
    return G.low_repeat(t, minus(spark, d), 0.5).select("interval_id")


@R.add("transcript_windows", f"""
{TX}, x AS (SELECT rec_id, name, strand, unnest(blocks) AS b FROM t), o AS (SELECT *, sum(b.end_pos - b.start_pos) OVER (PARTITION BY rec_id ORDER BY b.start_pos) - (b.end_pos - b.start_pos) AS off, sum(b.end_pos - b.start_pos) OVER (PARTITION BY rec_id) AS n FROM x),
w AS (SELECT rec_id, n, strand, unnest(range(0, CAST(n - 20 AS BIGINT) + 1, 8)) AS s FROM (SELECT DISTINCT rec_id, n, strand FROM o) WHERE n >= 20), l AS (SELECT rec_id, s, CASE WHEN strand = '-' THEN n - s - 20 ELSE s END AS lo FROM w)
SELECT name, CAST(s // 8 AS INTEGER) AS window, CAST(min(b.start_pos + greatest(lo - off, 0)) AS BIGINT) AS start_pos, CAST(max(b.start_pos + least(lo + 20 - off, b.end_pos - b.start_pos)) AS BIGINT) AS end_pos
FROM l JOIN o ON l.rec_id = o.rec_id AND off < lo + 20 AND lo < off + b.end_pos - b.start_pos GROUP BY name, l.rec_id, s
""")
def transcript_windows(spark, d):
    w = G.transcript_windows(transcripts_of_reads(spark, d), 20, 8)
    return w.select("name", "window", B.first_start(F.col("blocks")).alias("start_pos"), B.last_end(F.col("blocks")).alias("end_pos"))


@R.add("aggregate_profile", f"""
WITH {IV}, r AS (SELECT interval_id, chrom, strand, start_pos - 500 AS s, end_pos + 500 AS e, (end_pos - start_pos + 1000) / 20.0 AS w FROM iv), ev AS (SELECT chrom, unnest([start_pos, end_pos]) AS pos, unnest([1, -1]) AS delta FROM iv), sm AS (SELECT chrom, pos, sum(delta) AS delta FROM ev GROUP BY 1, 2),
seg AS (SELECT chrom, pos AS s, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS e, sum(delta) OVER (PARTITION BY chrom ORDER BY pos) AS depth FROM sm),
b AS (SELECT r.*, unnest(range(20)) AS bin FROM r), x AS (SELECT CASE WHEN strand = '-' THEN 19 - bin ELSE bin END AS bin, greatest(least(seg.e, b.s + (bin + 1) * w) - greatest(seg.s, b.s + bin * w), 0) * depth / w AS part FROM b JOIN seg ON b.chrom = seg.chrom AND depth > 0 AND seg.s < b.s + (bin + 1) * w AND b.s + bin * w < seg.e)
SELECT CAST(bin AS INTEGER) AS bin, round(sum(part) / (SELECT count(*) FROM r), 6) AS mean, (SELECT count(*) FROM r) AS regions FROM x GROUP BY bin
""")
def aggregate_profile(spark, d):
    from strandloom.operators.peaks import coverage_segments

    wide = iv(spark, d).select("interval_id", "chrom", "strand", (F.col("start_pos") - 500).alias("start_pos"), (F.col("end_pos") + 500).alias("end_pos"))
    return G.aggregate_profile(wide, coverage_segments(iv(spark, d)), "interval_id", "depth", 20).withColumn("mean", F.round("mean", 6))


@R.add("end_pile", f"WITH {RD} SELECT chrom, strand, CASE WHEN strand = '-' THEN start_pos ELSE end_pos - 1 END AS pos, count(*) AS n FROM rd WHERE chrom IS NOT NULL AND start_pos IS NOT NULL GROUP BY ALL")
def end_pile(spark, d):
    return G.end_pile(mapped(spark, d)).select("chrom", "strand", "pos", "n")


@R.add("ends_to_genes", f"""
WITH {RD}, {IV.strip()}, e AS (SELECT DISTINCT chrom, strand, CASE WHEN strand = '-' THEN start_pos ELSE end_pos - 1 END AS pos FROM mp WHERE strand IS NOT NULL),
t AS (SELECT interval_id, chrom, strand, CASE WHEN strand = '-' THEN start_pos ELSE end_pos - 1 END AS tip FROM iv WHERE strand IS NOT NULL),
j AS (SELECT e.chrom || ':' || pos || e.strand AS end_id, CAST(interval_id AS VARCHAR) AS name, abs(pos - tip) AS distance FROM e JOIN t ON e.chrom = t.chrom AND e.strand = t.strand AND abs(pos - tip) <= 2000)
SELECT end_id, name, distance FROM (SELECT *, row_number() OVER (PARTITION BY end_id ORDER BY distance, name) AS k FROM j) WHERE k = 1
""")
def ends_to_genes(spark, d):
    """Every place where reads end, to the nearest 3' end of an interval on its strand."""
    i = iv(spark, d).filter(F.col("strand").isNotNull())
    ends = G.end_pile(mapped(spark, d).filter(F.col("strand").isNotNull())).select(F.concat("chrom", F.lit(":"), F.col("pos").cast("string"), "strand").alias("end_id"), "chrom", "pos", "strand")
    t = i.select(F.col("interval_id").cast("string").alias("name"), "chrom", "strand", "start_pos", "end_pos")
    return G.end_assignment(ends, t, 2000)


@R.add("clipped_to_regions", f"WITH {IV} SELECT a.interval_id AS a_id, b.interval_id AS b_id, greatest(a.start_pos, b.start_pos) || '-' || least(a.end_pos, b.end_pos) AS blocks FROM pl a JOIN mi b ON a.chrom = b.chrom AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos")
def clipped_to_regions(spark, d):
    t = iv(spark, d).filter(F.col("strand") == "+").withColumn("blocks", B.single(F.col("start_pos"), F.col("end_pos")))
    c = G.clip_to_regions(t, minus(spark, d))
    return c.select(F.col("interval_id").alias("a_id"), F.col("interval_id_r").alias("b_id"), block_string(F.col("blocks")).alias("blocks"))


@R.add("random_placement")
def random_placement(spark, d):
    t = spliced(spark, d)
    free = setops.complement(iv(spark, d), sizes(spark, d))
    return G.random_placement(t, free, 9).withColumn("blocks", block_string(F.col("blocks")))


@R.add("simulated_reads")
def simulated_reads(spark, d):
    return G.simulated_reads(spliced(spark, d), 10, 2, 4).withColumn("blocks", block_string(F.col("blocks")))


# --- composite ---------------------------------------------------------------------------


def with_library(spark: SparkSession, d: str) -> DataFrame:
    return mapped(spark, d).withColumn("lib", F.translate(F.try_element_at("tags", F.lit("RG")), "-", "_"))


LIB = f"{RD}, lb AS (SELECT *, translate(tags['RG'], '-', '_') AS lib FROM mp WHERE tags['RG'] IS NOT NULL)"


@R.add("sample_windows", f"WITH {LIB}, w AS (SELECT lib, l.chrom, weight, unnest(range(CAST(greatest(floor((start_pos - 5000000) / 5000000) + 1, 0) AS BIGINT), CAST(floor((end_pos - 1) / 5000000) AS BIGINT) + 1)) AS k, length FROM lb l JOIN chrom_sizes c ON l.chrom = c.chrom) SELECT lib AS sample, chrom, k * 5000000 AS start_pos, k * 5000000 + 5000000 AS end_pos, round(sum(weight), 6) AS count FROM w WHERE k * 5000000 + 5000000 <= length GROUP BY ALL")
def sample_windows(spark, d):
    return r6(PL.sample_windows(with_library(spark, d), sizes(spark, d), 5_000_000, 0, "lib"), "count")


@R.add("group_windows")
def group_windows(spark, d):
    c = PL.sample_windows(with_library(spark, d).withColumn("lib", F.concat_ws("_", "lib", F.pmod("rec_id", F.lit(2)))), sizes(spark, d), 5_000_000, 0, "lib")
    g = c.select("sample").distinct().withColumn("group", F.when(F.col("sample").startswith("lib_a"), "a").otherwise("b"))
    return PL.group_windows(c, g, "a", "b")


@R.add("multi_sample_peaks")
def multi_sample_peaks(spark, d):
    return PL.multi_sample_peaks(with_library(spark, d), sizes(spark, d), 1_000_000, 500_000, "lib", 0.01, 2)


@R.add("scan_null")
def scan_null(spark, d):
    return PL.scan_null(mapped(spark, d), sizes(spark, d), 1_000_000, 10, 3)


@R.add("count_matrix", f"WITH {LIB}, {IV}, t AS (SELECT lib, sum(weight) AS t FROM lb GROUP BY 1) SELECT a.interval_id AS row, b.lib AS col, round(sum(b.weight) * 1e6 / t.t, 4) AS value FROM iv a JOIN lb b ON a.chrom = b.chrom AND a.start_pos - 50000 < b.end_pos AND b.start_pos < a.end_pos + 50000 JOIN t ON t.lib = b.lib GROUP BY 1, 2, t.t")
def count_matrix(spark, d):
    """Regions by samples, per million reads of the sample."""
    wide = iv(spark, d).select("interval_id", "chrom", (F.col("start_pos") - 50_000).alias("start_pos"), (F.col("end_pos") + 50_000).alias("end_pos"))
    r = with_library(spark, d).filter(F.col("lib").isNotNull()).select("chrom", "start_pos", "end_pos", "weight", "lib")
    return PL.count_matrix(wide, r, "interval_id", "lib").withColumn("value", F.round("value", 4))


@R.add("normalised_counts", f"""
WITH {RD}, {IV}, s AS (SELECT a.interval_id, a.end_pos - a.start_pos + 40000 AS l, sum(b.weight) AS c FROM iv a JOIN mp b ON a.chrom = b.chrom AND a.start_pos - 20000 < b.end_pos AND b.start_pos < a.end_pos + 20000 GROUP BY 1, 2),
p AS (SELECT a.interval_id, a.end_pos - a.start_pos + 400000 AS l, sum(b.weight) AS c FROM iv a JOIN mp b ON a.chrom = b.chrom AND a.start_pos - 200000 < b.end_pos AND b.start_pos < a.end_pos + 200000 GROUP BY 1, 2)
SELECT s.interval_id, round(s.c, 6) AS count, round(s.c / (s.l / 200.0), 6) AS per_fragment, round((s.c / s.l) / (p.c / p.l), 6) AS over_parent FROM s JOIN p ON s.interval_id = p.interval_id
""")
def normalised_counts(spark, d):
    wide = lambda k: iv(spark, d).select("interval_id", "chrom", (F.col("start_pos") - k).alias("start_pos"), (F.col("end_pos") + k).alias("end_pos"))
    r = mapped(spark, d).select("chrom", "start_pos", "end_pos", "weight")
    return r6(PL.normalised_counts(wide(20_000), r, "interval_id", wide(200_000), 200.0), "count", "per_fragment", "over_parent")


@R.add("batch_fold", f"WITH {MX}, b AS (SELECT *, CAST(right(col, 2) AS INTEGER) % 4 AS batch FROM m) SELECT row, col, round(value - median(value) OVER (PARTITION BY row, batch), 6) AS value FROM b")
def batch_fold(spark, d):
    b = mx(spark, d).select("col").distinct().withColumn("batch", F.substring("col", -2, 2).cast("int") % 4)
    return r6(PL.batch_fold(mx(spark, d), b), "value")


@R.add("time_series", f"WITH {MX}, t AS (SELECT row, CAST(floor((CAST(right(col, 2) AS INTEGER) - 1) / 8) AS INTEGER) AS time, avg(value) AS v FROM m GROUP BY 1, 2) SELECT row, from_time, to_time, round(fold, 6) AS fold FROM (SELECT row, lag(time) OVER w AS from_time, time AS to_time, v - lag(v) OVER w AS fold FROM t WINDOW w AS (PARTITION BY row ORDER BY time)) WHERE from_time IS NOT NULL")
def time_series(spark, d):
    t = mx(spark, d).select("col").distinct().withColumn("time", F.floor((F.substring("col", -2, 2).cast("int") - 1) / 8).cast("int"))
    return r6(PL.time_series(mx(spark, d), t), "fold")


def row_sets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "expression").filter(F.col("description").isNotNull())
    return t.select(F.col("description").alias("set"), F.col("row_name").alias("gene")).distinct()


@R.add("gsea")
def gsea(spark, d):
    return PL.gsea(M.log_transform(mx(spark, d)), samples(spark, d), row_sets(spark, d), "a", "b", 20, 6)


@R.add("pattern_enrichment")
def pattern_enrichment(spark, d):
    p = mx(spark, d).select("col").distinct().withColumn("x", F.substring("col", -2, 2).cast("double"))
    return PL.pattern_enrichment(mx(spark, d), p, row_sets(spark, d))


@R.add("sample_tree")
def sample_tree(spark, d):
    """Hierarchical clustering of the samples by 1 - correlation, cut into four."""
    c = M.correlation(M.log_transform(mx(spark, d))).collect()  # pairs of samples: the short dimension
    names = sorted({r["a"] for r in c} | {r["b"] for r in c})
    at = {n: i for i, n in enumerate(names)}
    dist = np.zeros((len(names), len(names)))
    for r in c:
        dist[at[r["a"]], at[r["b"]]] = dist[at[r["b"]], at[r["a"]]] = 1 - (r["r"] or 0.0)
    lab = HC.cut(HC.linkage(dist, "complete"), len(names), 4)
    return spark.createDataFrame([(n, int(x)) for n, x in zip(names, lab)], "sample string, cluster int")


@R.add("location_anti_rows", f"WITH {IV} SELECT m.interval_id, m.score FROM pl m WHERE score IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mi b WHERE m.chrom = b.chrom AND m.start_pos < b.end_pos AND b.start_pos < m.end_pos)")
def location_anti_rows(spark, d):
    """Rows of a matrix with places that overlap no row of another."""
    a = iv(spark, d).filter((F.col("strand") == "+") & F.col("score").isNotNull())
    return overlap_join(a, minus(spark, d), "left_anti").select("interval_id", "score")


@R.add("mapq_pairs", f"WITH {RD}, f AS (SELECT regexp_replace(name, '/[12]$', '') AS frag, min(mapq) AS q FROM rd WHERE name IS NOT NULL GROUP BY 1) SELECT rec_id FROM rd JOIN f ON regexp_replace(rd.name, '/[12]$', '') = f.frag WHERE f.q >= 10")
def mapq_pairs(spark, d):
    """Reads all of whose fragment's records have a mapping quality of 10 or more.

    Fragment names are very uneven, so the join splits the heavy ones.
    """
    from strandloom.operators.balance import balanced_join

    r = table(spark, d, "reads").select("rec_id", "mapq", F.regexp_replace("name", "/[12]$", "").alias("frag")).filter(F.col("frag").isNotNull())
    low = r.groupBy("frag").agg(F.min("mapq").alias("q")).filter(F.col("q") >= 10).select("frag")
    return balanced_join(r, low, ["frag"], "left_semi").select("rec_id")


@R.add("intron_samples")
def intron_samples(spark, d):
    """A stretch of every intron as long as the exon before it."""
    return G.sample_introns(transcripts_of_reads(spark, d), 3)


@R.add("annotation_enrichment")
def annotation_enrichment(spark, d):
    """Minus-strand intervals, as peaks, on the plus-strand ones by score band, inside stretches that reads reach."""
    from strandloom.operators import peaks as P

    bands = iv(spark, d).filter((F.col("strand") == "+") & F.col("score").isNotNull()).withColumn("band", F.concat(F.lit("b"), F.floor(F.col("score") / 250).cast("string")))
    near = iv(spark, d).select("chrom", F.greatest(F.col("start_pos") - 50_000, F.lit(0)).alias("start_pos"), (F.col("end_pos") + 50_000).alias("end_pos"))
    return P.annotation_enrichment(bands, "band", minus(spark, d), near, sizes(spark, d), "interval_id", 20, 5)
