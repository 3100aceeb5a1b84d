"""Queries on reads: filters, counts, pairs, barcodes, junctions, scores, peaks, sequences of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import blocks as B
from strandloom.functions import filters as FL
from strandloom.functions import sequence as Q
from strandloom.operators import assembly as A
from strandloom.operators import join as J
from strandloom.operators import peaks as P
from strandloom.operators import scores as SC
from strandloom.operators import umi as U
from strandloom.operators import windows as W
from strandloom.plans.intervals import IV, iv, sizes
from strandloom.plans.problems import _spelled
from strandloom.plans.tables import Registry, chrom_key, table
from strandloom.session import table_broadcast

R = Registry()

RD = """
rd AS (
  SELECT r.* EXCLUDE (chrom, mate_chrom), coalesce(c.chrom, lower(trim(r.chrom))) AS chrom, coalesce(c2.chrom, lower(trim(r.mate_chrom))) AS mate_chrom
  FROM reads r LEFT JOIN chrom_sizes c ON lower(trim(r.chrom)) = lower(c.chrom) LEFT JOIN chrom_sizes c2 ON lower(trim(r.mate_chrom)) = lower(c2.chrom)
), mp AS (SELECT * FROM rd WHERE chrom IS NOT NULL AND end_pos > start_pos)"""


READ_COLUMNS = "rec_id name flag chrom pos mapq cigar mate_chrom mate_pos tlen seq qual tags start_pos end_pos blocks weight strand".split()


def rd(spark: SparkSession, d: str) -> DataFrame:
    """reads with chromosomes as spelled in chrom_sizes."""
    names = table_broadcast(_spelled(spark, d).select("key", "spelled"))
    r = table(spark, d, "reads").select(*READ_COLUMNS).withColumn("key", chrom_key("chrom")).withColumn("mkey", chrom_key("mate_chrom"))
    r = r.join(names, "key", "left").withColumn("chrom", F.coalesce("spelled", "key")).drop("key", "spelled")
    r = r.join(names.withColumnRenamed("key", "mkey"), "mkey", "left").withColumn("mate_chrom", F.coalesce("spelled", "mkey")).drop("mkey", "spelled")
    return r


def mapped(spark: SparkSession, d: str) -> DataFrame:
    return rd(spark, d).filter(F.col("chrom").isNotNull() & (F.col("end_pos") > F.col("start_pos")))


# --- filters -----------------------------------------------------------------------------

FILTERS = {
    "mapped": (FL.mapped, "flag & 4 = 0 AND chrom IS NOT NULL"),
    "not_chimeric": (FL.not_chimeric, "NOT (flag & 1 <> 0 AND coalesce(mate_chrom <> chrom, false))"),
    "not_duplicate": (FL.not_duplicate, "flag & 1024 = 0"),
    "first_of_pair": (FL.first_of_pair, "flag & 64 <> 0"),
    "second_of_pair": (FL.second_of_pair, "flag & 128 <> 0"),
    "fragment_length": (lambda: FL.fragment_length(100, 400), "coalesce(CASE WHEN coalesce(tlen, 0) <> 0 THEN abs(tlen) ELSE end_pos - start_pos END BETWEEN 100 AND 400, false)"),
    "genomic_span": (lambda: FL.genomic_span(1000), "coalesce(end_pos - start_pos <= 1000, false)"),
    "no_indel": (FL.no_indel, "NOT coalesce(regexp_matches(cigar, '[ID]'), false)"),
    "mapping_quality": (lambda: FL.mapping_quality(10, 20), "coalesce(mapq >= CASE WHEN flag & 1 <> 0 THEN 10 ELSE 20 END, false)"),
    "unspliced": (FL.unspliced, "coalesce(len(blocks) = 1, false)"),
    "spliced": (FL.spliced, "coalesce(len(blocks) > 1, false)"),
    "max_hits": (lambda: FL.max_hits(3), "coalesce(TRY_CAST(tags['NH'] AS INTEGER) <= 3, true)"),
    "paired_and_proper": (FL.paired_and_proper, "flag & 1 <> 0 AND flag & 2 <> 0"),
    "paired_same_chrom": (FL.paired_same_chrom, "flag & 1 <> 0 AND flag & 8 = 0 AND coalesce(mate_chrom = chrom, false)"),
    "proper_or_unpaired": (FL.proper_or_unpaired, "flag & 1 = 0 OR flag & 2 <> 0"),
    "usable": (FL.usable_for_reconstruction, "flag & 1 = 0 OR flag & 2 <> 0 OR (flag & 8 = 0 AND coalesce(mate_chrom = chrom, false))"),
    "starts_in": (lambda: FL.starts_in(F.lit(1_000_000), F.lit(50_000_000)), "coalesce((CASE WHEN strand = '-' THEN end_pos ELSE start_pos END) > 1000000 AND (CASE WHEN strand = '-' THEN end_pos ELSE start_pos END) < 50000000, false)"),
    "ends_in": (lambda: FL.ends_in(F.lit(1_000_000), F.lit(50_000_000)), "coalesce((CASE WHEN strand = '-' THEN start_pos ELSE end_pos END) > 1000000 AND (CASE WHEN strand = '-' THEN start_pos ELSE end_pos END) < 50000000, false)"),
    "same_strand": (lambda: FL.same_strand(F.lit("+")), "coalesce(strand = '+', false)"),
    "unique_mapping": (FL.unique_mapping, "coalesce(weight >= 1, false)"),
}


@R.add("read_filters", "WITH " + RD + ", f AS (" + " UNION ALL ".join(f"SELECT '{k}' AS filter, count(*) FILTER ({s}) AS n FROM rd" for k, (_, s) in FILTERS.items()) + ") SELECT filter, n FROM f")
def read_filters(spark, d):
    """How many reads pass each filter, all in one pass."""
    r = rd(spark, d).agg(*[F.count_if(f()).alias(k) for k, (f, _) in FILTERS.items()])
    return r.unpivot([], list(FILTERS), "filter", "n")


@R.add("all_filters", "WITH " + RD + " SELECT rec_id FROM rd WHERE " + " AND ".join(f"({FILTERS[k][1]})" for k in ("mapped", "not_chimeric", "not_duplicate", "mapping_quality", "no_indel", "proper_or_unpaired", "max_hits")))
def all_filters(spark, d):
    """Reads that pass a chain of filters."""
    chain = FL.all_of([FILTERS[k][0]() for k in ("mapped", "not_chimeric", "not_duplicate", "mapping_quality", "no_indel", "proper_or_unpaired", "max_hits")])
    return rd(spark, d).filter(chain).select("rec_id")


@R.add("predicate_algebra", f"WITH {RD} SELECT rec_id FROM rd WHERE NOT (({FILTERS['spliced'][1]}) OR ({FILTERS['unique_mapping'][1]}))")
def predicate_algebra(spark, d):
    return rd(spark, d).filter(FL.none_of([FL.spliced(), FL.unique_mapping()])).select("rec_id")


# --- per-read functions ------------------------------------------------------------------


def block_string(b: Column) -> Column:
    return F.array_join(F.transform(b, lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")


@R.add("cigar_blocks", "SELECT rec_id, array_to_string([b.start_pos || '-' || b.end_pos for b in blocks], ',') AS blocks FROM reads WHERE cigar IS NOT NULL")
def cigar_blocks(spark, d):
    """Blocks worked out from CIGAR strings; the stored blocks are the check."""
    r = table(spark, d, "reads").filter(F.col("cigar").isNotNull())
    return r.select("rec_id", block_string(B.cigar_blocks(F.col("cigar"), F.col("pos") - 1)).alias("blocks"))


@R.add("block_scalars", """
SELECT rec_id, CAST(list_sum([b.end_pos - b.start_pos for b in blocks]) AS BIGINT) AS bases, end_pos - start_pos AS span, len(blocks) - 1 AS n_introns,
  array_to_string([blocks[i].end_pos || '-' || blocks[i + 1].start_pos for i in range(1, len(blocks))], ',') AS introns FROM reads WHERE len(blocks) > 0
""")
def block_scalars(spark, d):
    b = F.transform("blocks", lambda x: B.block(x["start_pos"], x["end_pos"]))
    r = table(spark, d, "reads").filter(F.size("blocks") > 0).select("rec_id", b.alias("b"))
    return r.select("rec_id", B.length(F.col("b")).alias("bases"), B.span(F.col("b")).alias("span"), (F.size("b") - 1).cast("long").alias("n_introns"), block_string(B.introns(F.col("b"))).alias("introns"))


@R.add("transcript_positions", """
WITH r AS (SELECT rec_id, strand, blocks, list_sum([b.end_pos - b.start_pos for b in blocks]) AS n FROM reads WHERE len(blocks) > 0)
SELECT rec_id, CAST(CASE WHEN strand = '-' THEN n - 1 - (blocks[1].end_pos - blocks[1].start_pos - 1) ELSE blocks[1].end_pos - blocks[1].start_pos - 1 END AS BIGINT) AS at_first_block_end,
  CASE WHEN strand = '-' THEN list_last(blocks).end_pos - 1 ELSE blocks[1].start_pos END AS five_prime FROM r
""")
def transcript_positions(spark, d):
    """Transcript position of the first block's last base, and genome coordinate of position 0."""
    b = F.transform("blocks", lambda x: B.block(x["start_pos"], x["end_pos"]))
    r = table(spark, d, "reads").filter(F.size("blocks") > 0).select("rec_id", "strand", b.alias("b"))
    return r.select("rec_id", B.to_transcript(F.col("b"), F.col("strand"), F.get("b", F.lit(0))["end"] - 1).alias("at_first_block_end"), B.to_genome(F.col("b"), F.col("strand"), F.lit(0)).alias("five_prime"))


@R.add("read_weight", "SELECT rec_id, coalesce(1.0 / TRY_CAST(tags['NH'] AS DOUBLE), 1.0) AS weight FROM reads")
def read_weight(spark, d):
    nh = F.try_element_at("tags", F.lit("NH")).try_cast("double")
    return table(spark, d, "reads").select("rec_id", F.coalesce(1 / nh, F.lit(1.0)).alias("weight"))


@R.add("read_bases", """
SELECT rec_id, round((length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / length(seq), 6) AS gc, reverse(translate(seq, 'ACGT', 'TGCA')) AS revcomp, left(seq, 1) AS first_base FROM reads WHERE seq IS NOT NULL AND length(seq) > 0
""")
def read_bases(spark, d):
    r = table(spark, d, "reads").filter(F.length("seq") > 0)
    return r.select("rec_id", F.round(Q.gc_fraction(F.col("seq")), 6).alias("gc"), Q.reverse_complement(F.col("seq")).alias("revcomp"), F.substring("seq", 1, 1).alias("first_base"))


@R.add("start_composition", "SELECT left(seq, 1) AS base, count(*) AS n, sum(weight) AS weight FROM reads WHERE seq IS NOT NULL GROUP BY 1")
def start_composition(spark, d):
    r = table(spark, d, "reads").filter(F.col("seq").isNotNull())
    return r.groupBy(F.substring("seq", 1, 1).alias("base")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@R.add("read_kmers", "WITH k AS (SELECT unnest([seq[i:i + 5] for i in range(1, length(seq) - 4)]) AS kmer FROM reads WHERE length(seq) >= 6) SELECT kmer, count(*) AS n FROM k GROUP BY 1")
def read_kmers(spark, d):
    return table(spark, d, "reads").select(F.explode(Q.kmers(F.col("seq"), 6)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


@R.add("library_collapse", "SELECT seq, count(*) AS n FROM reads WHERE seq IS NOT NULL GROUP BY 1")
def library_collapse(spark, d):
    return table(spark, d, "reads").filter(F.col("seq").isNotNull()).groupBy("seq").agg(F.count("*").alias("n"))


@R.add("barcode_split", "WITH b AS (SELECT * FROM (VALUES ('ACG', 's1'), ('TTT', 's2'), ('GCA', 's3')) v(code, sample)) SELECT coalesce(sample, 'unmatched') AS sample, count(*) AS n FROM reads r LEFT JOIN b ON left(r.seq, 3) = b.code GROUP BY 1")
def barcode_split(spark, d):
    """Reads by the sample whose barcode begins their sequence."""
    b = spark.createDataFrame([("ACG", "s1"), ("TTT", "s2"), ("GCA", "s3")], "code string, sample string")
    j = table(spark, d, "reads").select(F.substring("seq", 1, 3).alias("code")).join(F.broadcast(b), "code", "left")
    return j.groupBy(F.coalesce("sample", F.lit("unmatched")).alias("sample")).agg(F.count("*").alias("n"))


@R.add("trimmed_ends", "SELECT rec_id, regexp_replace(regexp_replace(seq, 'A{3,}$', ''), '^T{3,}', '') AS trimmed FROM reads WHERE seq IS NOT NULL")
def trimmed_ends(spark, d):
    return table(spark, d, "reads").filter(F.col("seq").isNotNull()).select("rec_id", Q.trim_poly_a(F.col("seq"), 3).alias("trimmed"))


@R.add("motif_reads", "SELECT rec_id, regexp_matches(seq, 'GA[AT]TC') OR regexp_matches(reverse(translate(seq, 'ACGT', 'TGCA')), 'GA[AT]TC') AS hit FROM reads WHERE seq IS NOT NULL")
def motif_reads(spark, d):
    """Reads with a degenerate motif on either strand."""
    pat = Q.iupac_regex("GAWTC")
    s = F.col("seq")
    return table(spark, d, "reads").filter(s.isNotNull()).select("rec_id", (s.rlike(pat) | Q.reverse_complement(s).rlike(pat)).alias("hit"))


# --- aggregates --------------------------------------------------------------------------


@R.add("alignment_statistics", f"""
WITH {RD} SELECT coalesce(chrom, 'unmapped') AS chrom, count(*) AS n, sum(weight) AS weighted, count(*) FILTER (flag & 1 <> 0) AS paired, count(*) FILTER (flag & 64 <> 0) AS first, count(*) FILTER (flag & 128 <> 0) AS second,
 count(*) FILTER (flag & 1024 <> 0) AS duplicates, count(*) FILTER (len(blocks) > 1) AS spliced FROM rd GROUP BY 1
""")
def alignment_statistics(spark, d):
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rd(spark, d).groupBy(F.coalesce("chrom", F.lit("unmapped")).alias("chrom")).agg(
        F.count("*").alias("n"), F.sum("weight").alias("weighted"), n(FL.has(FL.PAIRED)).alias("paired"), n(FL.has(FL.FIRST)).alias("first"), n(FL.has(FL.SECOND)).alias("second"), n(FL.has(FL.DUPLICATE)).alias("duplicates"), n(F.size("blocks") > 1).alias("spliced"),
    )


@R.add("global_stats", f"WITH {RD} SELECT c.chrom, c.length, coalesce(sum(m.weight), 0) AS count, coalesce(sum(m.weight), 0) / c.length AS lambda FROM chrom_sizes c LEFT JOIN mp m ON m.chrom = c.chrom GROUP BY 1, 2")
def global_stats(spark, d):
    return SC.global_stats(mapped(spark, d), sizes(spark, d))


@R.add("replicate_histogram", f"WITH {RD}, g AS (SELECT chrom, start_pos, end_pos, strand, count(*) AS replicates FROM mp GROUP BY ALL) SELECT replicates, count(*) AS n FROM g GROUP BY 1")
def replicate_histogram(spark, d):
    g = mapped(spark, d).groupBy("chrom", "start_pos", "end_pos", "strand").agg(F.count("*").alias("replicates"))
    return g.groupBy("replicates").agg(F.count("*").alias("n"))


@R.add("fragment_sizes", "SELECT CAST(greatest(0, least(49, floor(abs(tlen) / 20))) AS INTEGER) AS bin, count(*) AS n, CAST(greatest(0, least(49, floor(abs(tlen) / 20))) AS INTEGER) * 20.0 AS start FROM reads WHERE flag & 64 <> 0 AND tlen <> 0 GROUP BY 1, 3")
def fragment_sizes(spark, d):
    from strandloom.operators.stats import histogram

    r = table(spark, d, "reads").filter(FL.has(FL.FIRST) & (F.col("tlen") != 0)).select(F.abs("tlen").alias("size"))
    return histogram(r, [], "size", 0.0, 1000.0, 50)


@R.add("reads_in_regions", f"WITH {RD}, {IV} SELECT a.interval_id, count(*) AS n, sum(b.weight) AS weight FROM iv a JOIN mp b ON a.chrom = b.chrom AND a.start_pos - 20000 < b.end_pos AND b.start_pos < a.end_pos + 20000 GROUP BY 1")
def reads_in_regions(spark, d):
    """Weighted reads near every stored interval (20,000 bases either side)."""
    r = mapped(spark, d).select("chrom", "start_pos", "end_pos", "weight")
    wide = iv(spark, d).select("interval_id", "chrom", (F.col("start_pos") - 20_000).alias("start_pos"), (F.col("end_pos") + 20_000).alias("end_pos"))
    return J.overlap_join(wide, r, "inner").groupBy("interval_id").agg(F.count("*").alias("n"), F.sum("weight_r").alias("weight"))


@R.add("junction_counts", f"WITH {RD}, i AS (SELECT chrom, weight, unnest([{{'s': blocks[i].end_pos, 'e': blocks[i + 1].start_pos}} for i in range(1, len(blocks))]) AS x FROM rd WHERE len(blocks) > 1) SELECT chrom, x.s AS start_pos, x.e AS end_pos, count(*) AS reads, sum(weight) AS weight FROM i GROUP BY ALL")
def junction_counts(spark, d):
    return A.junctions(rd(spark, d))


@R.add("mate_pairs", f"""
WITH {RD}, b AS (SELECT *, regexp_replace(name, '/[12]$', '') AS frag FROM rd WHERE chrom IS NOT NULL AND flag & 2316 = 0 AND flag & 1 <> 0)
SELECT x.frag AS name, x.rec_id AS a_id, y.rec_id AS b_id, x.chrom, y.chrom AS mate_chrom, least(x.start_pos, y.start_pos) AS start_pos, greatest(x.end_pos, y.end_pos) AS end_pos
FROM b x JOIN b y ON x.frag = y.frag AND x.flag & 64 <> 0 AND y.flag & 128 <> 0 AND x.chrom = y.mate_chrom AND x.mate_chrom = y.chrom AND x.pos = y.mate_pos AND x.mate_pos = y.pos
 AND (x.flag & 16 <> 0) = (y.flag & 32 <> 0) AND (x.flag & 32 <> 0) = (y.flag & 16 <> 0)
""")
def mate_pairs(spark, d):
    return J.mate_pairs(rd(spark, d))


@R.add("umi_duplicates", f"""
WITH {RD}, c AS (SELECT *, CASE WHEN contains(right(name, 6), 'N') THEN 'NNNNNN' ELSE right(name, 6) END AS code FROM rd),
f AS (SELECT chrom, start_pos, end_pos, code, min(rec_id) AS first_id FROM c WHERE chrom IS NOT NULL AND start_pos IS NOT NULL AND code IS NOT NULL GROUP BY ALL)
SELECT c.rec_id, CASE WHEN c.chrom IS NULL OR c.start_pos IS NULL OR c.code IS NULL THEN false ELSE c.rec_id <> f.first_id END AS duplicate
FROM c LEFT JOIN f ON c.chrom = f.chrom AND c.start_pos = f.start_pos AND c.end_pos = f.end_pos AND c.code = f.code
""")
def umi_duplicates(spark, d):
    return U.mark_duplicates(rd(spark, d).select("rec_id", "name", "chrom", "start_pos", "end_pos"), 6).select("rec_id", "duplicate")


UMI = f"""{RD}, cd AS (SELECT rec_id, chrom, start_pos, end_pos, CASE WHEN contains(right(name, 2), 'N') THEN 'NN' ELSE right(name, 2) END AS code FROM mp),
sat AS (SELECT chrom, start_pos, end_pos, count(*) AS reads, count(DISTINCT code) AS barcodes FROM cd GROUP BY 1, 2, 3),
mol AS (SELECT *, CASE WHEN barcodes >= 16 THEN reads ELSE least(ln(1 - barcodes / 16) / ln(1 - 1 / 16), reads) END AS molecules FROM sat)"""


@R.add("umi_saturation", f"WITH {UMI} SELECT chrom, start_pos, end_pos, reads, barcodes, round(molecules, 9) + 0.0 AS molecules FROM mol")
def umi_saturation(spark, d):
    return U.saturation(mapped(spark, d), 2).withColumn("molecules", F.round("molecules", 9))


@R.add("umi_corrected", f"""
WITH {UMI}, mk AS (SELECT *, code IS NOT NULL AND rec_id > min(rec_id) OVER (PARTITION BY chrom, start_pos, end_pos, code) AS dup FROM cd),
k AS (SELECT mk.*, row_number() OVER (PARTITION BY chrom, start_pos, end_pos, dup ORDER BY rec_id) AS i FROM mk)
SELECT rec_id, dup AND i > round(molecules - barcodes) AS duplicate FROM k JOIN mol USING (chrom, start_pos, end_pos)
""")
def umi_corrected(spark, d):
    m = U.mark_duplicates(mapped(spark, d).select("rec_id", "name", "chrom", "start_pos", "end_pos"), 2)
    return U.unmark_saturated(m, 2).select("rec_id", "duplicate")


@R.add("umi_threshold_fit", f"WITH {UMI}, f AS (SELECT regr_slope(barcodes, reads) AS s, regr_intercept(barcodes, reads) AS i FROM sat) SELECT round(s, 9) AS slope, round(i, 9) AS intercept, round(avg(pow(barcodes - s * reads - i, 2)), 9) AS mse FROM sat, f GROUP BY s, i")
def umi_threshold_fit(spark, d):
    return U.threshold_fit(U.saturation(mapped(spark, d), 2)).select(*[F.round(c, 9).alias(c) for c in ("slope", "intercept", "mse")])


@R.add("cleared_flags", "SELECT rec_id, flag & ~1024 AS flag FROM reads")
def cleared_flags(spark, d):
    return table(spark, d, "reads").select("rec_id", U.clear_duplicate_flag(F.col("flag")).alias("flag"))


# --- windows and scores ------------------------------------------------------------------

SIZE, OVERLAP = 1_000_000, 500_000
WIN = f"""w AS (SELECT c.chrom, i.start_pos AS s, i.end_pos AS e, i.weight, i.strand, unnest(range(CAST(greatest(floor((i.start_pos - {SIZE}) / {OVERLAP}) + 1, 0) AS BIGINT), CAST(floor((i.end_pos - 1) / {OVERLAP}) AS BIGINT) + 1)) AS k, c.length FROM mp i JOIN chrom_sizes c ON i.chrom = c.chrom),
ww AS (SELECT *, k * {OVERLAP} AS start_pos, k * {OVERLAP} + {SIZE} AS end_pos FROM w WHERE k * {OVERLAP} + {SIZE} <= length)"""


@R.add("window_rpkm", f"""
WITH {RD}, {WIN}, t AS (SELECT sum(m.weight) AS total FROM mp m JOIN chrom_sizes c ON m.chrom = c.chrom), l AS (SELECT c.chrom, sum(m.weight) / c.length AS lambda FROM chrom_sizes c JOIN mp m ON m.chrom = c.chrom GROUP BY c.chrom, c.length)
SELECT ww.chrom, start_pos, end_pos, round(sum(weight), 6) AS count, round(sum(weight) * 1e9 / (t.total * {SIZE}), 6) AS rpkm, round(sum(weight) / {SIZE} / l.lambda, 6) AS enrichment FROM ww JOIN l ON ww.chrom = l.chrom CROSS JOIN t GROUP BY ww.chrom, start_pos, end_pos, t.total, l.lambda
""")
def window_rpkm(spark, d):
    s = SC.scored_windows(mapped(spark, d), sizes(spark, d), SIZE, OVERLAP)
    return s.select("chrom", "start_pos", "end_pos", F.round("count", 6).alias("count"), F.round("rpkm", 6).alias("rpkm"), F.round("enrichment", 6).alias("enrichment"))


@R.add("window_counts_contained", f"WITH {RD}, {WIN} SELECT chrom, start_pos, end_pos, round(sum(CASE WHEN s >= start_pos AND e <= end_pos THEN weight ELSE 0 END), 6) AS count FROM ww GROUP BY 1, 2, 3")
def window_counts_contained(spark, d):
    c = SC.window_counts(mapped(spark, d), sizes(spark, d), SIZE, OVERLAP, fully_contained=True)
    return c.withColumn("count", F.round("count", 6))


@R.add("window_scan_p", f"""
WITH {RD}, {WIN}, g AS (SELECT m.chrom, sum(m.weight) / max(c.length) AS rate, max(c.length) AS t FROM mp m JOIN chrom_sizes c ON m.chrom = c.chrom GROUP BY 1),
c AS (SELECT chrom, start_pos, end_pos, sum(weight) AS count FROM ww GROUP BY 1, 2, 3),
p AS (SELECT *, CAST(floor(count + 1e-9) AS BIGINT) AS k, rate * {SIZE} AS m FROM c JOIN g USING (chrom)),
q AS (SELECT *, exp((k - 1) * ln(m) - m - lgamma(k)) AS pmf, list_sum(list_transform(range(0, k), lambda i: exp(i * ln(m) - m - lgamma(i + 1)))) AS cdf FROM p)
SELECT chrom, start_pos, end_pos, round(count, 6) AS count, round(CASE WHEN k <= 2 THEN 1 ELSE least(1, greatest(0, 1 - cdf * exp(-(k - m) / k * rate * (t - {SIZE}) * pmf))) END, 9) AS scan_p FROM q
""")
def window_scan_p(spark, d):
    """Scan-statistic p value of every window with reads."""
    return SC.scored_windows(mapped(spark, d), sizes(spark, d), SIZE, OVERLAP).select("chrom", "start_pos", "end_pos", F.round("count", 6).alias("count"), F.round("scan_p", 9).alias("scan_p"))


def by_library(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = mapped(spark, d).withColumn("lib", F.translate(F.try_element_at("tags", F.lit("RG")), "-", "_"))
    return r.filter(F.col("lib") == "lib_b"), r.filter(F.col("lib") == "lib_a")


@R.add("two_sample_ratio", f"""
WITH {RD}, g AS (SELECT *, translate(tags['RG'], '-', '_') AS lib FROM mp), w AS (SELECT g.chrom, g.weight, g.lib, unnest(range(CAST(greatest(floor((start_pos - {SIZE}) / {SIZE}) + 1, 0) AS BIGINT), CAST(floor((end_pos - 1) / {SIZE}) AS BIGINT) + 1)) AS k, c.length FROM g JOIN chrom_sizes c ON g.chrom = c.chrom WHERE lib IN ('lib_a', 'lib_b')),
x AS (SELECT chrom, k * {SIZE} AS start_pos, sum(CASE WHEN lib = 'lib_b' THEN weight ELSE 0 END) AS a, sum(CASE WHEN lib = 'lib_a' THEN weight ELSE 0 END) AS b FROM w WHERE k * {SIZE} + {SIZE} <= length GROUP BY 1, 2),
t AS (SELECT sum(CASE WHEN lib = 'lib_b' THEN weight ELSE 0 END) AS ta, sum(CASE WHEN lib = 'lib_a' THEN weight ELSE 0 END) AS tb FROM g WHERE chrom IN (SELECT chrom FROM chrom_sizes))
SELECT chrom, start_pos, round(a, 6) AS a, round(b, 6) AS b, round((a * 1e9 / (ta * {SIZE}) + 0.001) / (b * 1e9 / (tb * {SIZE}) + 0.001), 6) AS ratio, round((a / ta) / ((b + 1) / tb), 6) AS enrichment FROM x, t
""")
def two_sample_ratio(spark, d):
    a, b = by_library(spark, d)
    j = SC.two_sample_windows(a, b, sizes(spark, d), SIZE, 0)
    return j.select("chrom", "start_pos", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("ratio", 6).alias("ratio"), F.round("enrichment", 6).alias("enrichment"))


@R.add("two_sample_p")
def two_sample_p(spark, d):
    """Poisson, binomial and Skellam p values of one library against another."""
    a, b = by_library(spark, d)
    return SC.two_sample_windows(a, b, sizes(spark, d), SIZE, OVERLAP).select("chrom", "start_pos", "end_pos", "poisson_p", "binomial_p", "binomial_enrich_p", "binomial_deplete_p", "skellam_p")


@R.add("segment_scores")
def segment_scores(spark, d):
    a, b = by_library(spark, d)
    return P.segment_scores(a, b, sizes(spark, d), SIZE)


@R.add("read_depth_segments", f"""
WITH {RD}, x AS (SELECT chrom, unnest(blocks) AS b FROM mp), ev AS (SELECT chrom, unnest([b.start_pos, b.end_pos]) AS pos, unnest([1, -1]) AS delta FROM x), s AS (SELECT chrom, pos, sum(delta) AS delta FROM ev GROUP BY 1, 2),
r AS (SELECT chrom, pos AS start_pos, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS end_pos, CAST(sum(delta) OVER (PARTITION BY chrom ORDER BY pos) AS BIGINT) AS depth FROM s) SELECT * FROM r WHERE depth > 0
""")
def read_depth_segments(spark, d):
    """Per-base depth of the reads' blocks as segments."""
    return P.coverage_segments(mapped(spark, d).select("chrom", F.inline("blocks")))


@R.add("scan_peaks")
def scan_peaks(spark, d):
    return P.scan_peaks(mapped(spark, d), sizes(spark, d), SIZE, OVERLAP, 1e-3)


@R.add("skellam_peaks")
def skellam_peaks(spark, d):
    a, b = by_library(spark, d)
    return P.two_sample_peaks(a, b, sizes(spark, d), SIZE, OVERLAP, 0.01, "skellam_p")


@R.add("ratio_permutation_peaks")
def ratio_permutation_peaks(spark, d):
    a, b = by_library(spark, d)
    return P.ratio_permutation_peaks(a, b, sizes(spark, d), SIZE, OVERLAP, 10, 0.99, 3)


@R.add("contiguous_segments")
def contiguous_segments(spark, d):
    return P.contiguous_segments(mapped(spark, d), sizes(spark, d), SIZE, 0.01)


@R.add("dominance_filter", f"WITH {RD}, {IV}, g AS (SELECT a.interval_id, b.start_pos, b.end_pos, count(*) AS n FROM (SELECT interval_id, chrom, start_pos - 50000 AS s, end_pos + 50000 AS e FROM iv) a JOIN mp b ON a.chrom = b.chrom AND a.s < b.end_pos AND b.start_pos < a.e GROUP BY 1, 2, 3) SELECT interval_id, max(n) / sum(n) AS share FROM g GROUP BY 1 HAVING max(n) / sum(n) <= 0.5")
def dominance_filter(spark, d):
    wide = iv(spark, d).select("interval_id", "chrom", (F.col("start_pos") - 50_000).alias("start_pos"), (F.col("end_pos") + 50_000).alias("end_pos"))
    return P.dominance_filter(wide, mapped(spark, d).select("chrom", "start_pos", "end_pos"), "interval_id", 0.5)


@R.add("splice_transcripts")
def splice_transcripts(spark, d):
    """Transcript paths through the splice graph of all reads."""
    v, e = A.splice_graph(mapped(spark, d).select("chrom", "blocks", "weight"), 1, 0.05)
    # A path of two blocks has a junction's reads and so comes before all of one: the numbers don't depend on these.
    return A.transcripts(v, e, 20, single=False, least_blocks=2)


@R.add("gc_windows", "WITH s AS (SELECT rec_id, seq, unnest(range(0, length(seq) - 12 + 1, 6)) AS start FROM reads WHERE length(seq) >= 12) SELECT rec_id, start, round((12 - length(replace(replace(seq[start + 1:start + 12], 'G', ''), 'C', ''))) / 12, 6) AS gc FROM s")
def gc_windows(spark, d):
    """GC share of sliding windows along each sequence."""
    r = table(spark, d, "reads").filter(F.length("seq") >= 12).select("rec_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 12, F.lit(6))).alias("start"))
    return r.select("rec_id", F.col("start").cast("long").alias("start"), F.round(Q.gc_fraction(F.substring("seq", F.col("start") + 1, F.lit(12))), 6).alias("gc"))


@R.add("unique_reads_fpkm", f"WITH {RD}, {IV}, t AS (SELECT sum(weight) AS t FROM mp) SELECT a.interval_id, round(sum(b.weight), 6) AS count, round(sum(b.weight) * 1000 / (a.end_pos - a.start_pos + 40000) * 1e6 / t.t, 6) AS fpkm FROM iv a JOIN mp b ON a.chrom = b.chrom AND a.start_pos - 20000 < b.end_pos AND b.start_pos < a.end_pos + 20000 CROSS JOIN t GROUP BY 1, a.end_pos, a.start_pos, t.t")
def unique_reads_fpkm(spark, d):
    wide = iv(spark, d).select("interval_id", "chrom", (F.col("start_pos") - 20_000).alias("start_pos"), (F.col("end_pos") + 20_000).alias("end_pos")).withColumn("length", F.col("end_pos") - F.col("start_pos"))
    f = A.fpkm(wide, mapped(spark, d).select("chrom", "start_pos", "end_pos", "weight"), "interval_id")
    return f.select("interval_id", F.round("count", 6).alias("count"), F.round("fpkm", 6).alias("fpkm"))


# --- enrichment, pile-ups ------------------------------------------------------------------


@R.add("skellam_divergence_peaks")
def skellam_divergence_peaks(spark, d):
    a, b = by_library(spark, d)
    return P.skellam_divergence_peaks(a, b, sizes(spark, d), SIZE, OVERLAP, 0.01)


@R.add("end_pileup")
def end_pileup(spark, d):
    """5' read ends within 50,000 bases of the intervals, against shuffled ends."""
    wide = iv(spark, d).select("interval_id", "chrom", F.greatest(F.col("start_pos") - 50_000, F.lit(0)).alias("start_pos"), (F.col("end_pos") + 50_000).alias("end_pos"))
    return P.end_pileup(mapped(spark, d), wide, "interval_id", 20, 11)
