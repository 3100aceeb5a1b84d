"""Operations on transcript tables: (name, chrom, start_pos, end_pos, strand, blocks, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import blocks as B
from strandloom.functions import sequence as Q
from strandloom.operators import setops
from strandloom.operators.graph import components
from strandloom.operators.join import overlap_join
from strandloom.operators.windows import place_in_free
from strandloom.session import stage


def exons(t: DataFrame, distinct: bool = False) -> DataFrame:
    """One row per block."""
    x = t.select("name", "chrom", "strand", F.inline("blocks")).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})
    return x.drop("name").distinct() if distinct else x


def introns(t: DataFrame) -> DataFrame:
    return t.select("name", "chrom", "strand", F.inline(B.introns(F.col("blocks")))).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


def lengths(t: DataFrame) -> DataFrame:
    return t.select("name", B.length(F.col("blocks")).alias("length"), B.span(F.col("blocks")).alias("span"), F.size("blocks").alias("exons"))


def collapsed_lengths(t: DataFrame, gene: str) -> DataFrame:
    """(gene, length): bases of the union of all exons of a gene's transcripts."""
    x = t.select(F.col(gene).alias("gene"), "chrom", F.inline("blocks")).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})
    return setops.merged(x, ["gene", "chrom"], touching=True).groupBy("gene").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("length"))


def unique_structures(t: DataFrame) -> DataFrame:
    """One transcript (the least name) per chromosome, strand and blocks."""
    return t.groupBy("chrom", "strand", "blocks").agg(F.min("name").alias("name"), F.count("*").alias("copies"))


def exon_pairs(a: DataFrame, b: DataFrame, strand: bool = True) -> DataFrame:
    """(a_name, b_name, bases): transcripts that share exon bases."""
    j = overlap_join(exons(a), exons(b), "inner", strand=strand)
    shared = F.least("end_pos", "end_pos_r") - F.greatest("start_pos", "start_pos_r")
    return j.groupBy(F.col("name").alias("a_name"), F.col("name_r").alias("b_name")).agg(F.sum(shared).alias("bases"))


def exon_overlap(a: DataFrame, b: DataFrame, difference: bool = False, strand: bool = True) -> DataFrame:
    """Transcripts of ``a`` that share (or don't share) an exon base with ``b``."""
    hit = overlap_join(exons(a), exons(b), "left_semi", strand=strand).select("name").distinct()
    return a.join(hit, "name", "left_anti" if difference else "left_semi")


def percent_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_name, b_name, share): for each transcript of ``a`` the greatest share of its bases inside one transcript of ``b``."""
    p = exon_pairs(a, b).join(lengths(a).select(F.col("name").alias("a_name"), "length"), "a_name").withColumn("share", F.col("bases") / F.col("length"))
    best = F.min_by(F.struct("b_name", "share"), F.struct((-F.col("share")).alias("s"), "b_name"))
    return p.groupBy("a_name").agg(best.alias("x")).select("a_name", "x.b_name", "x.share")


def loci(t: DataFrame, least_share: float = 0.0) -> DataFrame:
    """(name, locus): transcripts joined by chains of same-strand exon overlap of at least ``least_share`` of the shorter one; names must be unique."""
    ids = stage(t.select("name").distinct().withColumn("id", F.monotonically_increasing_id()), "ids")
    n = lengths(t).select("name", "length")
    p = exon_pairs(t, t).filter(F.col("a_name") < F.col("b_name"))
    p = p.join(n.toDF("a_name", "la"), "a_name").join(n.toDF("b_name", "lb"), "b_name").filter(F.col("bases") >= least_share * F.least("la", "lb"))
    links = p.join(ids.toDF("a_name", "a"), "a_name").join(ids.toDF("b_name", "b"), "b_name").select("a", "b")
    c = components(links)
    placed = ids.join(c, "id", "left").withColumn("pivot", F.coalesce("pivot", "id"))
    first = placed.groupBy("pivot").agg(F.min("name").alias("locus"))
    return placed.join(first, "pivot").select("name", "locus")


def clip_to_regions(t: DataFrame, regions: DataFrame) -> DataFrame:
    """(name, chrom, blocks, region): transcripts cut to every region they overlap; null blocks are left out."""
    j = overlap_join(t, regions, "inner").withColumn("blocks", B.intersect(F.col("blocks"), B.single(F.col("start_pos_r"), F.col("end_pos_r"))))
    return j.filter(F.size("blocks") > 0)


def last_bases(t: DataFrame, n: int) -> DataFrame:
    return t.withColumn("blocks", B.last_bases(F.col("blocks"), F.col("strand"), n)).withColumn("start_pos", B.first_start(F.col("blocks"))).withColumn("end_pos", B.last_end(F.col("blocks")))


def low_repeat(t: DataFrame, repeats: DataFrame, most: float) -> DataFrame:
    """Transcripts of whose exon bases at most the share ``most`` lies in repeats."""
    cover = setops.merged(repeats, touching=True)
    hit = overlap_join(exons(t), cover, "inner").groupBy("name").agg(F.sum(F.least("end_pos", "end_pos_r") - F.greatest("start_pos", "start_pos_r")).alias("_r"))
    bad = hit.join(lengths(t).select("name", "length"), "name").filter(F.col("_r") > most * F.col("length"))
    return t.join(bad, "name", "left_anti")


def transcript_windows(t: DataFrame, size: int, step: int) -> DataFrame:
    """(name, chrom, window, blocks): windows along every transcript."""
    return t.select("name", "chrom", "strand", F.posexplode(B.windows(F.col("blocks"), F.col("strand"), size, step)).alias("window", "blocks"))


def aggregate_profile(regions: DataFrame, signal: DataFrame, key: str, value: str, bins: int) -> DataFrame:
    """(bin, mean, regions): value x bases of the signal by relative place from the 5' end, over all regions.

    ``signal`` is (chrom, start_pos, end_pos, value); bases without signal count as 0.
    """
    width = (F.col("end_pos") - F.col("start_pos")) / bins
    j = overlap_join(regions, signal, "inner")
    lo, hi = F.greatest("start_pos", "start_pos_r") - F.col("start_pos"), F.least("end_pos", "end_pos_r") - F.col("start_pos")
    j = j.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_w", width)
    j = j.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / F.col("_w")).cast("int"), F.least(F.ceil(F.col("_hi") / F.col("_w")) - 1, F.lit(bins - 1)).cast("int"))))
    part = F.greatest(F.least(F.col("_hi"), (F.col("_b") + 1) * F.col("_w")) - F.greatest(F.col("_lo"), F.col("_b") * F.col("_w")), F.lit(0.0)) * F.col(f"{value}_r") / F.col("_w")
    b = F.when(F.col("strand") == "-", bins - 1 - F.col("_b")).otherwise(F.col("_b"))
    n = regions.agg(F.count("*").alias("regions"))
    return j.groupBy(b.alias("bin")).agg(F.sum(part).alias("_s")).join(F.broadcast(n)).select("bin", (F.col("_s") / F.col("regions")).alias("mean"), "regions")


def end_assignment(ends: DataFrame, t: DataFrame, most: int) -> DataFrame:
    """(end_id, name, distance): pile-ups of read ends joined to the nearest same-strand transcript 3' end within ``most`` bases.

    ``ends`` is (end_id, chrom, pos, strand).  Ties go to the least name.
    """
    tip = F.when(F.col("strand") == "-", F.col("start_pos")).otherwise(F.col("end_pos") - 1)
    tips = t.select("name", "chrom", "strand", tip.alias("start_pos")).withColumn("end_pos", F.col("start_pos") + 1)
    e = ends.select("end_id", "chrom", "strand", F.col("pos").alias("start_pos"), (F.col("pos") + 1).alias("end_pos"))
    j = overlap_join(e, tips, "inner", strand=True, slack=most).withColumn("distance", F.abs(F.col("start_pos") - F.col("start_pos_r")))
    best = F.min_by(F.struct("name_r", "distance"), F.struct("distance", "name_r"))
    return j.groupBy("end_id").agg(best.alias("x")).select("end_id", F.col("x.name_r").alias("name"), "x.distance")


def end_pile(reads: DataFrame, five_prime: bool = False) -> DataFrame:
    """(chrom, strand, pos, n, z): reads ending (or starting) at a place, and the z score among its chromosome's places."""
    on_start = (F.col("strand") == "-") != F.lit(five_prime)
    pos = F.when(on_start, F.col("start_pos")).otherwise(F.col("end_pos") - 1)
    p = reads.filter(F.col("chrom").isNotNull() & F.col("start_pos").isNotNull()).groupBy("chrom", "strand", pos.alias("pos")).agg(F.count("*").alias("n"))
    s = p.groupBy("chrom").agg(F.avg("n").alias("_m"), F.stddev_samp("n").alias("_s"))
    return p.join(s, "chrom").select("chrom", "strand", "pos", "n", ((F.col("n") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).alias("z"))


def amplicons(seqs: DataFrame, forward: str, reverse: str, most: int) -> DataFrame:
    """(id, start, end): stretches of at most ``most`` bases from the forward primer to the reverse primer's complement, both ends included."""
    back = reverse.upper().translate(str.maketrans("ACGT", "TGCA"))[::-1]
    s = F.col("bases")
    f = seqs.select("id", F.explode(Q.motif_starts(s, forward)).alias("start"))
    r = seqs.select("id", F.explode(Q.motif_starts(s, back)).alias("_r"))
    j = f.join(r, "id").withColumn("end", F.col("_r") + len(back))
    return j.filter((F.col("_r") >= F.col("start")) & (F.col("end") - F.col("start") <= most)).select("id", "start", "end")


def random_placement(t: DataFrame, free: DataFrame, seed: int) -> DataFrame:
    """Transcripts moved, structure kept, to seeded places inside free stretches long enough for them, chosen by their room.

    A transcript's place is drawn by a hash among all the starts at which it fits into a free stretch of its
    chromosome.  Transcripts for which no stretch is long enough get null blocks.
    """
    p = place_in_free(t.select("name", "chrom", "blocks"), free, B.span(F.col("blocks")), F.xxhash64(F.lit(seed), "name"))
    return p.select("name", "chrom", F.when(F.col("_to").isNotNull(), B.move_to(F.col("blocks"), F.col("_to"))).alias("blocks"))


def simulated_reads(t: DataFrame, length: int, per_transcript: int, seed: int) -> DataFrame:
    """(name, read, chrom, strand, blocks): fragments of ``length`` bases at seeded transcript positions."""
    n = B.length(F.col("blocks"))
    r = t.filter(n >= length).select("name", "chrom", "strand", "blocks", F.explode(F.sequence(F.lit(1), F.lit(per_transcript))).alias("read"))
    at = F.pmod(F.xxhash64(F.lit(seed), "name", "read"), n - length + 1)
    return r.select("name", "read", "chrom", "strand", B.transcript_slice(F.col("blocks"), F.col("strand"), at, at + length).alias("blocks"))


def sample_introns(t: DataFrame, seed: int) -> DataFrame:
    """(name, intron, start_pos, end_pos): of every intron a stretch as long as the exon before it, or the whole intron if it is no longer.

    The stretch is drawn among all places inside the intron by a hash of (seed, name, intron).
    Transcripts (name, chrom, blocks) with one block give no rows.
    """
    pair = F.transform(F.sequence(F.lit(0), F.size("blocks") - 2), lambda i: F.struct(i.alias("intron"), F.get("blocks", i).alias("exon"), F.get("blocks", i + 1).alias("after")))
    i = t.filter(F.size("blocks") > 1).select("name", "chrom", F.inline(pair))
    s, e = F.col("exon.end"), F.col("after.start")
    n = F.col("exon.end") - F.col("exon.start")
    room = e - s - n
    start = s + F.when(room > 0, F.pmod(F.xxhash64(F.lit(seed), "name", "intron"), room + 1)).otherwise(0)
    return i.filter(e > s).select("name", "chrom", "intron", start.alias("start_pos"), F.least(start + n, e).alias("end_pos"))
