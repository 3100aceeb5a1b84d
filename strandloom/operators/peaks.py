"""Peak callers built from scans, islands and sweeps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from strandloom.functions import kernels as K
from strandloom.operators import scores as S
from strandloom.operators import setops
from strandloom.operators import stats as T
from strandloom.operators.join import LEVEL_BITS, _level, overlap_join
from strandloom.operators.ordered import exact_quantile
from strandloom.operators.periods import range_numbered, sweep
from strandloom.operators.windows import relocate
from strandloom.session import bounded_broadcast, parallelism, stage

skellam_tail = K.arrow_udf(lambda s, c, ls, lc: K.skellam_sf(s - c - 1, ls, lc))
poisson_tail = K.arrow_udf(lambda k, lam: K.poisson_sf(k - 1, lam))


def coverage_segments(intervals: DataFrame) -> DataFrame:
    """(chrom, start_pos, end_pos, depth): stretches of constant depth above 0."""
    s = sweep(intervals, "chrom").withColumnRenamed("key", "chrom")
    nxt = F.lead("pos").over(Window.partitionBy("_pid", "chrom").orderBy("pos"))
    local = s.withColumn("_n", nxt)
    first = s.groupBy("chrom", "_pid").agg(F.min("pos").alias("_f"))
    after = first.select("chrom", "_pid", F.lead("_f").over(Window.partitionBy("chrom").orderBy("_pid")).alias("_a"))
    j = local.join(bounded_broadcast(after), ["chrom", "_pid"]).withColumn("end_pos", F.coalesce("_n", "_a"))
    return j.filter((F.col("active") > 0) & F.col("end_pos").isNotNull()).select("chrom", F.col("pos").alias("start_pos"), "end_pos", F.col("active").alias("depth"))


def run_length(segments: DataFrame, value: str) -> DataFrame:
    """Neighbouring segments of one value joined into one."""
    numbered = stage(range_numbered(segments.select("chrom", "start_pos", "end_pos", F.col(value).alias("_v")), ["chrom", "start_pos"]), "runs")
    w = Window.partitionBy("_pid", "chrom").orderBy("start_pos")
    edge = ~((F.lag("end_pos").over(w) == F.col("start_pos")) & F.lag("_v").over(w).eqNullSafe(F.col("_v")))
    g = numbered.withColumn("_g", F.sum(F.coalesce(edge, F.lit(True)).cast("int")).over(w))
    part = g.groupBy("_pid", "chrom", "_g").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.first("_v").alias("_v"))
    # Runs cut by a partition border: the ends of each partition are joined in a second, small pass.
    sides = Window.partitionBy("_pid", "chrom")
    p = part.withColumn("_end", (F.col("_g") == F.min("_g").over(sides)) | (F.col("_g") == F.max("_g").over(sides)))
    inner = p.filter(~F.col("_end")).select("chrom", "start_pos", "end_pos", "_v")
    o = Window.partitionBy("chrom").orderBy("start_pos")  # two rows a partition
    q = p.filter("_end")
    e2 = ~((F.lag("end_pos").over(o) == F.col("start_pos")) & F.lag("_v").over(o).eqNullSafe(F.col("_v")))
    q = q.withColumn("_h", F.sum(F.coalesce(e2, F.lit(True)).cast("int")).over(o)).groupBy("chrom", "_h").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.first("_v").alias("_v"))
    return inner.unionByName(q.select("chrom", "start_pos", "end_pos", "_v")).withColumnRenamed("_v", value)


def gap_peaks(segments: DataFrame, least_depth: int = 5, max_gap: int = 200) -> DataFrame:
    """(chrom, start_pos, end_pos, segments, max_depth): segments of at least ``least_depth``, joined while the next one starts less than ``max_gap`` after the end."""
    ok = stage(segments.filter(F.col("depth") >= least_depth), "deep")
    wide = ok.withColumn("end_pos", F.col("end_pos") + max_gap - 1)
    m = setops.merged(wide, touching=True)
    hit = overlap_join(ok, m, "inner", contained="left")
    return hit.groupBy("chrom", "start_pos_r").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count("*").alias("segments"), F.max("depth").alias("max_depth")).drop("start_pos_r")


def scan_peaks(reads: DataFrame, sizes: DataFrame, size: int, overlap: int, alpha: float, least_count: float = 3.0) -> DataFrame:
    """Windows with a scan p value below ``alpha``, overlapping ones merged, and the best p of each."""
    w = S.scored_windows(reads, sizes, size, overlap)
    hit = stage(w.filter((F.col("count") >= least_count) & (F.col("scan_p") < alpha)).select("chrom", "start_pos", "end_pos", "count", "scan_p"), "hits")
    m = setops.merged(hit)
    return overlap_join(hit, m, "inner", contained="left").groupBy("chrom", F.col("start_pos_r").alias("start_pos"), F.col("end_pos_r").alias("end_pos")).agg(F.count("*").alias("windows"), F.max("count").alias("max_count"), F.min("scan_p").alias("best_p"))


def two_sample_peaks(sample: DataFrame, control: DataFrame, sizes: DataFrame, size: int, overlap: int, alpha: float, score: str = "skellam_p") -> DataFrame:
    """Windows whose two-sample p value (skellam_p, poisson_p or binomial_p) is below ``alpha``, merged."""
    w = S.two_sample_windows(sample, control, sizes, size, overlap)
    hit = stage(w.filter(F.col(score) < alpha).select("chrom", "start_pos", "end_pos", "a", "b", F.col(score).alias("p")), "hits")
    m = setops.merged(hit)
    return overlap_join(hit, m, "inner", contained="left").groupBy("chrom", F.col("start_pos_r").alias("start_pos"), F.col("end_pos_r").alias("end_pos")).agg(F.count("*").alias("windows"), F.max("a").alias("max_a"), F.min("p").alias("best_p"))


def segment_scores(sample: DataFrame, control: DataFrame, sizes: DataFrame, window: int) -> DataFrame:
    """-log10 p of the sample against the control in every window: Poisson and Skellam score machines."""
    j = S.two_sample_windows(sample, control, sizes, window, 0)
    minus = lambda p: -F.log10(F.greatest(p, F.lit(1e-300)))
    return j.select("chrom", "start_pos", "end_pos", "a", "b", minus("poisson_p").alias("poisson_score"), minus("skellam_p").alias("skellam_score"))


def dominance_filter(regions: DataFrame, reads: DataFrame, key: str, most: float) -> DataFrame:
    """(key, share): share of the most frequent (start, end) among the reads of each region, where it is at most ``most``."""
    hit = overlap_join(regions, reads, "inner").groupBy(key, "start_pos_r", "end_pos_r").agg(F.count("*").alias("n"))
    return hit.groupBy(key).agg((F.max("n") / F.sum("n")).alias("share")).filter(F.col("share") <= most)


def trim_to_core(depths: DataFrame, key: str, quantile: float) -> DataFrame:
    """(key, start, end): the contiguous run with the greatest sum of depth minus its ``quantile`` per region.

    ``depths`` is (key, place, depth) with places from 0 without holes.
    """
    q = depths.groupBy(key).agg(F.percentile("depth", F.lit(quantile)).alias("_q"))
    j = depths.join(q, key).withColumn("_d", F.col("depth") - F.col("_q"))
    return T.max_subsum(j, [key], "place", "_d")


def overlap_significance(a: DataFrame, b: DataFrame, sizes: DataFrame, key: str, rounds: int, seed: int) -> DataFrame:
    """One row: observed overlapping rows of ``a``, mean over ``rounds`` relocations, p and (b + 1) / (n + 1)."""
    obs = overlap_join(a, b, "left_semi").agg(F.count("*").alias("observed"))
    moved = relocate(a.select(key, "chrom", "start_pos", "end_pos"), sizes, key, seed, rounds=rounds)
    hits = overlap_join(moved, setops.merged(b, touching=True), "left_semi").groupBy("permutation").agg(F.count("*").alias("n"))
    all_ = a.sparkSession.range(1, rounds + 1).select(F.col("id").cast("int").alias("permutation")).join(hits, "permutation", "left").fillna(0, ["n"])
    s = all_.join(F.broadcast(obs)).groupBy("observed").agg(F.avg("n").alias("expected"), F.sum((F.col("n") >= F.col("observed")).cast("int")).alias("_b"))
    return s.select("observed", "expected", (F.col("_b") / rounds).alias("p"), ((F.col("_b") + 1) / (rounds + 1)).alias("p_plus_one"))


def null_ratios(sample: DataFrame, control: DataFrame, sizes: DataFrame, size: int, overlap: int, rounds: int, seed: int) -> DataFrame:
    """(permutation, chrom, start_pos, end_pos, log2_ratio): window ratios with the reads of both samples moved at random."""
    keys = ["permutation", "chrom", "start_pos", "end_pos"]

    def counts(df: DataFrame, name: str, s: int) -> DataFrame:
        from strandloom.operators.windows import scan

        r = relocate(df.select("rec_id", "chrom", "start_pos", "end_pos", "weight"), sizes, "rec_id", s, rounds=rounds)
        tagged = r.withColumn("chrom", F.concat_ws("\t", "chrom", "permutation"))
        wide = sizes.select("chrom", "length").withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).select(F.concat_ws("\t", "chrom", "p").alias("chrom"), "length")
        c = scan(tagged, wide, size, overlap, [F.sum("r_weight").alias(name)])
        return c.withColumn("permutation", F.substring_index("chrom", "\t", -1).cast("int")).withColumn("chrom", F.substring_index("chrom", "\t", 1))

    j = counts(sample, "a", seed).join(counts(control, "b", seed + 1), keys, "full").fillna(0.0, ["a", "b"])
    ta, tb = sample.agg(F.sum("weight").alias("ta")), control.agg(F.sum("weight").alias("tb"))
    j = j.join(F.broadcast(ta)).join(F.broadcast(tb))
    return j.select(*keys, F.log2(S.ratio(F.try_divide(F.col("a") * 1e9, F.col("ta") * size), F.try_divide(F.col("b") * 1e9, F.col("tb") * size))).alias("log2_ratio"))


def ratio_permutation_peaks(sample: DataFrame, control: DataFrame, sizes: DataFrame, size: int, overlap: int, rounds: int, quantile: float, seed: int) -> DataFrame:
    """Windows above the ``quantile`` of the null ratio distribution, overlapping ones merged."""
    null = null_ratios(sample, control, sizes, size, overlap, rounds, seed).filter(F.col("log2_ratio").isNotNull())
    cut = exact_quantile(null, "log2_ratio", quantile).withColumnRenamed("value", "cut")
    w = S.two_sample_windows(sample, control, sizes, size, overlap).join(F.broadcast(cut)).filter(F.col("log2_ratio") > F.col("cut"))
    return setops.merged(w.select("chrom", "start_pos", "end_pos"))


def contiguous_segments(reads: DataFrame, sizes: DataFrame, size: int, alpha: float) -> DataFrame:
    """Windows at or above the critical count of their chromosome (scan statistic), merged where they overlap or touch."""
    stats = S.global_stats(reads, sizes).withColumn("cut", S.critical(F.lit(float(size)), F.col("length").cast("double"), F.col("lambda"), F.lit(alpha)))
    w = S.window_counts(reads, sizes, size, size // 2).join(bounded_broadcast(stats.select("chrom", "cut")), "chrom").filter(F.col("count") >= F.col("cut"))
    return setops.merged(w.select("chrom", "start_pos", "end_pos"), touching=True)


def annotation_enrichment(annotations: DataFrame, group: str, peaks: DataFrame, regions: DataFrame, sizes: DataFrame, key: str, rounds: int, seed: int) -> DataFrame:
    """(group, observed, expected, enrichment, p): peaks that overlap each set of annotations, against peaks moved at random inside ``regions``.

    Peaks (with unique ``key``) outside all regions don't count.  A moved peak keeps its length and chromosome and
    lies wholly in a merged region; where none is long enough it is left out of that
    round.  ``p`` is (rounds with at least the observed number + 1) / (rounds + 1).  Null groups are no group.
    """
    inside = setops.merged(regions, touching=True)
    p = stage(overlap_join(peaks.select(key, "chrom", "start_pos", "end_pos"), inside, "left_semi"), "peaks")
    moved = relocate(p, sizes, key, seed, rounds=rounds, masks=setops.complement(inside, sizes)).filter(F.col("start_pos").isNotNull())
    every = stage(p.withColumn("permutation", F.lit(0)).unionByName(moved.select(*p.columns, "permutation")), "moved")
    sets = stage(setops.merged(annotations.filter(F.col(group).isNotNull()).withColumn("_g", F.col(group)), ["chrom", "_g"], touching=True), "sets")
    hit = overlap_join(every, sets, "inner").groupBy("_g_r", "permutation").agg(F.count_distinct(key).alias("n"))
    grid = sets.select(F.col("_g").alias("_g_r")).distinct().withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    n = grid.join(hit, ["_g_r", "permutation"], "left").fillna(0, ["n"])
    obs = n.filter("permutation = 0").select("_g_r", F.col("n").alias("observed"))
    null = n.filter("permutation > 0").join(obs, "_g_r").groupBy("_g_r", "observed").agg(F.avg("n").alias("expected"), F.count_if(F.col("n") >= F.col("observed")).alias("_b"))
    return null.select(F.col("_g_r").alias(group), "observed", "expected", F.try_divide("observed", "expected").alias("enrichment"), ((F.col("_b") + 1) / (rounds + 1)).alias("p"))


#: Pairs of a read end and a region that one task of ``end_pileup`` should make, and rows of a batch it gives out.
PILEUP_PAIRS, PILEUP_ROWS = 4_000_000, 200_000


def _piled(rounds: int, schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function over rows sorted by (_cell, _shard, _side): the read ends of a cell, then its regions."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at, ends = None, None
        out, rows = [], 0
        for b in batches:
            num = {c: b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("_cell", "_shard", "_side", "_a", "_b", "_h")}
            known = b.column("_b").is_valid().to_numpy(zero_copy_only=False)
            marks = np.stack([num["_cell"], num["_shard"], num["_side"]])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                if at != (cell := (int(marks[0, lo]), int(marks[1, lo]))):
                    at, held, ends = cell, [], None
                if num["_side"][lo] == 0:
                    held.append(tuple(x[lo:hi] for x in (num["_a"], num["_b"], known)))
                    continue
                if ends is None:
                    pos, ids, real = (np.concatenate(x) for x in zip(*held)) if held else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
                    by = np.argsort(pos, kind="stable")
                    ends, held = (*np.unique(pos[by], return_index=True, return_counts=True), ids[by].view(np.uint64), real[by], len(pos)), []
                places, first, counts, ids, real, total = ends
                s, e, h = num["_a"][lo:hi], num["_b"][lo:hi], num["_h"][lo:hi].view(np.uint64)
                for i, (p, q) in enumerate(zip(np.searchsorted(places, s).tolist(), np.searchsorted(places, e).tolist())):
                    if p == q:
                        continue
                    n = counts[p:q]
                    if (n == 1).all():  # every shuffle has a place with one end
                        share = np.ones(q - p)
                    else:
                        x, y = first[p], first[q] if q < len(first) else total
                        with np.errstate(over="ignore"):
                            drawn = K.xxhash64_long(ids[x:y], h[i])
                        tops = np.sort(K.fullest_places(drawn if real[x:y].all() else np.where(real[x:y], drawn, h[i]), int(e[i] - s[i]), rounds))
                        share = (rounds - np.searchsorted(tops, n) + 1) / (rounds + 1)
                    out.append((b.column("_k").slice(lo + i, 1), places[p:q], n, share))
                    rows += q - p
                    if rows >= PILEUP_ROWS:
                        yield give(out)
                        out, rows = [], 0
        yield give(out)

    def give(out: list[tuple]) -> pa.RecordBatch:
        keys, *cols = zip(*out) if out else ((), (), (), ())
        many = np.repeat(np.arange(len(keys)), [len(x) for x in cols[0]])
        key = pa.concat_arrays(keys).take(pa.array(many)) if out else pa.array([], arrow.field(0).type)
        return pa.RecordBatch.from_arrays([key.cast(arrow.field(0).type), *(pa.array(np.concatenate(x) if out else [], f.type) for x, f in zip(cols, list(arrow)[1:]))], schema=arrow)

    return run


def end_pileup(reads: DataFrame, regions: DataFrame, key: str, rounds: int, seed: int) -> DataFrame:
    """(key, pos, n, p): 5' read ends at every place of each region, and how often the fullest place of a shuffle has as many.

    In a shuffle every read end of a region goes to a place of it drawn by a hash of (seed, key, read, round).
    ``reads`` has a unique rec_id; places without ends are left out.  A key of several regions pools their ends.

    No pair of a read end and a region is written: both are filed by the stretch of the genome (cell) in which the region
    starts, cells with many pairs are dealt out by region, and the draws are made region by region in a task's memory.
    """
    tip = F.when(F.col("strand") == "-", F.col("end_pos") - 1).otherwise(F.col("start_pos")).cast("long")
    whole = reads.schema["rec_id"].dataType.typeName() in ("long", "integer", "short", "byte")
    rec = F.col("rec_id").cast("long") if whole else F.xxhash64("rec_id")
    ends = reads.filter(F.col("chrom").isNotNull() & (F.col("end_pos") > F.col("start_pos"))).select(rec.alias("rec_id"), "chrom", tip.alias("start_pos"))
    good = regions.filter(F.col("chrom").isNotNull() & (F.col("end_pos") > F.col("start_pos")) & F.col(key).isNotNull())
    place = F.struct("chrom", F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"))
    kept = stage(good.select(F.col(key).alias("_k"), place.alias("_at")).groupBy("_k").agg(F.collect_list("_at").alias("_at")).select("_k", F.size("_at").alias("_times"), F.inline("_at")), "regions")
    out = _pileup_by_cell(ends, kept.filter("_times = 1").drop("_times"), rounds, seed)
    pooled = kept.filter("_times > 1").drop("_times")
    if not pooled.isEmpty():
        out = out.unionByName(_pileup_by_key(ends, pooled, rounds, seed))
    return out.withColumnRenamed("_k", key)


def _pileup_by_cell(ends: DataFrame, regions: DataFrame, rounds: int, seed: int) -> DataFrame:
    """``end_pileup`` of keys with one region."""
    spark = regions.sparkSession
    width = F.col("end_pos") - F.col("start_pos")
    bits = lambda level: F.element_at(F.array(*[F.lit(b) for b in LEVEL_BITS]), level + 1)
    filed = regions.withColumn("_lvl", _level(width)).withColumn("_blk", F.call_function("shiftright", "start_pos", bits(F.col("_lvl"))))
    cells = stage(filed.groupBy("chrom", "_lvl", "_blk").agg(F.count("*").alias("_regions"), F.sum(width).alias("_bases")).withColumn("_cell", F.monotonically_increasing_id()), "cells")
    levels = sorted(r["_lvl"] for r in cells.select("_lvl").distinct().collect())
    # A region is no longer than a block of its level, so it ends in the block it starts in or in the next one.
    at = [F.struct(F.lit(x).alias("_lvl"), (F.shiftright("start_pos", LEVEL_BITS[x]) - back).alias("_blk")) for x in levels or [0] for back in (0, 1)]
    cell = ["chrom", "_lvl", "_blk"]
    near = stage(ends.select("*", F.inline(F.array(*at))).join(bounded_broadcast(cells.select(*cell, "_cell"), of=cells), cell).select("_cell", F.col("start_pos").alias("_a"), F.col("rec_id").alias("_b")), "ends")
    # Pairs as if ends and regions lay evenly; a share of a cell has at least 64 regions, so ends are not repeated without need.
    pairs = F.col("_n") * F.col("_bases") / F.pow(F.lit(2.0), bits(F.col("_lvl")) + 1)
    shares = F.greatest(F.lit(1), F.least(F.ceil(pairs / PILEUP_PAIRS), F.ceil(F.col("_regions") / 64))).cast("int")
    work = stage(near.groupBy("_cell").agg(F.count("*").alias("_n")).join(cells, "_cell").select(*cell, "_cell", shares.alias("_shares"), pairs.alias("_pairs")), "work")
    tasks = min(10_000, max(parallelism(spark), int((work.agg(F.sum("_pairs")).first()[0] or 0) / PILEUP_PAIRS)))
    kind = regions.schema["_k"].dataType
    sent = near.join(bounded_broadcast(work.select("_cell", "_shares"), of=work), "_cell")
    sent = sent.select("_cell", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_shard"), F.lit(0).alias("_side"), "_a", "_b", F.lit(None).cast("long").alias("_h"), F.lit(None).cast(kind).alias("_k"))
    asked = filed.join(bounded_broadcast(work.select(*cell, "_cell", "_shares"), of=work), cell)
    asked = asked.select("_cell", F.pmod(F.xxhash64("_k"), F.col("_shares")).cast("int").alias("_shard"), F.lit(1).alias("_side"), F.col("start_pos").alias("_a"), F.col("end_pos").alias("_b"), F.xxhash64(F.lit(seed), "_k").alias("_h"), "_k")
    schema = StructType([StructField("_k", kind), StructField("pos", LongType()), StructField("n", LongType()), StructField("p", DoubleType())])
    return sent.unionByName(asked).repartition(tasks, "_cell", "_shard").sortWithinPartitions("_cell", "_shard", "_side").mapInArrow(_piled(rounds, schema), schema)


def _pileup_by_key(ends: DataFrame, regions: DataFrame, rounds: int, seed: int) -> DataFrame:
    """``end_pileup`` of keys with several regions, through the pairs of ends and regions."""
    ends = ends.withColumn("end_pos", F.col("start_pos") + 1)
    hit = stage(overlap_join(ends, regions, "inner").select("rec_id", F.col("_k_r").alias("_k"), F.col("start_pos").alias("pos"), F.col("start_pos_r").alias("_s"), F.col("end_pos_r").alias("_e")), "ends")
    seen = hit.groupBy("_k", "pos").agg(F.count("*").alias("n"))
    drawn = hit.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_at", F.pmod(F.xxhash64(F.lit(seed), "_k", "rec_id", "_round"), F.col("_e") - F.col("_s")))
    top = drawn.groupBy("_k", "_round", "_at").agg(F.count("*").alias("m")).groupBy("_k", "_round").agg(F.max("m").alias("m"))
    tops = top.groupBy("_k").agg(F.collect_list("m").alias("_tops"))  # one number a round
    return seen.join(tops, "_k").select("_k", "pos", "n", ((F.size(F.filter("_tops", lambda m: m >= F.col("n"))) + 1) / (rounds + 1)).alias("p"))


def skellam_divergence_peaks(sample: DataFrame, control: DataFrame, sizes: DataFrame, size: int, overlap: int, alpha: float, bins: int = 10) -> DataFrame:
    """(chrom, start_pos, end_pos, windows, best_p, divergence): windows above the sample's own rate with a Skellam p below ``alpha``, merged.

    ``divergence`` is the Kullback-Leibler divergence, in bits, of the places of the sample's reads over
    ``bins`` equal parts of the merged region from those of the control's, one pseudo-read a part.
    """
    w = S.two_sample_windows(sample, control, sizes, size, overlap)
    hit = stage(w.filter((F.col("a") >= F.col("la") * size) & (F.col("skellam_p") < alpha)).select("chrom", "start_pos", "end_pos", F.col("skellam_p").alias("p")), "hits")
    m = stage(setops.merged(hit), "regions")
    best = overlap_join(hit, m, "inner", contained="left").groupBy("chrom", F.col("start_pos_r").alias("start_pos"), F.col("end_pos_r").alias("end_pos")).agg(F.count("*").alias("windows"), F.min("p").alias("best_p"))
    place = ["chrom", "start_pos", "end_pos"]

    def parts(reads: DataFrame, name: str) -> DataFrame:
        starts = reads.select("chrom", "start_pos").withColumn("end_pos", F.col("start_pos") + 1)
        j = overlap_join(starts, m, "inner")
        part = F.floor((F.col("start_pos") - F.col("start_pos_r")) * bins / (F.col("end_pos_r") - F.col("start_pos_r"))).cast("int")
        return j.groupBy("chrom", F.col("start_pos_r").alias("start_pos"), F.col("end_pos_r").alias("end_pos"), part.alias("_part")).agg(F.count("*").alias(name))

    grid = m.select(*place, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("_part"))
    j = grid.join(parts(sample, "_x"), [*place, "_part"], "left").join(parts(control, "_y"), [*place, "_part"], "left").fillna(0, ["_x", "_y"])
    t = j.groupBy(*place).agg(F.sum(F.col("_x") + 1).alias("_tx"), F.sum(F.col("_y") + 1).alias("_ty"))
    px, py = (F.col("_x") + 1) / F.col("_tx"), (F.col("_y") + 1) / F.col("_ty")
    kl = j.join(t, place).groupBy(*place).agg(F.sum(px * F.log2(px / py)).alias("divergence"))
    return best.join(kl, place)
