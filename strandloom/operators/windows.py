"""Windows over coordinate spaces, and counts of intervals in them.

Windows on a genome are arithmetic: an interval knows the numbers of the windows it
overlaps, so counting is an explode and one aggregation on (chromosome, window), with
map-side combine and no join with the window list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions import blocks as B
from strandloom.operators import setops
from strandloom.operators.join import overlap_join
from strandloom.operators.ordered import Ordered
from strandloom.session import bounded_broadcast, stage, table_broadcast

PLACES = 1_000_000


def _step(size: int, overlap: int) -> int:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the window size")
    return size - overlap


def tile(sizes: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """(chrom, start_pos, end_pos): all whole windows of every chromosome; a partial last one is dropped."""
    step = _step(size, overlap)
    ok = sizes.filter(F.col("length") >= size)
    return ok.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - size, F.lit(step).cast("long"))).alias("start_pos")).withColumn("end_pos", F.col("start_pos") + size)


def _hit_windows(s: Column, e: Column, size: int, step: int) -> Column:
    """array<bigint>: numbers of the windows [i * step, i * step + size) that [s, e) overlaps, from 0 on."""
    lo = F.greatest(F.floor((s - size) / step) + 1, F.lit(0)).cast("long")
    hi = F.floor((e - 1) / step).cast("long")
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def scan(df: DataFrame, sizes: DataFrame, size: int, overlap: int, aggs: list[Column]) -> DataFrame:
    """(chrom, start_pos, end_pos, aggregates): windows that an interval of ``df`` overlaps.

    Aggregates see the columns of ``df`` as ``r_<name>`` and the window's ``start_pos`` and ``end_pos``.
    Windows without intervals are left out (``scan_all`` keeps them); chromosomes not in
    ``sizes`` too.
    """
    step = _step(size, overlap)
    ok = df.filter(F.col("chrom").isNotNull() & (F.col("end_pos") > F.col("start_pos")))
    r = ok.select(F.col("chrom"), *[F.col(c).alias(f"r_{c}") for c in ok.columns if c != "chrom"])
    hit = r.select("*", F.explode(_hit_windows(F.col("r_start_pos"), F.col("r_end_pos"), size, step)).alias("_w"))
    hit = hit.withColumn("start_pos", F.col("_w") * step).withColumn("end_pos", F.col("_w") * step + size)
    inside = hit.join(table_broadcast(sizes.select("chrom", "length")), "chrom").filter(F.col("end_pos") <= F.col("length"))
    return inside.groupBy("chrom", "start_pos", "end_pos").agg(*aggs)


def scan_all(df: DataFrame, sizes: DataFrame, size: int, overlap: int, aggs: list[Column]) -> DataFrame:
    """``scan`` with a row for every window; aggregates of empty windows are null."""
    return tile(sizes, size, overlap).join(scan(df, sizes, size, overlap, aggs), ["chrom", "start_pos", "end_pos"], "left")


def masked_windows(sizes: DataFrame, masks: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """(chrom, window, blocks): windows of ``size`` unmasked bases; a window may be several blocks.

    A running sum gives every free stretch its place among the free bases of its chromosome,
    and there windows are arithmetic: no task sees more than the stretches of one window.
    """
    step = _step(size, overlap)
    free = setops.complement(masks, sizes).withColumn("_len", F.col("end_pos") - F.col("start_pos"))
    run = Ordered(free, ["chrom"], ["start_pos"]).running({"_upto": ("sum", F.col("_len"))}).withColumn("_off", F.col("_upto") - F.col("_len"))
    run = stage(run, "free")
    total = run.groupBy("chrom").agg(F.max("_upto").alias("_total"))
    hit = run.select("*", F.explode(_hit_windows(F.col("_off"), F.col("_upto"), size, step)).alias("_w")).withColumn("window", F.col("_w") * step)
    whole = hit.join(bounded_broadcast(total), "chrom").filter(F.col("window") + size <= F.col("_total"))
    s = F.col("start_pos") + F.greatest(F.col("window") - F.col("_off"), F.lit(0))
    e = F.col("start_pos") + F.least(F.col("window") + size - F.col("_off"), F.col("_len"))
    return whole.select("chrom", "window", B.block(s, e).alias("_b")).groupBy("chrom", "window").agg(F.array_sort(F.collect_list("_b")).alias("blocks"))


def unmasked(windows: DataFrame, masks: DataFrame, most: float) -> DataFrame:
    """Windows of which at most the share ``most`` is masked (0: no mask may touch them)."""
    cover = setops.merged(masks, touching=True)
    keys = ["chrom", "start_pos", "end_pos"]
    hit = overlap_join(windows, cover, "inner")
    share = F.sum(F.least("end_pos", "end_pos_r") - F.greatest("start_pos", "start_pos_r")) / (F.col("end_pos") - F.col("start_pos"))
    bad = hit.groupBy(*keys).agg(share.alias("_masked")).filter(F.col("_masked") > most)
    return windows.join(bad, keys, "left_anti")


def clip_to_chrom(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """Intervals cut to their chromosome; those wholly outside are dropped, unknown chromosomes pass."""
    j = df.join(table_broadcast(sizes.select("chrom", F.col("length").alias("_len"))), "chrom", "left")
    j = j.withColumn("start_pos", F.greatest("start_pos", F.lit(0))).withColumn("end_pos", F.when(F.col("_len").isNull(), F.col("end_pos")).otherwise(F.least("end_pos", "_len")))
    return j.filter(F.col("start_pos") < F.col("end_pos")).drop("_len")


def draw_starts(start: np.ndarray, end: np.ndarray, span: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A start for every span within one of the free stretches, and which have one; each possible start is as likely as any other.

    With the stretches longest first, those long enough for a span are the first ``k``, and the
    number of starts in the first ``i`` of them, their length less i (span - 1), grows with i: ``draw`` modulo
    the number of all starts is looked up by bisection.
    """
    order = np.lexsort((start, start - end))
    start, length = start[order], (end - start)[order]
    total = np.concatenate([[0], np.cumsum(length)])
    k = np.searchsorted(-length, -span, side="right")
    starts = lambda i: total[i] - i * (span - 1)
    room = starts(k)
    p = np.mod(draw, np.maximum(room, 1))
    lo, hi = np.zeros(len(span), dtype=np.int64), k.astype(np.int64)
    while (lo < hi).any():  # the first stretch whose starts, with those before, are more than p
        mid = (lo + hi) // 2
        over = starts(np.minimum(mid + 1, len(length))) > p
        hi, lo = np.where((lo < hi) & over, mid, hi), np.where((lo < hi) & ~over, mid + 1, lo)
    fits = (k > 0) & (span >= 0)
    at = np.where(fits, lo, 0)
    return (start[at] + p - starts(at) if len(start) else np.zeros(len(span), dtype=np.int64)), fits


def place_in_free(df: DataFrame, free: DataFrame, span: Column, draw: Column) -> DataFrame:
    """``df`` (chrom) with ``_to``, a start drawn by the hash ``draw`` among all of ``free`` (chrom, start_pos, end_pos) where ``span`` bases fit; null if no stretch is long enough."""
    keyed = df.withColumn("_span", span.cast("long")).withColumn("_draw", draw)
    want = keyed.select("chrom", "_span", "_draw").filter(F.col("chrom").isNotNull() & F.col("_span").isNotNull()).distinct()
    want = stage(want, "places")
    parts = 1 + want.count() // PLACES
    gaps = free.filter(F.col("end_pos") > F.col("start_pos")).select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("_part"), F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        to, fits = draw_starts(*(y.column(c).to_numpy() for c in ("start_pos", "end_pos")), *(x.column(c).to_numpy() for c in ("_span", "_draw")))
        return x.drop_columns(["_part"]).append_column("_to", pa.array(to, mask=~fits))

    split = want.withColumn("_part", F.pmod("_draw", F.lit(parts).cast("long")))
    placed = split.groupBy("chrom", "_part").cogroup(gaps.groupBy("chrom", "_part")).applyInArrow(run, "chrom string, _span long, _draw long, _to long")
    return keyed.join(placed, ["chrom", "_span", "_draw"], "left").drop("_span", "_draw")


def relocate(df: DataFrame, sizes: DataFrame, key: str, seed: int, rounds: int = 1, masks: DataFrame | None = None) -> DataFrame:
    """``df`` with every interval moved to a place fixed by (seed, key, round); ``permutation`` counts rounds from 1.

    A place lies on the chromosome and, if ``masks`` are given, touches none; every such
    place is as likely as any other.  Only if there is none the bounds are null.  The input is never changed.
    """
    j = df.join(table_broadcast(sizes.select("chrom", F.col("length").alias("_len"))), "chrom").withColumn("permutation", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    span = F.col("end_pos") - F.col("start_pos")
    draw = F.xxhash64(F.lit(seed), F.col(key), F.col("permutation"), F.lit(0))
    if masks is None:
        to = F.when(F.col("_len") >= span, F.pmod(draw, F.greatest(F.col("_len") - span + 1, F.lit(1))))
        out = j.withColumn("_to", to)
    else:
        on = masks.join(table_broadcast(sizes.select("chrom", F.col("length").alias("_len"))), "chrom").filter((F.col("start_pos") < F.col("_len")) & (F.col("end_pos") > 0))
        out = place_in_free(j, setops.complement(on, sizes), span, draw).select(*j.columns, "_to")
    return out.withColumn("end_pos", F.col("_to") + span).withColumn("start_pos", F.col("_to")).drop("_to", "_len")


def rolling_environment(df: DataFrame, value: str, half: int = 5000) -> DataFrame:
    """``env``: sum of value x length over the stretch within ``half`` bases of each row's start, cut at the edges.

    The sum up to a place x is x times the sum of the values that begin or end (negative) before it,
    less the sum of these values times their places; so ``env`` is a difference of two running sums.
    Rows without bases or with a null value add nothing; a row with a null chromosome or start has no ``env`` and is left out.
    """
    rows = stage(df.filter(F.col("chrom").isNotNull() & F.col("start_pos").isNotNull()).withColumn("_row", F.monotonically_increasing_id()), "focus")
    none = F.lit(None).cast("long")
    whole = isinstance(df.schema[value].dataType, T.IntegralType)
    v = F.col(value).cast("long" if whole else "double")
    mark = lambda pos, sign: F.struct(F.col(pos).cast("long").alias("pos"), F.lit(0).alias("side"), (v * F.lit(sign)).alias("v"), none.alias("_row"), F.lit(0).alias("sign"))
    ask = lambda pos, sign: F.struct(pos.cast("long").alias("pos"), F.lit(1).alias("side"), F.lit(0).cast("long" if whole else "double").alias("v"), F.col("_row"), F.lit(sign).alias("sign"))
    ok = rows.filter((F.col("end_pos") > F.col("start_pos")) & v.isNotNull())
    steps = ok.select("chrom", F.inline(F.array(mark("start_pos", 1), mark("end_pos", -1)))).groupBy("chrom", "pos", "side", "_row", "sign").agg(F.sum("v").alias("v"))
    asked = rows.select("chrom", F.inline(F.array(ask(F.greatest(F.col("start_pos") - half, F.lit(0)), -1), ask(F.col("start_pos") + half, 1))))
    run = Ordered(steps.unionByName(asked), ["chrom"], ["pos", "side"]).running({"_a": ("sum", F.col("v")), "_b": ("sum", F.col("v") * F.col("pos"))})
    part = run.filter(F.col("_row").isNotNull()).groupBy("_row").agg(F.sum(F.col("sign") * (F.col("_a") * F.col("pos") - F.col("_b"))).alias("env"))
    return rows.join(part, "_row").select(*df.columns, "env")
