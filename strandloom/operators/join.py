"""Interval joins.

Overlap joins are equi joins on (chromosome, level, bin).  An interval belongs to the
level whose bins are at least as long as itself, so it touches at most two bins there,
and it is also filed in the one or two bins it touches of every coarser level that
occurs.  A pair meets once, at the coarser of its two levels, in the bin that holds
the greater start.  Very long intervals thus cost no more bins than short ones, and
the plan is an ordinary shuffle (or, for small sides, broadcast) hash join that
adaptive execution can split on skew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import bounded_broadcast, stage

# Bin widths of the levels: 2^10, 2^13, ... bases.
LEVEL_BITS = [10, 13, 16, 19, 22, 25, 28, 31, 40, 62]


@dataclass(frozen=True)
class Names:
    """Column names of an interval table."""

    chrom: str = "chrom"
    start: str = "start_pos"
    end: str = "end_pos"
    strand: str = "strand"


DEFAULT = Names()


def _level(n: Column) -> Column:
    out = F.lit(len(LEVEL_BITS) - 1)
    for i in reversed(range(len(LEVEL_BITS) - 1)):
        out = F.when(n <= (1 << LEVEL_BITS[i]), i).otherwise(out)
    return out


def _levels_of(*sides: tuple[DataFrame, Column]) -> list[int]:
    """Levels of the lengths of all sides: one bit each in one number, so one job without a shuffle of rows."""
    bits = None
    for df, length in sides:
        b = df.select(F.call_function("shiftleft", F.lit(1), _level(length)).alias("l"))
        bits = b if bits is None else bits.union(b)
    found = bits.agg(F.bit_or("l")).first()[0] or 0
    return [i for i in range(len(LEVEL_BITS)) if found >> i & 1]


def _bins(df: DataFrame, s: Column, e: Column, own: Column, levels: list[int]) -> DataFrame:
    """One row per (level, bin) in which an interval [s, e) is filed."""
    def at(level: int) -> Column:
        bits = LEVEL_BITS[level]
        bins = F.sequence(F.shiftright(s, bits), F.shiftright(F.greatest(e - 1, s), bits))
        filed = F.transform(bins, lambda b: F.struct(F.lit(level).alias("_lvl"), b.alias("_bin")))
        return F.when(F.lit(level) >= own, filed).otherwise(F.array().cast("array<struct<_lvl:int,_bin:bigint>>"))

    per = [at(x) for x in levels]
    if not per:
        return df.withColumn("_lvl", F.lit(0)).withColumn("_bin", F.lit(0).cast("long"))
    return df.select("*", F.inline(F.concat(*per)))


def _valid(df: DataFrame, n: Names) -> DataFrame:
    return df.filter(F.col(n.chrom).isNotNull() & (F.col(n.end) > F.col(n.start)))


def overlap_join(
    left: DataFrame, right: DataFrame, how: str = "inner", left_names: Names = DEFAULT, right_names: Names = DEFAULT,
    strand: bool = False, contained: str | None = None, slack: int = 0, residual: Column | None = None, suffix: str = "_r",
) -> DataFrame:
    """Join rows whose intervals share a base (half-open: touching ends don't).

    ``how``: ``inner``, ``left``, ``left_semi``, ``left_anti``.  ``strand`` also asks for equal
    strands.  ``contained='left'`` keeps pairs with the left interval inside the right
    one, ``'right'`` the converse.  ``slack`` widens the right side by so many bases on both
    ends for the test.  ``residual`` is a further condition on the columns of the result.

    A plain ``left_semi`` or ``left_anti`` makes no pairs: the right side is merged into islands, and
    the last island that starts before a row's end decides.

    All right columns come out with ``suffix``.  Rows with a null chromosome, a null bound or
    no length match nothing (kept by ``left`` and ``left_anti``); repeated rows keep their
    multiplicity; null strands match nothing when ``strand`` is asked.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    ln = left_names
    if how in ("left_semi", "left_anti") and contained is None and residual is None:
        return _touching(left, right, how == "left_semi", ln, right_names, strand, slack)
    r = right.toDF(*[c + suffix for c in right.columns])
    rn = Names(*[x + suffix for x in (right_names.chrom, right_names.start, right_names.end, right_names.strand)])
    keyed = left if how == "inner" else left.withColumn("_row", F.monotonically_increasing_id())
    if how != "inner":
        keyed = stage(keyed, "left")  # the row number must be the same wherever it is read
    lv, rv = _valid(keyed, ln), _valid(r, rn)
    levels = _levels_of((lv, F.col(ln.end) - F.col(ln.start)), (rv, F.col(rn.end) - F.col(rn.start) + 2 * slack))
    ls, le = F.col(ln.start).cast("long"), F.col(ln.end).cast("long")
    rs, re = (F.col(rn.start) - slack).cast("long"), (F.col(rn.end) + slack).cast("long")
    lb = _bins(lv.withColumn("_lown", _level(le - ls)), ls, le, F.col("_lown"), levels)
    rb = _bins(rv.withColumn("_rown", _level(re - rs)), rs, re, F.col("_rown"), levels).withColumnsRenamed({"_lvl": "_lvl_r", "_bin": "_bin_r"})
    bits = F.element_at(F.array(*[F.lit(b) for b in LEVEL_BITS]), F.col("_lvl") + 1)
    cond = (F.col(ln.chrom) == F.col(rn.chrom)) & (F.col("_lvl") == F.col("_lvl_r")) & (F.col("_bin") == F.col("_bin_r"))
    cond &= (F.col("_lvl") == F.greatest("_lown", "_rown")) & (ls < re) & (rs < le)
    cond &= F.call_function("shiftright", F.greatest(ls, rs), bits) == F.col("_bin")
    if strand:
        cond &= F.col(ln.strand) == F.col(rn.strand)
    if contained == "left":
        cond &= (ls >= rs) & (le <= re)
    elif contained == "right":
        cond &= (rs >= ls) & (re <= le)
    pairs = lb.join(rb, cond)
    if residual is not None:
        pairs = pairs.filter(residual)
    if how == "inner":
        return pairs.select(*left.columns, *r.columns)
    if how == "left":
        hits = pairs.select("_row", *r.columns)
        return keyed.join(hits, "_row", "left").select(*left.columns, *r.columns)
    hits = pairs.select("_row").distinct()
    return keyed.join(hits, "_row", how).select(*left.columns)


def _touching(left: DataFrame, right: DataFrame, wanted: bool, ln: Names, rn: Names, strand: bool, slack: int) -> DataFrame:
    """Rows of ``left`` that overlap (``wanted``) or don't overlap any row of ``right``."""
    from strandloom.operators import setops

    key = lambda n: F.struct(*[F.col(c).alias(a) for c, a in ((n.chrom, "c"), *(((n.strand, "s"),) if strand else ()))])
    by = ["_c", *(["_s"] if strand else [])]
    cols = [F.col(rn.chrom).alias("_c"), *([F.col(rn.strand).alias("_s")] if strand else [])]
    r = _valid(right, rn).select(*cols, (F.col(rn.start) - slack).cast("long").alias("start_pos"), (F.col(rn.end) + slack).cast("long").alias("end_pos"))
    islands = setops.merged(r, by)
    row = F.struct(*[F.col(c) for c in left.columns])
    good = F.col(ln.chrom).isNotNull() & (F.col(ln.end) > F.col(ln.start)) & (F.col(ln.strand).isNotNull() if strand else F.lit(True))
    asked = left.filter(good).select(key(ln).alias("_chrom"), F.col(ln.end).cast("long").alias("_pos"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_v"), F.col(ln.start).cast("long").alias("_from"), row.alias("_left"))
    marks = islands.select(key(Names("_c", strand="_s")).alias("_chrom"), F.col("start_pos").alias("_pos"), F.lit(1).alias("_side"), F.col("end_pos").alias("_v"), F.lit(None).cast("long").alias("_from"), F.lit(None).cast(asked.schema["_left"].dataType).alias("_left"))
    # An island that starts at a row's end doesn't touch it: rows come before islands at one place.
    near = _carried(asked.unionByName(marks), ["_pos", "_side"], {"_near": ("_v", False)}).filter("_side = 0")
    hit = F.coalesce(F.col("_near") > F.col("_from"), F.lit(False))
    if wanted:
        return near.filter(hit).select("_left.*")
    return near.filter(~hit).select("_left.*").unionByName(left.filter(~F.coalesce(good, F.lit(False))))


def count_overlaps(left: DataFrame, right: DataFrame, keys: list[str], aggs: list[Column], **kw) -> DataFrame:
    """Aggregates over the overlapping right rows (columns suffixed ``_r``) per left row identified by ``keys``.

    Left rows that overlap nothing are kept; their counts are 0 where the aggregate
    counts, null elsewhere.  ``keys`` must identify rows.
    """
    hits = overlap_join(left, right, "inner", **kw).groupBy(*keys).agg(*aggs)
    return left.join(hits, keys, "left")


def _carried(df: DataFrame, order: list[str], what: dict[str, tuple[str, bool]]) -> DataFrame:
    """For each name of ``what`` (value, backward): the last (or next) non-null value up to each row of its chromosome, rows ordered by ``order``.

    Computed in two levels over one range partitioning, so a chromosome may be of any size:
    inside (partition, chromosome), and over the last or first values of partitions.
    """
    staged = stage(df.repartitionByRange("_chrom", *order).withColumn("_pid", F.spark_partition_id()), "asof")
    inner = {b: Window.partitionBy("_pid", "_chrom").orderBy(*[F.col(c).desc() if b else F.col(c).asc() for c in order]).rowsBetween(Window.unboundedPreceding, 0) for b in (False, True)}
    outer = {b: Window.partitionBy("_chrom").orderBy(F.col("_pid").desc() if b else F.col("_pid").asc()).rowsBetween(Window.unboundedPreceding, -1) for b in (False, True)}
    local = staged.select("*", *[F.last(v, ignorenulls=True).over(inner[b]).alias(f"_l{n}") for n, (v, b) in what.items()])
    at = F.struct(*order)
    ends = staged.groupBy("_chrom", "_pid").agg(*[(F.min_by if b else F.max_by)(v, F.when(F.col(v).isNotNull(), at)).alias(f"_e{n}") for n, (v, b) in what.items()])
    carry = ends.select("_chrom", "_pid", *[F.last(f"_e{n}", ignorenulls=True).over(outer[b]).alias(f"_c{n}") for n, (_, b) in what.items()])
    j = local.join(bounded_broadcast(carry), ["_chrom", "_pid"])
    return j.select(*df.columns, *[F.coalesce(f"_l{n}", f"_c{n}").alias(n) for n in what])


def nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, left_names: Names = DEFAULT, right_names: Names = DEFAULT, side: str = "both") -> DataFrame:
    """(key, right_key, distance): for every left row the right row with the least gap on its chromosome.

    Overlapping rows are at distance 0 (the one with the least start, then end, then
    key); otherwise the nearer of the row ending last before and the row starting
    first after, ties going to the previous one.  ``side='upstream'`` / ``'downstream'`` takes
    only rows that lie wholly before / after along the left row's strand.  Left rows
    without any candidate are left out.  Keys must be unique.

    One sweep finds all three: the last end, the next start, and the next end among the right
    rows that end later than all rows before them, for of the rows that end after a place the
    one of least start is always such a row.
    """
    ln, rn = left_names, right_names
    lv = _valid(left, ln).select(F.col(key).alias("_k"), F.col(ln.chrom).alias("_chrom"), F.col(ln.start).cast("long").alias("_s"), F.col(ln.end).cast("long").alias("_e"), *([F.col(ln.strand).alias("_st")] if side != "both" else []))
    rv = _valid(right, rn).select(F.col(right_key).alias("_rk"), F.col(rn.chrom).alias("_chrom"), F.col(rn.start).cast("long").alias("_rs"), F.col(rn.end).cast("long").alias("_re"))
    place = F.struct(F.col("_rs").alias("s"), F.col("_re").alias("e"), F.col("_rk").alias("k"))
    kt = dict(lv.dtypes)["_k"]
    vt = rv.select(place.alias("v")).schema["v"].dataType

    def events(df, pos, side_no, k=None, **values):
        return df.select("_chrom", F.col(pos).alias("_pos"), F.lit(side_no).alias("_side"), (F.col(k) if k else F.lit(None)).cast(kt).alias("_k"), *[values.get(n, F.lit(None)).cast(vt).alias(n) for n in ("_end", "_start", "_reach")])

    ev = events(lv, "_s", 1, "_k").unionByName(events(lv, "_e", 2, "_k"))
    ends = rv.groupBy("_chrom", "_re").agg(F.min_by(place, "_rk").alias("_p"))
    starts = rv.groupBy("_chrom", "_rs").agg(F.min_by(place, "_rk").alias("_p"))
    ev = ev.unionByName(events(ends, "_re", 0, _end=F.col("_p"))).unionByName(events(starts, "_rs", 3, _start=F.col("_p")))
    what = {"_prev": ("_end", False), "_next": ("_start", True)}
    if side == "both":
        from strandloom.operators.ordered import Ordered

        top = Ordered(rv, ["_chrom"], ["_rs", "_re", "_rk"]).running({"_m": ("max", F.struct(F.col("_re").alias("e"), (-F.col("_rs")).alias("s")))})
        # Reached first by this row: of rows with one end, the one of least start (and then key) counts.
        first = top.filter((F.col("_m.e") == F.col("_re")) & (F.col("_m.s") == -F.col("_rs"))).groupBy("_chrom", "_re").agg(F.min_by(place, F.struct("_rs", "_rk")).alias("_p"))
        ev = ev.unionByName(events(first, "_re", 0, _reach=F.col("_p")))
        what["_over"] = ("_reach", True)
    got = _carried(ev, ["_pos", "_side"], what).filter(F.col("_k").isNotNull())
    on_s = F.col("_side") == 1
    per = got.groupBy("_k").agg(F.max(F.when(on_s, F.col("_prev"))).alias("_p"), F.max(F.when(~on_s, F.col("_next"))).alias("_n"), *([F.max(F.when(on_s, F.col("_over"))).alias("_o")] if side == "both" else []))
    j = lv.join(per, "_k")
    dp, dn = F.col("_s") - F.col("_p.e"), F.col("_n.s") - F.col("_e")
    if side == "both":
        over = F.coalesce(F.col("_o.s") < F.col("_e"), F.lit(False))
        take_prev = dn.isNull() | (dp <= dn)
        near = F.when(over, F.col("_o.k")).when(take_prev & dp.isNotNull(), F.col("_p.k")).otherwise(F.col("_n.k"))
        dist = F.when(over, F.lit(0).cast("long")).otherwise(F.least(dp, dn))
    else:
        before = (F.col("_st") == "-") if side == "downstream" else (F.coalesce(F.col("_st"), F.lit("*")) != "-")
        near, dist = F.when(before, F.col("_p.k")).otherwise(F.col("_n.k")), F.when(before, dp).otherwise(dn)
    return j.select(F.col("_k").alias(key), near.alias(f"{right_key}_near" if right_key == key else right_key), dist.alias("distance")).filter(F.col("distance").isNotNull())


def largest_parent(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, strand: bool = False) -> DataFrame:
    """(child_key, parent): the longest parent that contains each child; ties go to the least key."""
    hits = overlap_join(children, parents, "inner", contained="left", strand=strand)
    size = F.col("end_pos_r") - F.col("start_pos_r")
    return hits.groupBy(child_key).agg(F.min_by(f"{parent_key}_r", F.struct((-size).alias("s"), F.col(f"{parent_key}_r").alias("k"))).alias("parent"))


def mate_pairs(reads: DataFrame) -> DataFrame:
    """First and second mates of one fragment, joined on name and cross-matching places.

    Both mates must be mapped, point at each other's place and strand, and neither may be
    secondary or supplementary.
    """
    base = reads.filter(F.col("chrom").isNotNull() & (F.col("flag").bitwiseAND(4 | 8 | 256 | 2048) == 0) & (F.col("flag").bitwiseAND(1) != 0))
    name = F.regexp_replace("name", "/[12]$", "")
    side = lambda bit, p: base.filter(F.col("flag").bitwiseAND(bit) != 0).select(
        name.alias("name"), F.col("rec_id").alias(f"{p}id"), F.col("chrom").alias(f"{p}chrom"), F.col("pos").alias(f"{p}pos"), F.col("mate_chrom").alias(f"{p}mc"), F.col("mate_pos").alias(f"{p}mp"),
        F.col("flag").alias(f"{p}flag"), F.col("start_pos").alias(f"{p}s"), F.col("end_pos").alias(f"{p}e"),
    )
    a, b = side(64, "a_"), side(128, "b_")
    rev = lambda f: F.col(f).bitwiseAND(16) != 0
    mrev = lambda f: F.col(f).bitwiseAND(32) != 0
    keys = (a["name"] == b["name"]) & (a["a_chrom"] == b["b_mc"]) & (a["a_mc"] == b["b_chrom"]) & (a["a_pos"] == b["b_mp"]) & (a["a_mp"] == b["b_pos"])
    j = a.join(b, keys).filter((rev("a_flag") == mrev("b_flag")) & (mrev("a_flag") == rev("b_flag")))
    return j.select(a["name"], "a_id", "b_id", F.col("a_chrom").alias("chrom"), F.col("b_chrom").alias("mate_chrom"), F.least("a_s", "b_s").alias("start_pos"), F.greatest("a_e", "b_e").alias("end_pos"))
