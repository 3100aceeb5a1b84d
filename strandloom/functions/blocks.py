"""Column functions on intervals and block lists.

A block list is an ``array<struct<start:bigint,end:bigint>>``, half-open, sorted and
disjoint after ``merge``.  All functions are built-in expressions; a null list gives
null, an empty list behaves as the empty interval.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS = "array<struct<start:bigint,end:bigint>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def block(start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))


def single(start: Column, end: Column) -> Column:
    """A one-block list."""
    return F.array(block(start, end))


def empty() -> Column:
    return F.array().cast(BLOCKS)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b["end"] - b["start"])


def length(x: Column) -> Column:
    """Sum of block lengths."""
    return total(x)


def first_start(x: Column) -> Column:
    return F.array_min(F.transform(x, lambda b: b["start"]))


def last_end(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda b: b["end"]))


def span(x: Column) -> Column:
    """Last end minus first start."""
    return last_end(x) - first_start(x)


def merge(x: Column, gap: int = 0) -> Column:
    """Blocks sorted, overlapping or abutting ones (or those at most ``gap`` apart) united."""

    def add(acc: Column, b: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(block(last["start"], F.greatest(last["end"], b["end"]))))
        fresh = F.array(block(b["start"], b["end"]))
        return F.when(F.size(acc) == 0, fresh).when(b["start"] <= last["end"] + gap, joined).otherwise(F.concat(acc, fresh))

    return F.aggregate(F.array_sort(F.filter(x, lambda b: b["end"] > b["start"])), empty(), add)


def pair_pieces(x: Column, y: Column) -> Column:
    pieces = F.flatten(F.transform(x, lambda a: F.transform(y, lambda b: block(F.greatest(a["start"], b["start"]), F.least(a["end"], b["end"])))))
    return F.filter(pieces, lambda p: p["start"] < p["end"])


def intersect(x: Column, y: Column) -> Column:
    """Common pieces, sorted; empty if there are none."""
    return F.array_sort(pair_pieces(x, y))


def overlap_bases(x: Column, y: Column) -> Column:
    return total(pair_pieces(x, y))


def overlaps(x: Column, y: Column, buffer: int = 0) -> Column:
    """Whether any two blocks share a base, or lie at most ``buffer`` bases apart."""
    return F.exists(x, lambda a: F.exists(y, lambda b: (a["start"] < b["end"] + buffer) & (b["start"] < a["end"] + buffer)))


def span_overlaps(x: Column, y: Column, buffer: int = 0) -> Column:
    return (first_start(x) < last_end(y) + buffer) & (first_start(y) < last_end(x) + buffer)


def contains(x: Column, y: Column) -> Column:
    """Every block of ``y`` lies inside some block of ``x``."""
    return F.forall(y, lambda b: F.exists(x, lambda a: (a["start"] <= b["start"]) & (b["end"] <= a["end"])))


def union(x: Column, y: Column) -> Column:
    return merge(F.concat(x, y))


def complement(x: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """Gaps between blocks, or the uncovered parts of [start, end) if bounds are given."""
    sorted_x = merge(x)
    lo = F.array(block(start, start)) if start is not None else empty()
    hi = F.array(block(end, end)) if end is not None else empty()

    def gaps(s: Column) -> Column:
        whole = F.concat(lo, s, hi)
        n = F.greatest(F.size(s) + int(start is not None) + int(end is not None) - 1, F.lit(0))
        clip_lo = (lambda c: F.greatest(c, start)) if start is not None else (lambda c: c)
        clip_hi = (lambda c: F.least(c, end)) if end is not None else (lambda c: c)
        pairs = F.zip_with(F.slice(whole, 1, n), F.slice(whole, 2, n), lambda a, b: block(clip_lo(a["end"]), clip_hi(b["start"])))
        return F.filter(pairs, lambda p: p["start"] < p["end"])

    return let(sorted_x, gaps)


def introns(x: Column) -> Column:
    """Gaps between consecutive blocks (splice connections)."""
    return complement(x)


def subtract(x: Column, y: Column) -> Column:
    """Parts of ``x`` outside ``y``."""
    return let(complement(y, first_start(F.concat(x, y)), last_end(F.concat(x, y))), lambda c: intersect(x, c))


def shift(x: Column, by: Column | int) -> Column:
    d = by if isinstance(by, Column) else F.lit(by)
    return F.transform(x, lambda b: block(b["start"] + d, b["end"] + d))


def move_to(x: Column, start: Column) -> Column:
    return shift(x, start - first_start(x))


def expand(x: Column, left: int, right: int) -> Column:
    """First start moved down by ``left`` (not below 0), last end up by ``right``."""
    lo, hi = first_start(x), last_end(x)
    return F.transform(x, lambda b: block(F.when(b["start"] == lo, F.greatest(lo - left, F.lit(0))).otherwise(b["start"]), F.when(b["end"] == hi, hi + right).otherwise(b["end"])))


def extend_gene(x: Column, strand: Column, up: int, down: int) -> Column:
    """Outer ends extended by ``up`` at the 5' and ``down`` at the 3' side."""
    return F.when(strand == "-", expand(x, down, up)).otherwise(expand(x, up, down))


def slice_positions(x: Column, start: Column, end: Column) -> Column:
    """Blocks of the positions [start, end) counted along the blocks, on the plus side."""

    def cut(s: Column) -> Column:
        before = F.transform(s, lambda b, i: block(total(F.slice(s, 1, i)), total(F.slice(s, 1, i)) + b["end"] - b["start"]))
        pieces = F.zip_with(s, before, lambda b, p: block(b["start"] + F.greatest(start, p["start"]) - p["start"], b["start"] + F.least(end, p["end"]) - p["start"]))
        return F.filter(pieces, lambda b: b["start"] < b["end"])

    return let(F.array_sort(x), cut)


def transcript_slice(x: Column, strand: Column, start: Column, end: Column) -> Column:
    """Blocks of transcript positions [start, end), counted from the 5' end."""
    n = length(x)
    return F.when(strand == "-", slice_positions(x, n - end, n - start)).otherwise(slice_positions(x, start, end))


def trim(x: Column, strand: Column, five: int, three: int) -> Column:
    """Blocks without ``five`` bases at the 5' and ``three`` at the 3' end; empty if nothing is left."""
    return transcript_slice(x, strand, F.lit(five).cast("long"), length(x) - three)


def last_bases(x: Column, strand: Column, n: int) -> Column:
    """The last ``n`` bases of the transcript."""
    return transcript_slice(x, strand, F.greatest(length(x) - n, F.lit(0).cast("long")), length(x))


def to_genome(x: Column, strand: Column, pos: Column) -> Column:
    """Genome coordinate of a 0-based transcript position; null outside."""
    return F.when((pos >= 0) & (pos < length(x)), first_start(transcript_slice(x, strand, pos, pos + 1)))


def to_transcript(x: Column, strand: Column, coord: Column) -> Column:
    """0-based transcript position of a genome coordinate; -1 outside the blocks."""
    inside = F.exists(x, lambda b: (b["start"] <= coord) & (coord < b["end"]))
    before = F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + F.greatest(F.least(b["end"], coord) - b["start"], F.lit(0).cast("long")))
    return F.when(~inside, F.lit(-1).cast("long")).when(strand == "-", length(x) - 1 - before).otherwise(before)


def midpoint(x: Column) -> Column:
    """Reference coordinate of the middle of the blocks."""
    return to_genome(x, F.lit("+"), F.floor(length(x) / 2).cast("long"))


def offset_midpoint(start: Column, end: Column) -> Column:
    """Half the span, as an offset."""
    return F.floor((end - start) / 2).cast("long")


def oriented_start(start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == "-", end).otherwise(start)


def oriented_end(start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == "-", start).otherwise(end)


def distance(s1: Column, e1: Column, s2: Column, e2: Column, same: Column | None = None) -> Column:
    """0 if overlapping or touching, else the gap; the largest long on another chromosome."""
    d = F.greatest(s1, s2) - F.least(e1, e2)
    out = F.greatest(d, F.lit(0).cast("long"))
    return out if same is None else F.when(same, out).otherwise(F.lit(2**63 - 1))


def stitch(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return block(F.least(s1, s2), F.greatest(e1, e2))


def strand_of(c: Column) -> Column:
    """``+`` or ``-``, everything else ``*``."""
    return F.when(c.isin("+", "-"), c).otherwise("*")


def parse_region(c: Column) -> Column:
    """struct<chrom,start,end> of ``chr:start-end`` (commas allowed); null if malformed."""
    pat = r"\A([^:]+):([0-9,]+)-([0-9,]+)\z"
    num = lambda i: F.regexp_replace(F.regexp_extract(c, pat, i), ",", "").try_cast("long")
    return F.when(c.rlike(pat), F.struct(F.regexp_extract(c, pat, 1).alias("chrom"), num(2).alias("start"), num(3).alias("end")))


def region_string(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


# --- transcripts -------------------------------------------------------------------------


def cds(x: Column, cds_start: Column, cds_end: Column) -> Column:
    return intersect(x, single(cds_start, cds_end))


def utr5(x: Column, strand: Column, cds_start: Column, cds_end: Column) -> Column:
    left = intersect(x, single(first_start(x), cds_start))
    right = intersect(x, single(cds_end, last_end(x)))
    return F.when(strand == "-", right).otherwise(left)


def utr3(x: Column, strand: Column, cds_start: Column, cds_end: Column) -> Column:
    left = intersect(x, single(first_start(x), cds_start))
    right = intersect(x, single(cds_end, last_end(x)))
    return F.when(strand == "-", left).otherwise(right)


def promoter(start: Column, end: Column, strand: Column, up: int, down: int) -> Column:
    """struct around the transcription start: ``up`` bases before, ``down`` after; not below 0."""
    lo = F.when(strand == "-", end - down).otherwise(start - up)
    hi = F.when(strand == "-", end + up).otherwise(start + down)
    return block(F.greatest(lo, F.lit(0)), hi)


def windows(x: Column, strand: Column, size: int, step: int) -> Column:
    """array of block lists: transcript windows of ``size`` every ``step`` bases; partial ones dropped."""
    n = length(x)
    starts = F.when(n >= size, F.sequence(F.lit(0).cast("long"), n - size, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: transcript_slice(x, strand, s, s + size))


def percent_overlap(x: Column, y: Column) -> Column:
    """Shared bases over the length of ``x``."""
    return F.try_divide(overlap_bases(x, y), length(x))


def reciprocal_overlap(x: Column, y: Column, least: float) -> Column:
    return F.least(percent_overlap(x, y), percent_overlap(y, x)) >= least


def almost_equal(x: Column, y: Column, fudge: int) -> Column:
    """Equal block counts and all ends less than ``fudge`` apart."""
    near = F.forall(F.zip_with(x, y, lambda a, b: F.when(a.isNull() | b.isNull(), False).otherwise((F.abs(a["start"] - b["start"]) < fudge) & (F.abs(a["end"] - b["end"]) < fudge))), lambda ok: ok)
    return (F.size(x) == F.size(y)) & near


def intron_chain_compatible(x: Column, y: Column) -> Column:
    """The introns of both inside their common span are the same, and they share a base."""
    lo, hi = F.greatest(first_start(x), first_start(y)), F.least(last_end(x), last_end(y))
    within = lambda b: F.filter(introns(b), lambda g: (g["start"] < hi) & (g["end"] > lo))
    return overlaps(x, y) & (within(x) == within(y))


# --- text forms --------------------------------------------------------------------------


def cigar(x: Column) -> Column:
    """M for blocks and N for the gaps between them."""
    gaps = introns(x)
    m = F.transform(x, lambda b: F.concat((b["end"] - b["start"]).cast("string"), F.lit("M")))
    g = F.concat(F.transform(gaps, lambda b: F.concat((b["end"] - b["start"]).cast("string"), F.lit("N"))), F.array(F.lit("")))
    return F.array_join(F.zip_with(m, g, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def cigar_blocks(c: Column, start: Column) -> Column:
    """Blocks of an alignment starting at ``start``: M, =, X and D extend a block, N opens a new one.

    I, S, H and P take no reference bases.  A null or unparsable CIGAR gives null.
    """
    ops = F.regexp_extract_all(c, F.lit(r"([0-9]+)[MIDNSHP=X]"), 1)
    kinds = F.regexp_extract_all(c, F.lit(r"[0-9]+([MIDNSHP=X])"), 1)
    pairs = F.zip_with(ops, kinds, lambda n, k: F.struct(n.cast("long").alias("n"), k.alias("k")))
    zero = F.struct(start.cast("long").alias("at"), empty().alias("out"))

    def step(acc: Column, p: Column) -> Column:
        uses = p["k"].isin("M", "=", "X", "D")
        grown = F.concat(acc["out"], F.array(block(acc["at"], acc["at"] + p["n"])))
        return F.struct((acc["at"] + F.when(uses | (p["k"] == "N"), p["n"]).otherwise(F.lit(0))).alias("at"), F.when(uses, grown).otherwise(acc["out"]).alias("out"))

    return F.when(c.rlike(r"\A([0-9]+[MIDNSHP=X])+\z"), merge(F.aggregate(pairs, zero, step, lambda a: a["out"])))
