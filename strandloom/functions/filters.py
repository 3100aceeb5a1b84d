"""Predicates on read rows, as Column builders.

Columns are those of a read table: ``flag``, ``chrom``, ``mate_chrom``, ``mapq``, ``cigar``, ``blocks``,
``tags``, ``weight``, ``start_pos``, ``end_pos``, ``strand``, ``tlen``.  A predicate that needs a value the row
lacks is false, unless its docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM flag bits.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = (1 << i for i in range(12))


def has(bit: int) -> Column:
    return F.coalesce(F.col("flag").bitwiseAND(bit) != 0, F.lit(False))


def true() -> Column:
    return F.lit(True)


def all_of(preds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def any_of(preds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds, F.lit(False))


def none_of(preds: Sequence[Column]) -> Column:
    return ~any_of(preds)


def mapped() -> Column:
    return ~has(UNMAPPED) & F.col("chrom").isNotNull()


def not_chimeric() -> Column:
    """Not a pair whose mates lie on different chromosomes."""
    return ~(has(PAIRED) & F.coalesce(F.col("mate_chrom") != F.col("chrom"), F.lit(False)))


def not_duplicate() -> Column:
    return ~has(DUPLICATE)


def first_of_pair() -> Column:
    return has(FIRST)


def second_of_pair() -> Column:
    return has(SECOND)


def fragment_length(least: int, most: int) -> Column:
    """Template length within [least, most], or the span where there is no template."""
    size = F.when(F.coalesce(F.col("tlen"), F.lit(0)) != 0, F.abs("tlen")).otherwise(F.col("end_pos") - F.col("start_pos"))
    return F.coalesce(size.between(least, most), F.lit(False))


def genomic_span(most: int) -> Column:
    return F.coalesce(F.col("end_pos") - F.col("start_pos") <= most, F.lit(False))


def no_indel() -> Column:
    """True also for rows without a CIGAR."""
    return ~F.coalesce(F.col("cigar").rlike("[ID]"), F.lit(False))


def mapping_quality(paired: int, single: int) -> Column:
    return F.coalesce(F.col("mapq") >= F.when(has(PAIRED), paired).otherwise(single), F.lit(False))


def unspliced() -> Column:
    return F.coalesce(F.size("blocks") == 1, F.lit(False))


def spliced() -> Column:
    return F.coalesce(F.size("blocks") > 1, F.lit(False))


def max_hits(most: int) -> Column:
    """Rows without an NH tag pass."""
    return F.coalesce(F.try_element_at("tags", F.lit("NH")).try_cast("int") <= most, F.lit(True))


def paired_and_proper() -> Column:
    return has(PAIRED) & has(PROPER)


def paired_same_chrom() -> Column:
    return has(PAIRED) & ~has(MATE_UNMAPPED) & F.coalesce(F.col("mate_chrom") == F.col("chrom"), F.lit(False))


def proper_or_unpaired() -> Column:
    return F.col("flag").isNotNull() & (~has(PAIRED) | has(PROPER))


def usable_for_reconstruction() -> Column:
    return F.col("flag").isNotNull() & (~has(PAIRED) | has(PROPER) | paired_same_chrom())


def oriented_start() -> Column:
    return F.when(F.col("strand") == "-", F.col("end_pos")).otherwise(F.col("start_pos"))


def oriented_end() -> Column:
    return F.when(F.col("strand") == "-", F.col("start_pos")).otherwise(F.col("end_pos"))


def starts_in(start: Column, end: Column) -> Column:
    """Oriented start strictly inside."""
    return F.coalesce((oriented_start() > start) & (oriented_start() < end), F.lit(False))


def ends_in(start: Column, end: Column) -> Column:
    return F.coalesce((oriented_end() > start) & (oriented_end() < end), F.lit(False))


def same_strand(strand: Column) -> Column:
    return F.coalesce(F.col("strand") == strand, F.lit(False))


def unique_mapping() -> Column:
    return F.coalesce(F.col("weight") >= 1, F.lit(False))


# Intron ends (donor, acceptor) on the plus strand.
CANONICAL = ["GTAG"]
NEAR_CANONICAL = ["GCAG", "ATAC"]


def splice_strand(intron: Column, only_canonical: bool = True) -> Column:
    """``+``, ``-`` or ``*`` from the first and last two bases of an intron's sequence."""
    ends = F.upper(F.concat(F.substring(intron, 1, 2), F.substring(intron, -2, 2)))
    plus = CANONICAL + ([] if only_canonical else NEAR_CANONICAL)
    minus = ["".join({"A": "T", "C": "G", "G": "C", "T": "A"}[b] for b in reversed(x)) for x in plus]
    return F.when(ends.isin(plus), "+").when(ends.isin(minus), "-").otherwise("*")


def canonical_splices(introns: Column) -> Column:
    """All junctions of a row have canonical ends of one strand; rows without a junction pass."""
    s = F.array_distinct(F.transform(introns, lambda i: splice_strand(i)))
    return (F.size(introns) == 0) | ((F.size(s) == 1) & (F.get(s, F.lit(0)) != "*"))
