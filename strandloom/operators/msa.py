"""Multiple alignments in long form: (block_id, species, chrom, start, size, strand, src_size, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codon prefixes whose third base is free.
FOURFOLD = ["GC", "GG", "CC", "AC", "GT", "CG", "CT", "TC"]


def reference_positions(text: Column) -> Column:
    """array<int>: alignment columns (from 0) that hold a base."""
    return F.filter(F.transform(F.split(text, ""), lambda c, i: F.when(c != "-", i)), lambda i: i.isNotNull())


def gap_adjusted(text: Column, position: Column) -> Column:
    """Alignment column of an ungapped position; null outside."""
    return F.get(reference_positions(text), position)


def with_reference(msa: DataFrame, reference: str) -> DataFrame:
    r = msa.filter(F.col("species") == reference).select("block_id", F.col("text").alias("ref_text"), F.col("start").alias("ref_start"), F.col("chrom").alias("ref_chrom"))
    return msa.join(r, "block_id")


def compress(msa: DataFrame, reference: str) -> DataFrame:
    """Without the columns in which the reference has a gap."""
    j = with_reference(msa, reference)
    kept = F.array_join(F.transform(reference_positions(F.col("ref_text")), lambda i: F.substring("text", i + 1, F.lit(1))), "")
    return j.withColumn("text", kept).select(*msa.columns)


def region(msa: DataFrame, reference: str, chrom: str, start: int, end: int) -> DataFrame:
    """(species, text): the alignment over [start, end) of the reference, without reference gaps; absent species and stretches are ``-``."""
    c = compress(msa, reference)
    j = with_reference(c, reference).filter((F.col("ref_chrom") == chrom) & (F.col("ref_start") < end) & (F.col("ref_start") + F.length("ref_text") > start))
    lo = F.greatest(F.lit(start) - F.col("ref_start"), F.lit(0)).cast("int")
    piece = F.substring("text", lo + 1, (F.least(F.lit(end), F.col("ref_start") + F.length("ref_text")) - F.greatest(F.col("ref_start"), F.lit(start))).cast("int"))
    at = F.greatest(F.col("ref_start") - start, F.lit(0))
    per = j.select("species", at.alias("at"), piece.alias("piece")).groupBy("species").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    fill = F.aggregate("p", F.lit(""), lambda s, x: F.concat(s, F.repeat(F.lit("-"), (x["at"] - F.length(s)).cast("int")), x["piece"]))
    return per.select("species", F.rpad(fill, end - start, "-").alias("text"))


def columns(msa: DataFrame) -> DataFrame:
    """(block_id, column, species, base): one row per alignment cell."""
    return msa.select("block_id", "species", F.posexplode(F.split("text", "")).alias("column", "base")).filter(F.col("base") != "")


def column_vectors(msa: DataFrame) -> DataFrame:
    """(block_id, column, bases): species to base, as a map."""
    return columns(msa).groupBy("block_id", "column").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("species", F.upper("base"))))).alias("bases"))


def conserved(msa: DataFrame) -> DataFrame:
    """(block_id, column, base): columns in which all species have one base."""
    g = columns(msa).groupBy("block_id", "column").agg(F.min(F.upper("base")).alias("base"), F.max(F.upper("base")).alias("_b"))
    return g.filter((F.col("base") == F.col("_b")) & (F.col("base") != "-")).select("block_id", "column", "base")


def fourfold(msa: DataFrame, reference: str) -> DataFrame:
    """(block_id, column): third codon places of the reference that are free to change, in blocks read from their first base."""
    c = compress(msa, reference).filter(F.col("species") == reference)
    n = F.floor(F.length("text") / 3).cast("int")
    codons = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * 3 + 2).alias("column"), F.upper(F.substring("text", i * 3 + 1, F.lit(2))).alias("two")))
    return c.filter(n > 0).select("block_id", F.inline(F.filter(codons, lambda x: x["two"].isin(FOURFOLD)))).select("block_id", "column")


def concatenate(msa: DataFrame) -> DataFrame:
    """(species, text): blocks joined in order of block_id, absent species as gaps."""
    blocks = msa.groupBy("block_id").agg(F.max(F.length("text")).alias("n"))
    species = msa.select("species").distinct()
    full = blocks.join(species).join(msa.select("block_id", "species", "text"), ["block_id", "species"], "left")
    piece = F.coalesce("text", F.repeat(F.lit("-"), F.col("n")))
    per = full.groupBy("species").agg(F.array_sort(F.collect_list(F.struct("block_id", piece.alias("t")))).alias("p"))
    return per.select("species", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"))


def sample_columns(msa: DataFrame, n: int, seed: int) -> DataFrame:
    """(species, text): ``n`` columns drawn with replacement from all blocks, in a seeded order."""
    v = column_vectors(msa).withColumn("h", F.xxhash64(F.lit(seed), "block_id", "column")).orderBy("h", "block_id", "column").limit(n)
    one = v.select("h", F.explode("bases").alias("species", "base")).groupBy("species").agg(F.array_sort(F.collect_list(F.struct("h", "base"))).alias("p"))
    return one.select("species", F.array_join(F.transform("p", lambda x: x["base"]), "").alias("text"))
