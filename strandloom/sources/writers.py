"""Lines of the text formats as Column expressions, and writers of them.

Every ``*_line`` function gives one string column (or an array of lines); ``write_lines``
writes them as text, partition by partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import blocks as B


def write_lines(df: DataFrame, path: str, line: str = "value", order: list[str] | None = None) -> None:
    """Write the column ``line`` as text; ``order`` range-sorts over all files, whose names keep the order."""
    out = df.orderBy(*order) if order else df
    out.select(line).write.mode("overwrite").text(path)


def _s(c: Column) -> Column:
    return c.cast("string")


def _num(c: Column) -> Column:
    """Whole numbers without a fraction."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, _s(c.cast("long"))).otherwise(_s(c))


def bed_line(extra: bool = False, colour: str = "0,0,0") -> Column:
    """BED12 of a transcript row; null name ``.``, null score 0, without CDS the bounds."""
    start, end = F.col("start_pos"), F.col("end_pos")
    sizes = F.array_join(F.transform("blocks", lambda b: _s(b["end"] - b["start"])), ",")
    starts = F.array_join(F.transform("blocks", lambda b: _s(b["start"] - F.col("start_pos"))), ",")
    parts = [F.col("chrom"), _s(start), _s(end), F.coalesce("name", F.lit(".")), _num(F.coalesce("score", F.lit(0.0))), F.coalesce("strand", F.lit("*")), _s(F.coalesce(F.col("cds_start"), start)), _s(F.coalesce(F.col("cds_end"), end)), F.lit(colour), _s(F.size("blocks")), sizes, starts]
    line = F.concat_ws("\t", *parts)
    return F.when(F.size("extra") > 0, F.concat_ws("\t", line, F.array_join("extra", "\t"))).otherwise(line) if extra else line


def short_bed_line() -> Column:
    return F.concat_ws("\t", F.col("chrom"), _s(F.col("start_pos")), _s(F.col("end_pos")), F.coalesce("name", F.lit(".")), _num(F.coalesce("score", F.lit(0.0))), F.coalesce("strand", F.lit("*")))


def bedgraph_line(value: str = "score") -> Column:
    return F.concat_ws("\t", F.col("chrom"), _s(F.col("start_pos")), _s(F.col("end_pos")), _num(F.col(value)))


def gtf_lines(source: str, gene: Column, transcript: Column, more: dict[str, Column] | None = None) -> Column:
    """array<string>: a transcript line and one per exon, 1-based, with further attributes."""
    attrs = F.concat(F.lit('gene_id "'), gene, F.lit('"; transcript_id "'), transcript, F.lit('";'), *[x for k, c in (more or {}).items() for x in (F.lit(f' {k} "'), _s(c), F.lit('";'))])
    line = lambda kind, s, e: F.concat_ws("\t", F.col("chrom"), F.lit(source), F.lit(kind), _s(s + 1), _s(e), F.lit("."), F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise("."), F.lit("."), attrs)
    return F.concat(F.array(line("transcript", F.col("start_pos"), F.col("end_pos"))), F.transform("blocks", lambda b: line("exon", b["start"], b["end"])))


def refseq_line(gene: Column) -> Column:
    """Gene, name, chrom, strand, bounds, CDS bounds, exon count, starts and ends."""
    join = lambda k: F.concat(F.array_join(F.transform("blocks", lambda b: _s(b[k])), ","), F.lit(","))
    cs, ce = F.coalesce(F.col("cds_start"), F.col("end_pos")), F.coalesce(F.col("cds_end"), F.col("end_pos"))
    return F.concat_ws("\t", gene, F.coalesce("name", F.lit(".")), F.col("chrom"), F.coalesce("strand", F.lit("*")), _s(F.col("start_pos")), _s(F.col("end_pos")), _s(cs), _s(ce), _s(F.size("blocks")), join("start"), join("end"))


def sam_line(mapq: int = 255) -> Column:
    """A SAM line of a transcript row, its CIGAR made from the blocks, without bases."""
    flag = F.when(F.col("strand") == "-", "16").otherwise("0")
    return F.concat_ws("\t", F.coalesce("name", F.lit("*")), flag, F.col("chrom"), _s(F.col("start_pos") + 1), F.lit(str(mapq)), B.cigar(F.col("blocks")), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"))


def read_sam_line() -> Column:
    """A SAM line of a read row, tags sorted by name."""
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.when(e["value"].rlike(r"\A-?[0-9]+\z"), ":i:").otherwise(":Z:"), e["value"]))
    star = lambda c, d: F.coalesce(_s(F.col(c)), F.lit(d))
    base = F.concat_ws("\t", star("name", "*"), star("flag", "0"), star("chrom", "*"), star("pos", "0"), star("mapq", "0"), star("cigar", "*"), star("mate_chrom", "*"), star("mate_pos", "0"), star("tlen", "0"), star("seq", "*"), star("qual", "*"))
    return F.when(F.coalesce(F.size("tags"), F.lit(0)) > 0, F.concat_ws("\t", base, F.array_join(tags, "\t"))).otherwise(base)


def info_string() -> Column:
    """name, place, strand and blocks in one string that ``parse_info`` reads back."""
    return F.concat_ws("|", F.coalesce("name", F.lit("")), F.col("chrom"), F.coalesce("strand", F.lit("*")), F.coalesce(_s(F.col("score")), F.lit("")), F.array_join(F.transform("blocks", lambda b: F.concat(_s(b["start"]), F.lit("-"), _s(b["end"]))), ","))


def parse_info(c: Column) -> Column:
    p = F.split(c, r"\|", -1)
    g = lambda i: F.get(p, F.lit(i))
    blocks = F.transform(F.split(g(4), ","), lambda x: B.block(F.substring_index(x, "-", 1), F.substring_index(x, "-", -1)))
    return F.struct(F.nullif(g(0), F.lit("")).alias("name"), g(1).alias("chrom"), g(2).alias("strand"), g(3).try_cast("double").alias("score"), blocks.alias("blocks"))


def wig_lines(segments: DataFrame, value: str, spans: bool = True) -> DataFrame:
    """(chrom, start_pos, value): variableStep sections; with ``spans`` equal neighbouring values are first joined."""
    from strandloom.operators.peaks import run_length

    s = run_length(segments, value) if spans else segments
    line = F.concat(F.lit("variableStep chrom="), F.col("chrom"), F.lit(" span="), _s(F.col("end_pos") - F.col("start_pos")), F.lit("\n"), _s(F.col("start_pos") + 1), F.lit(" "), _num(F.col(value)))
    return s.select("chrom", "start_pos", line.alias("value"))


def fasta_record(width: int = 60) -> Column:
    """Header and bases wrapped at ``width``."""
    head = F.concat(F.lit(">"), F.col("id"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" "), F.col("description"))).otherwise(""))
    return F.concat(head, F.lit("\n"), F.rtrim(F.regexp_replace("bases", f"(.{{{width}}})", "$1\n"), F.lit("\n")))


def fastq_record() -> Column:
    return F.concat(F.lit("@"), F.col("id"), F.lit("\n"), F.col("bases"), F.lit("\n+\n"), F.col("qual"))


def maf_blocks(msa: DataFrame) -> DataFrame:
    """(block_id, value): MAF blocks, rows in order of species."""
    row = F.concat_ws(" ", F.lit("s"), F.concat_ws(".", "species", "chrom"), _s(F.col("start")), _s(F.col("size")), F.col("strand"), _s(F.col("src_size")), F.col("text"))
    g = msa.groupBy("block_id").agg(F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct("species", row.alias("r")))).alias("r"))
    return g.select("block_id", F.concat(F.lit("a score="), _s(F.col("score")), F.lit("\n"), F.array_join(F.transform("r", lambda x: x["r"]), "\n"), F.lit("\n")).alias("value"))


def gct_lines(m: DataFrame, cols: list[str]) -> DataFrame:
    """(ord, value): lines of a GCT file; a lost cell is an empty field."""
    w = m.groupBy("row").agg(F.max("description").alias("description"), *[F.max(F.when(F.col("col") == c, F.col("value"))).alias(f"c{i}") for i, c in enumerate(cols)])
    body = w.select(F.lit(2).alias("ord"), "row", F.concat_ws("\t", "row", F.coalesce("description", F.lit("na")), *[F.coalesce(_num(F.col(f"c{i}")), F.lit("")) for i in range(len(cols))]).alias("value"))
    n = w.agg(F.count("*").alias("n"))
    head = n.select(F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.lit("").alias("row"), F.lit("#1.2").alias("value")), F.struct(F.lit(1).alias("ord"), F.lit("").alias("row"), F.concat(_s(F.col("n")), F.lit(f"\t{len(cols)}\nName\tDescription\t" + "\t".join(cols))).alias("value")))).alias("h")).select("h.*")
    return head.unionByName(body)


def gmt_lines(sets: DataFrame) -> DataFrame:
    g = sets.groupBy("set").agg(F.max("description").alias("d"), F.array_sort(F.collect_set("gene")).alias("g"))
    return g.select("set", F.concat_ws("\t", "set", F.coalesce("d", F.lit("na")), F.array_join("g", "\t")).alias("value"))


def cls_text(labels: list[str]) -> str:
    kinds = list(dict.fromkeys(labels))
    return f"{len(labels)} {len(kinds)} 1\n# {' '.join(kinds)}\n{' '.join(labels)}\n"


def write_by_sample(df: DataFrame, path: str, sample: str, line: str = "value") -> None:
    """One folder of text files per sample."""
    df.select(F.col(sample).alias("sample"), F.col(line).alias("value")).write.mode("overwrite").partitionBy("sample").text(path)
