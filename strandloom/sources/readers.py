"""Readers of the text formats.

Line formats are read as text and split with built-in functions, so filters and column
pruning work on the scan's result and bad fields become nulls instead of errors.
Formats whose records span lines (FASTA, MAF, PHYLIP, WIG sections) are read with a record
separator; FASTQ records are found by line numbers counted over the blocks of a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import blocks as B
from strandloom.operators.join import overlap_join
from strandloom.session import bounded_broadcast
from strandloom.sources import schema as S


def lines(spark: SparkSession, path: str, comment: str = "#", header: int = 0) -> DataFrame:
    """(value): lines of text files without comments, blank lines and line ends; ``header`` lines per file are skipped only if they start with ``comment``."""
    t = spark.read.text(path).select(F.regexp_replace("value", r"[\r\n]+$", "").alias("value"))
    return t.filter((F.trim("value") != "") & ~F.col("value").startswith(comment)) if comment else t.filter(F.trim("value") != "")


def tabbed(spark: SparkSession, path: str, fields: str, comment: str = "#", keep: Column | None = None) -> DataFrame:
    """Tab-separated columns typed by a DDL string; fields that don't parse are null, further ones are dropped."""
    cols = [x.strip().split() for x in fields.split(",")]
    f = F.split("value", "\t", -1)
    out = lines(spark, path, comment).select(*[F.get(f, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(cols)])
    return out.filter(keep) if keep is not None else out


def _longs(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("long"))


def _f(i: int) -> Column:
    return F.get(F.col("f"), F.lit(i))


def parse_bed(text: DataFrame, value: str = "value") -> DataFrame:
    """BED3 to BED12 lines (and further columns) as transcripts; a row without blocks gets one block.

    Track and browser lines are left out.  ``valid`` is false where the bounds don't parse,
    start > end, or the blocks don't end at the row's end.
    """
    t = text.filter(~F.lower(value).rlike(r"^\s*(track|browser|#)")).select(F.split(value, "\t", -1).alias("f"))
    start, end = _f(1).try_cast("long"), _f(2).try_cast("long")
    sizes, starts = _longs(_f(10)), _longs(_f(11))
    given = F.zip_with(starts, sizes, lambda s, n: B.block(start + s, start + s + n))
    has = (F.size("f") >= 12) & (_f(9).try_cast("int") > 0)
    blocks = F.when(has, given).otherwise(B.single(start, end))
    out = t.select(
        _f(0).alias("chrom"), start.alias("start_pos"), end.alias("end_pos"), _f(3).alias("name"), _f(4).try_cast("double").alias("score"), B.strand_of(F.coalesce(_f(5), F.lit("*"))).alias("strand"),
        _f(6).try_cast("long").alias("cds_start"), _f(7).try_cast("long").alias("cds_end"), _f(8).alias("colour"), blocks.alias("blocks"), F.slice("f", 13, F.greatest(F.size("f") - 12, F.lit(0))).alias("extra"),
    )
    ok = F.coalesce((F.col("start_pos") <= F.col("end_pos")) & (F.try_element_at("blocks", F.lit(-1))["end"] == F.col("end_pos")), F.lit(False))
    return out.withColumn("valid", ok)


def read_bed(spark: SparkSession, path: str, min_score: float | None = None, chrom: str | None = None, region: tuple[str, int, int] | None = None) -> DataFrame:
    """Transcripts of BED files; optional strict score floor, chromosome, or overlapped region."""
    t = parse_bed(lines(spark, path))
    if min_score is not None:
        t = t.filter(F.col("score") > min_score)
    if chrom is not None:
        t = t.filter(F.col("chrom") == chrom)
    if region is not None:
        t = t.filter((F.col("chrom") == region[0]) & (F.col("start_pos") < region[2]) & (F.col("end_pos") > region[1]))
    return t


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    return tabbed(spark, path, "chrom string, start_pos long, end_pos long, value double").filter(F.col("end_pos").isNotNull())


def attributes(raw: Column) -> Column:
    """map<string,array<string>> of GFF / GTF attributes: ``;`` between pairs, blank or ``=`` between key and value."""
    parts = F.filter(F.transform(F.split(raw, ";"), lambda x: F.trim(x)), lambda x: x != "")
    key = lambda x: F.regexp_extract(x, r"^([^\s=]+)", 1)
    val = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[^\s=]+[\s=]*", ""), '"', ""))
    pairs = F.transform(parts, lambda x: F.struct(key(x).alias("k"), val(x).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])))


def parse_gff(text: DataFrame, value: str = "value") -> DataFrame:
    """GFF / GTF rows with 0-based starts and attribute maps; rows without bounds are left out."""
    t = text.select(F.split(value, "\t", -1).alias("f"))
    return t.select(
        _f(0).alias("chrom"), _f(1).alias("source"), _f(2).alias("feature"), (_f(3).try_cast("long") - 1).alias("start_pos"), _f(4).try_cast("long").alias("end_pos"),
        _f(5).try_cast("double").alias("score"), B.strand_of(F.coalesce(_f(6), F.lit("*"))).alias("strand"), _f(7).try_cast("int").alias("frame"), attributes(_f(8)).alias("attributes"),
    ).filter(F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull())


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    return parse_gff(lines(spark, path))


def gtf_transcripts(gff: DataFrame) -> DataFrame:
    """Exon rows grouped by transcript_id into transcripts."""
    one = lambda k: F.get(F.try_element_at("attributes", F.lit(k)), F.lit(0))
    ex = gff.filter(F.col("feature").isin("exon", "CDS")).withColumn("transcript_id", one("transcript_id")).withColumn("gene_id", one("gene_id")).filter(F.col("transcript_id").isNotNull())
    exon = F.when(F.col("feature") == "exon", B.block(F.col("start_pos"), F.col("end_pos")))
    is_cds = F.col("feature") == "CDS"
    g = ex.groupBy("transcript_id", "chrom", "strand").agg(F.max("gene_id").alias("gene_id"), F.collect_set(exon).alias("b"), F.min(F.when(is_cds, F.col("start_pos"))).alias("cds_start"), F.max(F.when(is_cds, F.col("end_pos"))).alias("cds_end"))
    t = g.withColumn("blocks", B.merge(F.col("b"))).filter(F.size("blocks") > 0)
    return t.select("chrom", B.first_start(F.col("blocks")).alias("start_pos"), B.last_end(F.col("blocks")).alias("end_pos"), F.col("transcript_id").alias("name"), "strand", "gene_id", "cds_start", "cds_end", "blocks")


def read_repeats(spark: SparkSession, path: str) -> DataFrame:
    """Repeat-masker rows (blank-separated): place, strand, repeat name and class."""
    t = lines(spark, path).select(F.split(F.trim("value"), r"\s+").alias("f")).filter(_f(0).try_cast("int").isNotNull())
    return t.select(_f(4).alias("chrom"), (_f(5).try_cast("long") - 1).alias("start_pos"), _f(6).try_cast("long").alias("end_pos"), _f(0).try_cast("double").alias("score"), F.when(_f(8) == "C", "-").otherwise("+").alias("strand"), _f(9).alias("repeat"), _f(10).alias("repeat_class"))


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    t = lines(spark, path).select(F.split(F.trim("value"), r"\s+").alias("f"))
    return t.select(_f(0).alias("chrom"), _f(1).try_cast("long").alias("length")).filter(F.col("length").isNotNull())


def read_psl(spark: SparkSession, path: str) -> DataFrame:
    """PSL rows with target blocks and percent identity; header lines drop out."""
    cols = ", ".join(f"{n} {'string' if n in S.PSL_TEXT else 'long'}" for n in S.PSL_FIELDS)
    t = tabbed(spark, path, cols).filter(F.col("matches").isNotNull() & F.col("t_end").isNotNull())
    starts, sizes = _longs(F.col("t_starts")), _longs(F.col("block_sizes"))
    t = t.withColumn("blocks", F.zip_with(starts, sizes, lambda s, n: B.block(s, s + n)))
    aligned = F.col("matches") + F.col("mismatches") + F.col("rep_matches")
    return t.withColumn("identity", F.try_divide(F.col("matches") + F.col("rep_matches"), aligned))


def parse_wig(sections: DataFrame, value: str = "value") -> DataFrame:
    """(chrom, start_pos, end_pos, value) of wiggle sections, each starting with its declaration.

    ``sections`` holds one declaration with its data lines per row.  Positions become 0-based.
    """
    t = sections.select(F.split(F.regexp_replace(value, "\r", ""), "\n").alias("l")).withColumn("d", F.get("l", F.lit(0)))
    opt = lambda k, d: F.coalesce(F.nullif(F.regexp_extract("d", rf"\b{k}=(\S+)", 1), F.lit("")), F.lit(d))
    t = t.filter(F.col("d").rlike(r"^\s*(fixedStep|variableStep)?\s*chrom=")).select(opt("chrom", None).alias("chrom"), opt("start", None).try_cast("long").alias("s"), opt("step", "1").try_cast("long").alias("step"), opt("span", "1").try_cast("long").alias("span"), F.filter(F.slice("l", 2, F.size("l")), lambda x: F.trim(x) != "").alias("rows"))
    r = t.select("chrom", "s", "step", "span", F.posexplode("rows").alias("i", "x"))
    fixed = F.col("s").isNotNull()
    two = F.split(F.trim("x"), r"\s+")
    start = F.when(fixed, F.col("s") + F.col("i") * F.col("step")).otherwise(F.get(two, F.lit(0)).try_cast("long")) - 1
    v = F.when(fixed, F.trim("x")).otherwise(F.get(two, F.lit(1))).try_cast("double")
    return r.select("chrom", start.alias("start_pos"), (start + F.col("span")).alias("end_pos"), v.alias("value")).filter(F.col("value").isNotNull() & F.col("start_pos").isNotNull())


def read_wig(spark: SparkSession, path: str) -> DataFrame:
    """Wiggle files, split into sections at their declarations (a ``Step`` word ends the record separator)."""
    return parse_wig(spark.read.option("lineSep", "Step ").text(path).select(F.regexp_replace("value", r"(fixed|variable)\s*$", "").alias("value")))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, bases) of multi-FASTA files."""
    t = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "\r", "")
    body = F.when(F.instr("value", "\n") > 0, F.substring("value", F.instr("value", "\n") + 1, F.length("value"))).otherwise("")
    return t.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), F.regexp_replace(body, r"\s", "").alias("bases"))


def records_by_id(seqs: DataFrame, ids: DataFrame) -> DataFrame:
    return seqs.join(ids.select("id"), "id", "left_semi")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, bases, qual) of four-line FASTQ files; a record cut off at a file's end is left out.

    Records are counted, not searched for, since a quality line may start with ``@`` or ``+``: a line's
    number in its file is its number in its block of the file plus the lines of the blocks
    before, and only one count per block is carried between blocks.
    """
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    per = t.groupBy("file", "block").agg(F.min("n").alias("first"), F.count("*").alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("block")) - F.col("lines")
    start = bounded_broadcast(per.select("file", "block", (before - F.col("first")).alias("shift")))
    line = t.join(start, ["file", "block"]).withColumn("i", F.col("n") + F.col("shift"))
    part = lambda k: F.max(F.when(F.col("i") % 4 == k, F.rtrim("value", F.lit("\r"))))
    r = line.groupBy("file", F.floor(F.col("i") / 4).alias("record")).agg(part(0).alias("head"), part(1).alias("bases"), part(3).alias("qual")).filter(F.col("qual").isNotNull())
    return r.select(F.regexp_extract("head", r"^@(\S*)", 1).alias("id"), F.trim(F.regexp_replace("head", r"^@\S*", "")).alias("description"), "bases", "qual")


def parse_sam(text: DataFrame, value: str = "value") -> DataFrame:
    """SAM alignment lines as reads with tags, blocks, strand and weight 1 / NH."""
    t = text.filter(~F.col(value).startswith("@")).select(F.split(value, "\t", -1).alias("f")).filter(F.size("f") >= 11)
    tags = F.transform(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.substring(x, F.lit(6), F.length(x)).alias("v")))
    keys = F.array_distinct(F.transform(tags, lambda x: x["k"]))
    # A tag that occurs twice keeps its first value; only lines with such a tag are searched key by key.
    first = F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(tags, lambda x: x["k"] == k), F.lit(0))["v"]))
    tag_map = F.when(F.size(keys) == F.size(tags), F.map_from_entries(tags)).otherwise(first)
    star = lambda c: F.when(c != "*", c)
    r = t.select(
        _f(0).alias("name"), _f(1).try_cast("int").alias("flag"), star(_f(2)).alias("chrom"), _f(3).try_cast("long").alias("pos"), _f(4).try_cast("int").alias("mapq"), star(_f(5)).alias("cigar"),
        F.when(_f(6) == "=", star(_f(2))).otherwise(star(_f(6))).alias("mate_chrom"), _f(7).try_cast("long").alias("mate_pos"), _f(8).try_cast("long").alias("tlen"), _f(9).alias("seq"), _f(10).alias("qual"), tag_map.alias("tags"),
    )
    r = r.withColumn("blocks", B.cigar_blocks(F.col("cigar"), F.col("pos") - 1))
    nh = F.try_element_at("tags", F.lit("NH")).try_cast("double")
    return r.withColumn("start_pos", B.first_start(F.col("blocks"))).withColumn("end_pos", B.last_end(F.col("blocks"))).withColumn("weight", F.coalesce(1 / F.nullif(nh, F.lit(0.0)), F.lit(1.0))).withColumn("strand", F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+"))


def read_sam(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None, contained: bool = False) -> DataFrame:
    r = parse_sam(lines(spark, path, comment=""))
    if region is None:
        return r
    c, s, e = region
    ok = (F.col("start_pos") >= s) & (F.col("end_pos") <= e) if contained else (F.col("start_pos") < e) & (F.col("end_pos") > s)
    return r.filter((F.col("chrom") == c) & ok)


def transcript_strand(strand: Column, flag: Column, library: str) -> Column:
    """Strand of the transcript: ``first`` or ``second`` mate carries it, ``unstranded`` gives ``*``."""
    if library == "unstranded":
        return F.lit("*")
    carries = flag.bitwiseAND(64 if library == "first" else 128) != 0
    single = flag.bitwiseAND(1) == 0
    return F.when(single | carries, strand).otherwise(F.translate(strand, "+-", "-+"))


def parse_maf(blocks: DataFrame, value: str = "value") -> DataFrame:
    """Alignment rows of MAF blocks: (block_id, score, species, chrom, start, size, strand, src_size, text)."""
    t = blocks.select(F.monotonically_increasing_id().alias("block_id"), F.regexp_extract(value, r"score=(\S+)", 1).try_cast("double").alias("score"), F.filter(F.split(value, "\n"), lambda x: x.startswith("s ")).alias("s"))
    r = t.filter(F.size("s") > 0).select("block_id", "score", F.explode("s").alias("x")).withColumn("f", F.split(F.trim("x"), r"\s+"))
    src = _f(1)
    return r.select("block_id", "score", F.substring_index(src, ".", 1).alias("species"), F.when(F.instr(src, ".") > 0, F.regexp_replace(src, r"^[^.]*\.", "")).otherwise(src).alias("chrom"), _f(2).try_cast("long").alias("start"), _f(3).try_cast("long").alias("size"), _f(4).alias("strand"), _f(5).try_cast("long").alias("src_size"), F.regexp_replace(_f(6), "\r", "").alias("text"))


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    return parse_maf(spark.read.option("lineSep", "\na").text(path))


def read_phylip(spark: SparkSession, path: str, interleaved: bool = False) -> DataFrame:
    """(species, text) of whole-file PHYLIP alignments."""
    t = spark.read.text(path, wholetext=True).select(F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x: F.trim(x) != "").alias("l"))
    n = F.regexp_extract(F.get("l", F.lit(0)), r"(\d+)", 1).cast("int")
    body = F.slice("l", 2, F.size("l"))
    if interleaved:
        rows = t.select(n.alias("n"), F.posexplode(body).alias("i", "x"))
        named = rows.withColumn("k", F.col("i") % F.col("n")).withColumn("r", F.floor(F.col("i") / F.col("n")))
        piece = F.when(F.col("r") == 0, F.regexp_replace(F.regexp_replace(F.trim("x"), r"^\S+\s+", ""), r"\s", "")).otherwise(F.regexp_replace("x", r"\s", ""))
        g = named.groupBy("k").agg(F.max(F.when(F.col("r") == 0, F.regexp_extract(F.trim("x"), r"^(\S+)", 1))).alias("species"), F.array_sort(F.collect_list(F.struct("r", piece.alias("p")))).alias("p"))
        return g.select("species", F.array_join(F.transform("p", lambda x: x["p"]), "").alias("text"))
    # Sequential: a record starts at a line with a name, and goes on until the declared length is reached.
    width = F.regexp_extract(F.get("l", F.lit(0)), r"\d+\s+(\d+)", 1).cast("int")
    zero = F.array().cast("array<struct<species:string,text:string>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        full = F.size(acc).eqNullSafe(0) | (F.length(last["text"]) >= width)
        fresh = F.struct(F.regexp_extract(F.trim(x), r"^(\S+)", 1).alias("species"), F.regexp_replace(F.regexp_replace(F.trim(x), r"^\S+\s*", ""), r"\s", "").alias("text"))
        more = F.struct(last["species"].alias("species"), F.concat(last["text"], F.regexp_replace(x, r"\s", "")).alias("text"))
        return F.when(full, F.concat(acc, F.array(fresh))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(more)))

    return t.select(F.inline(F.aggregate(body, zero, add)))


def read_alignment(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Alignment by format name: FASTA, PHYLIP (sequential), PHYLIP_INTERLEAVED or MAF."""
    k = kind.upper()
    if k == "FASTA":
        return read_fasta(spark, path).select(F.col("id").alias("species"), F.col("bases").alias("text"))
    if k.startswith("PHYLIP"):
        return read_phylip(spark, path, k.endswith("INTERLEAVED"))
    if k == "MAF":
        return read_maf(spark, path)
    raise ValueError(f"unknown alignment format {kind}")


def read_gct(spark: SparkSession, path: str) -> DataFrame:
    """Long matrix (row, description, col, value) of a GCT file; cells that don't parse are left out."""
    t = spark.read.text(path).select(F.split(F.regexp_replace("value", "\r", ""), "\t", -1).alias("f"))
    head = t.filter(F.lower(_f(0)) == "name").first()
    if head is None:
        raise ValueError("no header line starting with Name")
    cols = F.array(*[F.lit(c) for c in head["f"][2:]])
    rows = t.filter((F.size("f") > 2) & (F.lower(_f(0)) != "name"))
    vals = F.arrays_zip(cols.alias("col"), F.slice("f", 3, F.size("f")).alias("v"))
    out = rows.select(_f(0).alias("row"), _f(1).alias("description"), F.explode(vals).alias("c")).select("row", "description", "c.col", F.col("c.v").try_cast("double").alias("value"))
    return out.filter(F.col("value").isNotNull() & F.col("col").isNotNull())


def read_cls(spark: SparkSession, path: str) -> DataFrame:
    """(place, label) of class labels: the last line's words, from 0."""
    t = spark.read.text(path, wholetext=True).select(F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x: (F.trim(x) != "")).alias("l"))
    return t.select(F.posexplode(F.split(F.trim(F.element_at("l", -1)), r"\s+")).alias("place", "label"))


def read_gmt(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """(set, description, gene) of gene sets with at least ``least`` genes."""
    t = lines(spark, path).select(F.split("value", "\t", -1).alias("f"))
    genes = F.filter(F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0))), lambda g: F.trim(g) != "")
    return t.select(_f(0).alias("set"), _f(1).alias("description"), genes.alias("g")).filter(F.size("g") >= least).select("set", "description", F.explode("g").alias("gene"))


def read_gmx(spark: SparkSession, path: str) -> DataFrame:
    """(set, description, gene) of gene sets in columns."""
    t = spark.read.text(path, wholetext=True).select(F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x: x != "").alias("l"))
    cells = t.select(F.split(F.get("l", F.lit(0)), "\t", -1).alias("s"), F.split(F.get("l", F.lit(1)), "\t", -1).alias("d"), F.explode(F.slice("l", 3, F.size("l"))).alias("r"))
    flat = cells.select("s", "d", F.posexplode(F.split("r", "\t", -1)).alias("i", "gene"))
    return flat.select(F.get("s", F.col("i")).alias("set"), F.get("d", F.col("i")).alias("description"), "gene").filter(F.trim("gene") != "")


def read_go(spark: SparkSession, path: str) -> DataFrame:
    """(gene, term): first column and every term of the comma or semicolon list in the second."""
    t = lines(spark, path, comment="!").select(F.split("value", "\t", -1).alias("f"))
    return t.select(_f(0).alias("gene"), F.explode(F.split(_f(1), r"[,;]\s*")).alias("term")).filter(F.trim("term") != "")


def read_meme_sites(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, strand, start, p, site) from the site tables of a motif report."""
    pat = r"^(\S+)\s+([+-])?\s*(\d+)\s+(\d\.\d+e[-+]\d+)\s+\S*\s*([ACGT]+)"
    t = spark.read.text(path).filter(F.col("value").rlike(pat))
    g = lambda i: F.regexp_extract("value", pat, i)
    return t.select(g(1).alias("sequence"), F.when(g(2) == "", "+").otherwise(g(2)).alias("strand"), g(3).cast("long").alias("start"), g(4).cast("double").alias("p"), g(5).alias("site"))


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """Array probe rows as a map of the FEATURES header's names to values."""
    t = spark.read.text(path).select(F.split("value", "\t", -1).alias("f"))
    head = t.filter(_f(0) == "FEATURES").first()
    if head is None:
        raise ValueError("no FEATURES line")
    names = F.array(*[F.lit(x) for x in dict.fromkeys(head["f"])])
    return t.filter(_f(0) == "DATA").select(F.map_from_entries(F.filter(F.arrays_zip(names.alias("k"), F.slice(F.col("f"), 1, len(dict.fromkeys(head["f"]))).alias("v")), lambda x: x["k"].isNotNull())).alias("probe"))


def stems(structure: Column) -> Column:
    """array<struct<open,close>>: paired places of a dot-bracket structure, by opening place."""
    zero = F.struct(F.array().cast("array<int>").alias("st"), F.array().cast("array<struct<open:int,close:int>>").alias("out"))
    marks = F.transform(F.split(structure, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))

    def step(a: Column, m: Column) -> Column:
        top = F.try_element_at(a["st"], F.lit(-1))
        pop = F.slice(a["st"], 1, F.greatest(F.size(a["st"]) - 1, F.lit(0)))
        close = (m["c"] == ")") & (F.size(a["st"]) > 0)
        st = F.when(m["c"] == "(", F.concat(a["st"], F.array(m["i"]))).when(close, pop).otherwise(a["st"])
        out = F.when(close, F.concat(a["out"], F.array(F.struct(top.alias("open"), m["i"].alias("close"))))).otherwise(a["out"])
        return F.struct(st.alias("st"), out.alias("out"))

    return F.array_sort(F.aggregate(marks, zero, step, lambda a: a["out"]))


def read_intervals(spark: SparkSession, path: str, kind: str, min_score: float | None = None) -> DataFrame:
    """Reader by format name (BED, GFF, BEDGRAPH, else any tab-separated interval file); the score floor is strict."""
    k = kind.upper()
    if k == "BED":
        t = read_bed(spark, path)
    elif k in ("GFF", "GTF"):
        t = read_gff(spark, path)
    elif k == "BEDGRAPH":
        t = read_bedgraph(spark, path).withColumnRenamed("value", "score")
    else:
        t = tabbed(spark, path, S.INTERVAL)
    return t.filter(F.col("score") > min_score) if min_score is not None else t


def filter_delimited(spark: SparkSession, path: str, regions: DataFrame, chrom: int, start: int, end: int) -> DataFrame:
    """Lines of any tab-separated file whose interval (columns by number, from 0) overlaps ``regions``."""
    t = lines(spark, path).select("value", F.split("value", "\t", -1).alias("f"))
    t = t.select("value", _f(chrom).alias("chrom"), _f(start).try_cast("long").alias("start_pos"), _f(end).try_cast("long").alias("end_pos"))
    return overlap_join(t, regions, "left_semi").select("value")


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
