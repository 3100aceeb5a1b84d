"""Queries on sequences, motifs, alignments, models and text formats."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import align as AL
from strandloom.functions import blocks as B
from strandloom.functions import hmm as H
from strandloom.functions import phylo as PH
from strandloom.functions import sequence as Q
from strandloom.operators import conservation as CO
from strandloom.operators import motif as MO
from strandloom.operators import msa as MS
from strandloom.operators.ordered import Ordered
from strandloom.plans.intervals import IV, iv, sizes
from strandloom.plans.reads import RD, rd
from strandloom.plans.tables import Registry, table
from strandloom.session import stage
from strandloom.sources import readers as RE
from strandloom.sources import writers as WR

R = Registry()


def seqs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reads").filter(F.length("seq") > 0).select(F.col("rec_id").alias("id"), F.col("seq").alias("bases"), "name")


# --- sequences ---------------------------------------------------------------------------


@R.add("hamming_to_revcomp", "SELECT rec_id, CAST(hamming(seq, reverse(translate(seq, 'ACGT', 'TGCA'))) AS INTEGER) AS distance FROM reads WHERE length(seq) > 0")
def hamming_to_revcomp(spark, d):
    s = F.col("bases")
    return seqs(spark, d).select(F.col("id").alias("rec_id"), Q.hamming(s, Q.reverse_complement(s)).alias("distance"))


@R.add("sequence_chunks", "WITH c AS (SELECT rec_id, seq, unnest(range(0, greatest(length(seq) - 2 - 1, 0) + 1, 8)) AS start FROM reads WHERE length(seq) > 0) SELECT rec_id, CAST(start AS INTEGER) AS start, seq[start + 1:start + 10] AS bases FROM c")
def sequence_chunks(spark, d):
    """Pieces of 10 bases of which neighbours share 2."""
    return seqs(spark, d).select(F.col("id").alias("rec_id"), F.inline(Q.chunks(F.col("bases"), 10, 2)))


@R.add("masked_bases", "SELECT rec_id, seq[1:5] || repeat('N', length(seq[6:15])) || seq[16:] AS hard, seq[1:5] || lower(seq[6:15]) || seq[16:] AS soft FROM reads WHERE length(seq) > 0")
def masked_bases(spark, d):
    s = F.col("bases")
    return seqs(spark, d).select(F.col("id").alias("rec_id"), Q.mask(s, F.lit(5), F.lit(15)).alias("hard"), Q.mask(s, F.lit(5), F.lit(15), True).alias("soft"))


@R.add("encoded_bases", "SELECT rec_id, translate(upper(seq), 'ACGTN', '01234') AS code FROM reads WHERE length(seq) > 0")
def encoded_bases(spark, d):
    return seqs(spark, d).select(F.col("id").alias("rec_id"), F.array_join(F.transform(Q.encode(F.col("bases")), lambda x: x.cast("string")), "").alias("code"))


@R.add("motif_places", "WITH p AS (SELECT rec_id, seq, unnest(range(0, length(seq) - 4)) AS start FROM reads WHERE length(seq) >= 5) SELECT rec_id, CAST(start AS INTEGER) AS start FROM p WHERE regexp_full_match(seq[start + 1:start + 5], 'GA[AT]TC')")
def motif_places(spark, d):
    return seqs(spark, d).select(F.col("id").alias("rec_id"), F.explode(Q.motif_starts(F.col("bases"), "GAWTC")).alias("start"))


@R.add("longest_orf", """
WITH s AS (SELECT rec_id, seq, unnest(range(0, length(seq) - 2)) AS i FROM reads WHERE length(seq) >= 3), a AS (SELECT rec_id, i FROM s WHERE seq[i + 1:i + 3] = 'ATG'), z AS (SELECT rec_id, i FROM s WHERE seq[i + 1:i + 3] IN ('TAA', 'TAG', 'TGA')),
o AS (SELECT a.rec_id, a.i AS s, min(z.i) + 3 AS e FROM a JOIN z ON a.rec_id = z.rec_id AND z.i > a.i AND (z.i - a.i) % 3 = 0 GROUP BY 1, 2)
SELECT rec_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY e - s DESC, s) AS k FROM o) WHERE k = 1
""")
def longest_orf(spark, d):
    o = seqs(spark, d).select(F.col("id").alias("rec_id"), Q.longest_orf(F.col("bases")).alias("o")).filter(F.col("o").isNotNull())
    return o.select("rec_id", F.col("o.start").alias("start"), F.col("o.end").alias("end"))


@R.add("restriction_digest", "SELECT rec_id, len(string_split(replace(seq, 'GATC', 'GA|TC'), '|')) AS pieces, string_split(replace(seq, 'GATC', 'GA|TC'), '|')[1] AS first FROM reads WHERE length(seq) > 0")
def restriction_digest(spark, d):
    x = seqs(spark, d).select(F.col("id").alias("rec_id"), Q.digest(F.col("bases"), "GATC", 2).alias("p"))
    return x.select("rec_id", F.size("p").cast("long").alias("pieces"), F.get("p", F.lit(0)).alias("first"))


@R.add("flow_lengths")
def flow_lengths(spark, d):
    return seqs(spark, d).select(F.col("id").alias("rec_id"), Q.flowgram(F.col("bases"), "TACG").alias("flows"))


@R.add("shuffled_bases")
def shuffled_bases(spark, d):
    return seqs(spark, d).select(F.col("id").alias("rec_id"), Q.shuffled(F.col("bases"), F.col("id"), 3).alias("bases"))


@R.add("document_kmers", "WITH k AS (SELECT unnest([text[i:i + 3] for i in range(1, length(text) - 2)]) AS kmer FROM documents WHERE length(text) >= 4) SELECT kmer, count(*) AS n FROM k GROUP BY 1")
def document_kmers(spark, d):
    """Character 4-mers of whole texts."""
    return table(spark, d, "documents").select(F.explode(Q.kmers(F.col("text"), 4)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


@R.add("all_kmers", "SELECT a.b || c.b || e.b AS kmer FROM (VALUES ('A'), ('C'), ('G'), ('T')) a(b), (VALUES ('A'), ('C'), ('G'), ('T')) c(b), (VALUES ('A'), ('C'), ('G'), ('T')) e(b)")
def all_kmers(spark, d):
    return Q.all_kmers(spark, 3)


# --- motifs and alignment ----------------------------------------------------------------

# A small matrix (A, C, G, T by position) whose consensus is TGACTCA.
MOTIF = np.array([[0.05, 0.05, 0.05, 0.85], [0.05, 0.05, 0.85, 0.05], [0.85, 0.05, 0.05, 0.05], [0.05, 0.6, 0.3, 0.05], [0.05, 0.05, 0.05, 0.85], [0.05, 0.85, 0.05, 0.05], [0.85, 0.05, 0.05, 0.05]])


def _log_odds(m: np.ndarray, seq: str) -> str:
    """SQL for the log odds of the bases from ``start`` against even odds; any other letter rules a place out."""
    case = lambda j: " ".join(f"WHEN '{b}' THEN {float(np.log(max(p, 1e-12)) - np.log(0.25))!r}" for b, p in zip("ACGT", m[j]))
    return " + ".join(f"CASE upper({seq}[start + {j + 1}]) {case(j)} ELSE -1e9 END" for j in range(len(m)))


@R.add("pwm_scan", f"""
WITH t AS (SELECT rec_id AS id, seq, unnest(range(0, length(seq) - {len(MOTIF) - 1})) AS start FROM reads WHERE length(seq) >= {len(MOTIF)}),
s AS (SELECT id, start, {_log_odds(MOTIF, 'seq')} AS p, {_log_odds(MO.reverse_complement(MOTIF), 'seq')} AS m FROM t)
SELECT id, 'ap' AS motif, start, start + {len(MOTIF)} AS "end", CASE WHEN p >= m THEN '+' ELSE '-' END AS strand, round(greatest(p, m), 6) AS score FROM s WHERE greatest(p, m) >= 4.0
""")
def pwm_scan(spark, d):
    return MO.scan(seqs(spark, d).select("id", "bases"), [("ap", MOTIF)], 4.0).withColumn("score", F.round("score", 6))


@R.add("pwm_shuffled_control")
def pwm_shuffled_control(spark, d):
    """Hits of the matrix and of ten column permutations of it, by score."""
    pwms = [("real", MOTIF)] + [(f"perm{i}", MO.permute_columns(MOTIF, i)) for i in range(10)]
    s = MO.scan(seqs(spark, d).select("id", "bases"), pwms, 4.0)
    return s.groupBy("motif", F.floor("score").alias("score")).agg(F.count("*").alias("n"))


@R.add("seed_matches", """
WITH q AS (SELECT unnest(['q1', 'q2']) AS query, unnest(['ACGTTGCAAC', 'GGATCCATTA']) AS b), t AS (SELECT rec_id AS target, seq, unnest(range(0, length(seq) - 9)) AS start FROM reads WHERE length(seq) >= 10),
h AS (SELECT query, target, start, seq[start + 1:start + 10] AS p, b FROM t, q WHERE seq[start + 1:start + 5] = b[1:5] OR seq[start + 6:start + 10] = b[6:10])
SELECT query, target, CAST(start AS INTEGER) AS start, CAST(hamming(p, b) AS INTEGER) AS mismatches FROM h WHERE hamming(p, b) <= 1
"""
)
def seed_matches(spark, d):
    q = spark.createDataFrame([("q1", "ACGTTGCAAC"), ("q2", "GGATCCATTA")], "query string, q_bases string")
    t = seqs(spark, d).select(F.col("id").alias("target"), F.col("bases").alias("t_bases"))
    return MO.seed_matches(q, t, 5, 1)


@R.add("local_alignments")
def local_alignments(spark, d):
    """Every read against its mate's reverse complement."""
    r = rd(spark, d).select("rec_id", "seq", "flag", F.regexp_replace("name", "/[12]$", "").alias("frag"), "pos", "mate_pos").filter(F.length("seq") > 0)
    a, b = r.filter(F.col("flag").bitwiseAND(64) != 0), r.filter(F.col("flag").bitwiseAND(128) != 0)
    j = a.alias("a").join(b.alias("b"), F.expr("a.frag = b.frag AND a.pos = b.mate_pos AND a.mate_pos = b.pos"))
    al = AL.local_align(F.col("a.seq"), Q.reverse_complement(F.col("b.seq")))
    return j.select(F.col("a.rec_id").alias("a_id"), F.col("b.rec_id").alias("b_id"), al.alias("al")).select("a_id", "b_id", "al.score", "al.start_a", "al.end_a", "al.start_b", "al.end_b", "al.identity")


# --- models ------------------------------------------------------------------------------

# Two states, GC-poor and GC-rich, over symbols A, C, G, T and other.
GC_MODEL = H.Model(np.array([0.5, 0.5]), np.array([[0.95, 0.05], [0.05, 0.95]]), np.array([[0.35, 0.14, 0.14, 0.35, 0.02], [0.14, 0.35, 0.35, 0.14, 0.02]]))


@R.add("hmm_states")
def hmm_states(spark, d):
    s = seqs(spark, d).select(F.col("id").alias("rec_id"), Q.encode(F.col("bases")).alias("o"))
    return s.select("rec_id", H.decode(F.col("o"), GC_MODEL).alias("states"))


@R.add("hmm_posteriors")
def hmm_posteriors(spark, d):
    s = seqs(spark, d).select(F.col("id").alias("rec_id"), Q.encode(F.col("bases")).alias("o"))
    return s.select("rec_id", H.log_likelihood(F.col("o"), GC_MODEL).alias("log_likelihood"), F.array_max(H.posteriors(F.col("o"), GC_MODEL, 1)).alias("max_rich"))


def pile(spark: SparkSession, d: str) -> DataFrame:
    """Reads as rows of a multiple alignment: in stretches of 200,000 bases the k-th reads of all libraries are a block, where more than one library has one."""
    r = rd(spark, d).filter(F.col("chrom").isNotNull() & (F.length("seq") > 0))
    lib = F.translate(F.try_element_at("tags", F.lit("RG")), "-", "_")
    one = r.select("rec_id", "chrom", (F.floor(F.col("start_pos") / 200_000) * 200_000).alias("start_pos"), lib.alias("lib"), F.col("seq").alias("text")).filter(F.col("lib").isNotNull())
    one = stage(Ordered(one, ["chrom", "start_pos", "lib"], ["rec_id"]).row_number("k"), "pile")
    many = one.groupBy("chrom", "start_pos", "k").agg(F.count("*").alias("n")).filter("n > 1").select("chrom", "start_pos", "k")
    j = one.join(many, ["chrom", "start_pos", "k"])
    return j.select(F.concat_ws(":", "chrom", F.col("start_pos").cast("string"), F.col("k").cast("string")).alias("block_id"), F.lit(0.0).alias("score"), F.col("lib").alias("species"), "chrom", F.col("start_pos").alias("start"), F.length("text").cast("long").alias("size"), F.lit("+").alias("strand"), F.lit(0).cast("long").alias("src_size"), "text")


PILE = f"""{RD}, n AS (SELECT chrom, CAST(floor(start_pos / 200000) * 200000 AS BIGINT) AS bin, translate(tags['RG'], '-', '_') AS species, seq AS text, rec_id FROM rd WHERE chrom IS NOT NULL AND length(seq) > 0 AND tags['RG'] IS NOT NULL),
o AS (SELECT chrom || ':' || bin || ':' || row_number() OVER (PARTITION BY chrom, bin, species ORDER BY rec_id) AS block_id, species, text FROM n),
p AS (SELECT * FROM o WHERE block_id IN (SELECT block_id FROM o GROUP BY 1 HAVING count(*) > 1)), cells AS (SELECT block_id, species, text, unnest(range(0, length(text))) AS c FROM p)"""


@R.add("alignment_columns", f'WITH {PILE} SELECT block_id, CAST(c AS INTEGER) AS "column", species, text[c + 1] AS base FROM cells')
def alignment_columns(spark, d):
    return MS.columns(pile(spark, d))


@R.add("conserved_columns", f'WITH {PILE} SELECT block_id, CAST(c AS INTEGER) AS "column", min(upper(text[c + 1])) AS base FROM cells GROUP BY 1, 2 HAVING min(upper(text[c + 1])) = max(upper(text[c + 1])) AND min(text[c + 1]) <> \'-\'')
def conserved_columns(spark, d):
    return MS.conserved(pile(spark, d))


@R.add("fourfold_sites", f"""
WITH {PILE}, r AS (SELECT block_id, replace(text, '-', '') AS t FROM p WHERE species = 'lib_a'), k AS (SELECT block_id, t, unnest(range(0, length(t) // 3)) AS i FROM r)
SELECT block_id, CAST(i * 3 + 2 AS INTEGER) AS "column" FROM k WHERE upper(t[i * 3 + 1:i * 3 + 2]) IN ({", ".join(f"'{x}'" for x in MS.FOURFOLD)})
""")
def fourfold_sites(spark, d):
    return MS.fourfold(pile(spark, d), "lib_a")


TREE = "((lib_a:0.1,lib_b:0.1):0.05,lib_c:0.2);"


@R.add("column_likelihoods")
def column_likelihoods(spark, d):
    """Likelihood, fitted rate and its log odds of every block on a three-leaf tree."""
    v = MS.column_vectors(pile(spark, d)).groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("column", F.array_join(F.transform(F.map_entries("bases"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ").alias("b")))).alias("c"))
    @F.pandas_udf("log_likelihood double, omega double, lod double")
    def fit(cols: pd.Series) -> pd.DataFrame:
        e = PH.Evolution(PH.parse_newick(TREE), PH.hky(2.0, np.full(4, 0.25)), np.full(4, 0.25))
        memo: dict[tuple, tuple] = {}
        out = []
        for block in cols:
            rows = [dict(x.split("=") for x in c.split(" ") if x) for c in block]
            # Columns matter by their pattern only.
            key = tuple(sorted(tuple(sorted(r.items())) for r in rows))
            if key not in memo:
                omega, lod = e.fit_omega(rows)
                memo[key] = (float(e.log_likelihood(rows)), omega, lod)
            out.append(memo[key])
        return pd.DataFrame(out, columns=["log_likelihood", "omega", "lod"])

    return v.select("block_id", fit(F.transform("c", lambda x: x["b"])).alias("f")).select("block_id", "f.*")


NEUTRAL = CO.Neutral(TREE)


def alignment_sites(spark, d):
    return stage(CO.sites(pile(spark, d), "lib_a", NEUTRAL), "sites")


@R.add("site_rates")
def site_rates(spark, d):
    """Neutral likelihood, fitted rate and tree length of every alignment column."""
    r = CO.site_rates(alignment_sites(spark, d), NEUTRAL)
    return r.select("block_id", "column", "pattern", *[F.round(c, 6).alias(c) for c in ("log_likelihood", "omega", "lod", "tree_length")])


@R.add("site_biases")
def site_biases(spark, d):
    """Fitted base bias of every alignment column."""
    r = CO.site_biases(alignment_sites(spark, d), NEUTRAL)
    return r.select("block_id", "column", *[F.round(c, 6).alias(c) for c in ("pi_a", "pi_c", "pi_g", "pi_t", "bias_lod")])


def million_windows(spark, d):
    """Stretches of a million bases of every chromosome, by name."""
    wide = sizes(spark, d).select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(1_000_000).cast("long"))).alias("start_pos")).withColumn("end_pos", F.col("start_pos") + 1_000_000)
    return wide.withColumn("region", F.concat_ws(":", "chrom", F.col("start_pos").cast("string")))


@R.add("region_rates")
def region_rates(spark, d):
    """One rate for the alignment columns inside every stretch of a million bases."""
    return CO.region_rates(alignment_sites(spark, d), million_windows(spark, d), "region", NEUTRAL).select("region", "columns", *[F.round(c, 6).alias(c) for c in ("omega", "lod", "log_likelihood", "tree_length")])


@R.add("window_rates")
def window_rates(spark, d):
    return CO.window_rates(alignment_sites(spark, d), NEUTRAL, 20, 10).select("chrom", "start_pos", "columns", *[F.round(c, 6).alias(c) for c in ("omega", "lod")])


@R.add("mean_branch_length")
def mean_branch_length(spark, d):
    """Mean fitted tree length of the alignment columns in stretches of a million bases."""
    return CO.mean_branch_length(CO.site_rates(alignment_sites(spark, d), NEUTRAL), million_windows(spark, d), "region").withColumn("mean_length", F.round("mean_length", 6))


@R.add("conserved_states")
def conserved_states(spark, d):
    """Most likely neutral and biased stretches of every block."""
    return CO.conserved_states(alignment_sites(spark, d), NEUTRAL, 10.0, 0.2).withColumn("posterior", F.round("posterior", 6))


@R.add("conserved_motifs")
def conserved_motifs(spark, d):
    """Motif matches on the reference rows, and how many lie in slow columns."""
    m = CO.conserved_motifs(pile(spark, d), "lib_a", [("ap", MOTIF)], 4.0, CO.site_rates(alignment_sites(spark, d), NEUTRAL))
    return CO.motif_counts(m, 0.1)


@R.add("filled_columns")
def filled_columns(spark, d):
    return CO.filled(alignment_sites(spark, d), NEUTRAL).select("block_id", "column", "pattern", "filled")


@R.add("evolved_reads")
def evolved_reads(spark, d):
    """Every read evolved down the neutral tree."""
    return CO.evolved(seqs(spark, d).select("id", "bases"), NEUTRAL, 7)


# --- text forms --------------------------------------------------------------------------


def transcripts_of_reads(spark: SparkSession, d: str) -> DataFrame:
    """Mapped reads as transcript rows."""
    r = rd(spark, d).filter(F.col("chrom").isNotNull() & (F.size("blocks") > 0))
    blocks = F.transform("blocks", lambda x: B.block(x["start_pos"], x["end_pos"]))
    none = F.lit(None)
    return r.select("rec_id", "chrom", "start_pos", "end_pos", F.concat(F.lit("r"), F.col("rec_id").cast("string")).alias("name"), F.lit(0.0).alias("score"), "strand", none.cast("long").alias("cds_start"), none.cast("long").alias("cds_end"), blocks.alias("blocks"), F.array().cast("array<string>").alias("extra"))


TX = f"WITH {RD}, t AS (SELECT rec_id, chrom, start_pos, end_pos, 'r' || rec_id AS name, coalesce(strand, '*') AS strand, blocks FROM rd WHERE chrom IS NOT NULL AND len(blocks) > 0)"


@R.add("bed12_lines", f"{TX} SELECT rec_id, concat_ws(chr(9), chrom, start_pos, end_pos, name, '0', strand, start_pos, end_pos, '0,0,0', len(blocks), array_to_string([b.end_pos - b.start_pos for b in blocks], ','), array_to_string([b.start_pos - t.start_pos for b in blocks], ',')) AS value FROM t")
def bed12_lines(spark, d):
    return transcripts_of_reads(spark, d).select("rec_id", WR.bed_line().alias("value"))


@R.add("bed_round_trip", f"{TX} SELECT rec_id, chrom, start_pos, end_pos, strand, len(blocks) AS n_blocks, true AS valid FROM t")
def bed_round_trip(spark, d):
    """Rows written as BED12 lines and parsed again."""
    t = transcripts_of_reads(spark, d).select(WR.bed_line().alias("value"))
    p = RE.parse_bed(t)
    return p.select(F.substring("name", 2, 20).cast("long").alias("rec_id"), "chrom", "start_pos", "end_pos", "strand", F.size("blocks").cast("long").alias("n_blocks"), "valid")


@R.add("gtf_round_trip", f"{TX} SELECT rec_id, chrom, start_pos, end_pos, CASE WHEN strand IN ('+', '-') THEN strand ELSE '*' END AS strand, len(blocks) AS n_blocks FROM t")
def gtf_round_trip(spark, d):
    """Rows written as GTF lines, parsed and grouped into transcripts again."""
    t = transcripts_of_reads(spark, d)
    lines = t.select(F.explode(WR.gtf_lines("own", F.col("name"), F.col("name"))).alias("value"))
    g = RE.gtf_transcripts(RE.parse_gff(lines))
    return g.select(F.substring("name", 2, 20).cast("long").alias("rec_id"), "chrom", "start_pos", "end_pos", "strand", F.size("blocks").cast("long").alias("n_blocks"))


@R.add("cigars_from_blocks", f"{TX}, x AS (SELECT rec_id, [(blocks[i].end_pos - blocks[i].start_pos) || 'M' || CASE WHEN i < len(blocks) THEN (blocks[i + 1].start_pos - blocks[i].end_pos) || 'N' ELSE '' END for i in range(1, len(blocks) + 1)] AS p FROM t) SELECT rec_id, array_to_string(p, '') AS cigar FROM x")
def cigars_from_blocks(spark, d):
    return transcripts_of_reads(spark, d).select("rec_id", B.cigar(F.col("blocks")).alias("cigar"))


@R.add("sam_round_trip", "SELECT name, flag, chrom, pos, cigar, seq, weight, count(*) AS n FROM (SELECT coalesce(name, '*') AS name, flag, chrom, coalesce(pos, 0) AS pos, cigar, seq, coalesce(1.0 / TRY_CAST(tags['NH'] AS DOUBLE), 1.0) AS weight FROM reads) GROUP BY ALL")
def sam_round_trip(spark, d):
    """Reads written as SAM lines and parsed again."""
    lines = table(spark, d, "reads").select(WR.read_sam_line().alias("value"))
    p = RE.parse_sam(lines)
    return p.groupBy("name", "flag", "chrom", "pos", "cigar", "seq", "weight").agg(F.count("*").alias("n"))


@R.add("refseq_lines", f"{TX} SELECT rec_id, concat_ws(chr(9), name, name, chrom, strand, start_pos, end_pos, end_pos, end_pos, len(blocks), array_to_string([b.start_pos for b in blocks], ',') || ',', array_to_string([b.end_pos for b in blocks], ',') || ',') AS value FROM t")
def refseq_lines(spark, d):
    return transcripts_of_reads(spark, d).select("rec_id", WR.refseq_line(F.col("name")).alias("value"))


@R.add("transcript_sam_lines", f"{TX}, x AS (SELECT *, array_to_string([(blocks[i].end_pos - blocks[i].start_pos) || 'M' || CASE WHEN i < len(blocks) THEN (blocks[i + 1].start_pos - blocks[i].end_pos) || 'N' ELSE '' END for i in range(1, len(blocks) + 1)], '') AS cigar FROM t) SELECT rec_id, concat_ws(chr(9), name, CASE WHEN strand = '-' THEN '16' ELSE '0' END, chrom, start_pos + 1, '255', cigar, '*', '0', '0', '*', '*') AS value FROM x")
def transcript_sam_lines(spark, d):
    return transcripts_of_reads(spark, d).select("rec_id", WR.sam_line().alias("value"))


@R.add("info_round_trip", f"{TX} SELECT name, chrom, strand, len(blocks) AS n_blocks FROM t")
def info_round_trip(spark, d):
    t = transcripts_of_reads(spark, d).select(WR.parse_info(WR.info_string()).alias("x"))
    return t.select("x.name", "x.chrom", "x.strand", F.size("x.blocks").cast("long").alias("n_blocks"))


@R.add("fasta_records", "SELECT rec_id, '>' || rec_id || chr(10) || seq[1:20] || CASE WHEN length(seq) > 20 THEN chr(10) || seq[21:40] ELSE '' END AS value FROM reads WHERE length(seq) > 0 AND length(seq) <= 40")
def fasta_records(spark, d):
    t = table(spark, d, "reads").filter((F.length("seq") > 0) & (F.length("seq") <= 40)).select("rec_id", F.col("rec_id").cast("string").alias("id"), F.lit("").alias("description"), F.col("seq").alias("bases"))
    return t.select("rec_id", WR.fasta_record(20).alias("value"))


@R.add("fasta_records_all", "SELECT rec_id, '>' || rec_id || chr(10) || rtrim(regexp_replace(seq, '(.{20})', '\\1' || chr(10), 'g'), chr(10)) AS value FROM reads WHERE length(seq) > 0")
def fasta_records_all(spark, d):
    """Sequences of every length."""
    t = table(spark, d, "reads").filter(F.length("seq") > 0).select("rec_id", F.col("rec_id").cast("string").alias("id"), F.lit("").alias("description"), F.col("seq").alias("bases"))
    return t.select("rec_id", WR.fasta_record(20).alias("value"))


@R.add("region_parse", f"WITH {IV} SELECT interval_id, chrom, start_pos, end_pos FROM iv")
def region_parse(spark, d):
    """UCSC region strings made and parsed again."""
    t = iv(spark, d).select("interval_id", B.parse_region(B.region_string(F.col("chrom"), F.col("start_pos"), F.col("end_pos"))).alias("r"))
    return t.select("interval_id", "r.chrom", F.col("r.start").alias("start_pos"), F.col("r.end").alias("end_pos"))


@R.add("bedgraph_lines", f"WITH {IV} SELECT interval_id, concat_ws(chr(9), chrom, start_pos, end_pos, CAST(CAST(start_pos AS BIGINT) AS VARCHAR)) AS value FROM iv")
def bedgraph_lines(spark, d):
    return iv(spark, d).withColumn("v", F.col("start_pos").cast("double")).select("interval_id", WR.bedgraph_line("v").alias("value"))


@R.add("gct_text")
def gct_text(spark, d):
    from strandloom.plans.matrices import mx

    m = mx(spark, d).withColumn("description", F.lit("na"))
    return WR.gct_lines(m, [f"smp_{i:02d}" for i in range(1, 41)])


@R.add("gmt_text", "SELECT p_brand AS set, p_brand || chr(9) || 'na' || chr(9) || array_to_string(list_sort(list(DISTINCT CAST(p_partkey AS VARCHAR))), chr(9)) AS value FROM part GROUP BY 1")
def gmt_text(spark, d):
    s = table(spark, d, "part").select(F.col("p_brand").alias("set"), F.lit(None).cast("string").alias("description"), F.col("p_partkey").cast("string").alias("gene"))
    return WR.gmt_lines(s)


@R.add("wig_text", f"""
WITH {IV}, ev AS (SELECT chrom, unnest([start_pos, end_pos]) AS pos, unnest([1, -1]) AS delta FROM iv), s AS (SELECT chrom, pos, sum(delta) AS delta FROM ev GROUP BY 1, 2),
r AS (SELECT chrom, pos AS s, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS e, CAST(sum(delta) OVER (PARTITION BY chrom ORDER BY pos) AS BIGINT) AS depth FROM s), d AS (SELECT * FROM r WHERE depth > 0),
n AS (SELECT *, CASE WHEN lag(e) OVER w = s AND lag(depth) OVER w = depth THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY chrom ORDER BY s)), g AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY s) AS g FROM n)
SELECT chrom, min(s) AS start_pos, 'variableStep chrom=' || chrom || ' span=' || (max(e) - min(s)) || chr(10) || (min(s) + 1) || ' ' || depth AS value FROM g GROUP BY chrom, g, depth
""")
def wig_text(spark, d):
    from strandloom.operators.peaks import coverage_segments

    return WR.wig_lines(coverage_segments(iv(spark, d)), "depth")
