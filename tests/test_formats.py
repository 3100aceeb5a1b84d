import pytest
from pyspark.sql import functions as F

from strandloom.sources import readers as RE
from strandloom.sources import writers as WR


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        p = tmp_path / name
        p.write_text(text)
        return f"file://{p}"

    return write


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_bed(spark, put):
    p = put("a.bed", "track name=x\n#c\nchr1\t10\t50\tn\t5\t+\t12\t40\t0\t2\t5,10,\t0,30,\tx\ty\nchr2\t1\t2\nchr1\tx\t3\nchr1\t0\t99\tb\t1\t-\t0\t0\t0\t1\t5\t0\n")
    t = RE.read_bed(spark, p)
    assert t.count() == 4 and t.filter("valid").count() == 2
    r = t.filter("name = 'n'").first()
    assert [tuple(b) for b in r["blocks"]] == [(10, 15), (40, 50)] and r["extra"] == ["x", "y"] and r["cds_start"] == 12
    assert RE.read_bed(spark, p, min_score=1.0).count() == 1
    assert RE.read_bed(spark, p, region=("chr2", 0, 5)).count() == 1


def test_gtf(spark, put):
    p = put("a.gtf", 'chr1\ts\texon\t11\t20\t.\t+\t.\tgene_id "g"; transcript_id "t";\nchr1\ts\texon\t31\t40\t.\t+\t.\tgene_id "g"; transcript_id "t"; tag "a"; tag "b";\nchr1\ts\tCDS\t15\t35\t.\t+\t.\tgene_id "g"; transcript_id "t";\nbad\n')
    g = RE.read_gff(spark, p)
    assert g.filter(F.size(F.try_element_at("attributes", F.lit("tag"))) == 2).count() == 1
    t = RE.gtf_transcripts(g).first()
    assert (t["start_pos"], t["end_pos"], t["cds_start"], t["cds_end"]) == (10, 40, 14, 35)


def test_wig(spark, put):
    p = put("a.wig", "track type=wiggle_0\nfixedStep chrom=chr1 start=11 step=5 span=2\n1.5\n2\nvariableStep chrom=chr2 span=3\n100 7\n200 8\n")
    assert rows(RE.read_wig(spark, p)) == sorted([("chr1", 10, 12, 1.5), ("chr1", 15, 17, 2.0), ("chr2", 99, 102, 7.0), ("chr2", 199, 202, 8.0)], key=repr)


def test_fasta_and_fastq(spark, put):
    p = put("a.fa", ">s1 first one\nACGT\nAC\n>s2\n\n")
    assert rows(RE.read_fasta(spark, p)) == [("s1", "first one", "ACGTAC"), ("s2", "", "")]
    q = put("a.fq", "@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+r2\n@I\n")
    assert rows(RE.read_fastq(spark, q)) == [("r1", "x", "ACGT", "IIII"), ("r2", "", "GG", "@I")]


def test_sam(spark, put):
    p = put("a.sam", "@HD\tVN:1\nr\t16\tchr1\t11\t60\t5M10N5M\t=\t50\t40\tACGTACGTAC\tIIIIIIIIII\tNH:i:4\tRG:Z:x\nu\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    s = RE.read_sam(spark, p)
    r = s.filter("name = 'r'").first()
    assert (r["start_pos"], r["end_pos"], r["weight"], r["strand"], r["mate_chrom"]) == (10, 30, 0.25, "-", "chr1")
    assert s.filter("name = 'u'").first()["chrom"] is None
    assert RE.read_sam(spark, p, ("chr1", 0, 20)).count() == 1 and RE.read_sam(spark, p, ("chr1", 0, 20), contained=True).count() == 0


def test_maf_and_phylip(spark, put):
    p = put("a.maf", "##maf\na score=5\ns hg.chr1 10 4 + 100 AC-GT\ns mm.chr2 3 5 - 90 ACAGT\n\na score=6\ns hg.chr1 20 2 + 100 AC\n")
    m = RE.read_maf(spark, p)
    assert m.count() == 3 and m.filter("species = 'mm'").first()["text"] == "ACAGT"
    q = put("a.phy", "2 6\na ACG\nb TTT\nTAA\nCCC\n")
    assert rows(RE.read_phylip(spark, q, interleaved=True)) == [("a", "ACGTAA"), ("b", "TTTCCC")]
    s = put("s.phy", "2 6\na ACG\nTAA\nb TTTCCC\n")
    assert rows(RE.read_phylip(spark, s)) == [("a", "ACGTAA"), ("b", "TTTCCC")]


def test_matrix_and_sets(spark, put):
    p = put("a.gct", "#1.2\n2\t2\nName\tDescription\tx\ty\ng1\td\t1.5\t\ng2\t\t3\tna\n")
    assert rows(RE.read_gct(spark, p).select("row", "col", "value")) == [("g1", "x", 1.5), ("g2", "x", 3.0)]
    g = put("a.gmt", "s1\td\ta\tb\ns2\td\tc\n")
    assert RE.read_gmt(spark, g, 2).count() == 2
    x = put("a.gmx", "s1\ts2\nd\te\na\tb\nc\t\n")
    assert rows(RE.read_gmx(spark, x)) == [("s1", "d", "a"), ("s1", "d", "c"), ("s2", "e", "b")]
    c = put("a.cls", "3 2 1\n# u v\nu v u\n")
    assert [r["label"] for r in RE.read_cls(spark, c).orderBy("place").collect()] == ["u", "v", "u"]


def test_psl_sizes_repeats(spark, put):
    line = "90\t10\t0\t0\t0\t0\t0\t0\t+\tq\t100\t0\t100\tchr1\t1000\t10\t120\t2\t50,50,\t0,50,\t10,70,"
    r = RE.read_psl(spark, put("a.psl", "psLayout\n\n" + line + "\n")).first()
    assert r["identity"] == 0.9 and [tuple(b) for b in r["blocks"]] == [(10, 60), (70, 120)]
    assert rows(RE.read_sizes(spark, put("s", "chr1 100\nchr2\tx\n"))) == [("chr1", 100)]
    rm = RE.read_repeats(spark, put("r", "SW perc\n\n 239 29.4 1.9 1.0 chr1 11677 11780 (1) C MER5B DNA 74 104 1\n")).first()
    assert (rm["start_pos"], rm["strand"], rm["repeat"]) == (11676, "-", "MER5B")


def test_stems(spark):
    df = spark.createDataFrame([("((.))()",), ("",), ("))(",)], "s string")
    assert [[tuple(x) for x in r["r"]] for r in df.select(RE.stems(F.col("s")).alias("r")).collect()] == [[(0, 4), (1, 3), (5, 6)], [], []]


def test_write_and_read_bed(spark, tmp_path):
    df = RE.parse_bed(spark.createDataFrame([("chr1\t10\t50\tn\t5\t+\t12\t40\t0,0,0\t2\t5,10\t0,30",)], "value string"))
    WR.write_lines(df.select(WR.bed_line().alias("value")), f"file://{tmp_path}/o")
    back = RE.read_bed(spark, f"file://{tmp_path}/o").first()
    assert back["blocks"] == df.first()["blocks"] and back["score"] == 5.0
