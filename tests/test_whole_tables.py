import textwrap

import __spark_entry__ as entry
from strandloom.plans.matrices import mx
from strandloom.plans.tables import table
from strandloom.sources import readers as RE


def test_wide_matrix_all_has_every_cell(spark, sf):
    want = {(r["row"], r["col"]): r["value"] for r in mx(spark, sf).collect()}
    w = entry.queries()["wide_matrix_all"](spark, sf)
    assert w.columns == ["row", *sorted({c for _, c in want})] and len(w.columns) == 41
    rows = w.collect()
    assert {(r["row"], c): r[c] for r in rows for c in w.columns[1:] if r[c] is not None} == {k: v for k, v in want.items() if v is not None}


def test_fasta_records_all_has_long_reads(spark, sf, tmp_path):
    rows = [(i, "ACGTN" * 25, "x") for i in range(3)] + [(3, "A" * 20, "x"), (4, "A" * 41, "x"), (5, "", "x"), (6, None, "x")]
    spark.createDataFrame(rows, "rec_id long, seq string, other string").write.parquet(str(tmp_path / "reads.parquet"))
    got = {r["rec_id"]: r["value"] for r in entry.queries()["fasta_records_all"](spark, str(tmp_path)).collect()}
    assert got == {i: f">{i}\n" + "\n".join(textwrap.wrap(s, 20)) for i, s, _ in rows if s}
    n = table(spark, sf, "reads").filter("length(seq) > 0").count()
    assert entry.queries()["fasta_records_all"](spark, sf).count() == n


def test_parse_sam_keeps_long_tags(spark):
    long = "x" * 150_000
    line = "\t".join(["r", "0", "c", "1", "9", "4M", "*", "0", "0", "ACGT", "*", f"ZZ:Z:{long}", "NH:i:2"])
    r = RE.parse_sam(spark.createDataFrame([(line,)], "value string")).first()
    assert r["tags"] == {"ZZ": long, "NH": "2"} and r["weight"] == 0.5
