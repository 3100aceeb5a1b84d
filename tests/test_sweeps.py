"""Sweep forms of joins, windows and readers against brute force, with nulls, ties, repeats and hot keys."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.operators import balance, join
from strandloom.operators import windows as W
from strandloom.sources import readers as R


def made(n, seed, span=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = rnd.randrange(span)
        rows.append((i, rnd.choice(["a", "a", "a", "b", None]), s, rnd.choice([s, s + 1, s + rnd.randrange(1, 30), s - 2, None]), rnd.choice(["+", "-", None])))
    return rows


SCHEMA = "id long, chrom string, start_pos long, end_pos long, strand string"


def ok(r):
    return r[1] is not None and r[3] is not None and r[3] > r[2]


@pytest.mark.parametrize("strand,slack", [(False, 0), (True, 0), (False, 3), (True, 5)])
def test_semi_and_anti_joins(spark, strand, slack):
    a, b = made(150, 1), made(40, 2)
    a += a[:9]  # repeated rows keep their multiplicity
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA).withColumn("_v", F.lit(1)).withColumn("_chrom", F.lit("x"))

    def touches(x):
        return ok(x) and any(ok(y) and x[1] == y[1] and x[2] < y[3] + slack and y[2] - slack < x[3] and (not strand or (x[4] is not None and x[4] == y[4])) for y in b)

    for how, wanted in (("left_semi", True), ("left_anti", False)):
        got = join.overlap_join(left, right, how, strand=strand, slack=slack)
        assert got.columns == left.columns
        assert Counter(map(tuple, got.collect())) == Counter(x for x in a if touches(x) == wanted), how
        assert join.overlap_join(left, right.limit(0), how).count() == (0 if wanted else len(a))
        assert join.overlap_join(left.limit(0), right, how).count() == 0


def test_nearest_matches_brute_force(spark):
    a, b = [r for r in made(200, 3, 900)], made(60, 4, 900)
    b += [(900 + i, *r[1:]) for i, r in enumerate(b[:20])]
    got = {r["id"]: (r["rid"], r["distance"]) for r in join.nearest(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA).withColumnRenamed("id", "rid"), "id", "rid").collect()}
    want = {}
    for x in filter(ok, a):
        c = [y for y in b if ok(y) and y[1] == x[1]]
        over = sorted((y[2], y[3], y[0]) for y in c if y[2] < x[3] and x[2] < y[3])
        prev = min(((x[2] - y[3], y[0]) for y in c if y[3] <= x[2]), default=None)
        nxt = min(((y[2] - x[3], y[0]) for y in c if y[2] >= x[3]), default=None)
        if over:
            want[x[0]] = (over[0][2], 0)
        elif prev and (nxt is None or prev[0] <= nxt[0]):
            want[x[0]] = (prev[1], prev[0])
        elif nxt:
            want[x[0]] = (nxt[1], nxt[0])
    assert got == want and len({d for _, d in want.values()}) > 5


def test_masked_windows_match_brute_force(spark):
    sizes = {"a": 230, "b": 40, "c": 12, "d": 100}
    masks = [("a", 10, 30), ("a", 25, 60), ("a", 100, 101), ("b", 0, 40), ("d", 0, 1), ("a", 229, 230), (None, 1, 2)]
    sdf = spark.createDataFrame(list(sizes.items()), "chrom string, length long")
    mdf = spark.createDataFrame(masks, "chrom string, start_pos long, end_pos long")
    got = {(r["chrom"], r["window"]): [(b[0], b[1]) for b in r["blocks"]] for r in W.masked_windows(sdf, mdf, 20, 5).collect()}
    want = {}
    for c, n in sizes.items():
        free = [p for p in range(n) if not any(k == c and s <= p < e for k, s, e in masks)]
        for w in range(0, len(free) - 19, 15):
            bl = []
            for p in free[w : w + 20]:
                if bl and bl[-1][1] == p:
                    bl[-1][1] = p + 1
                else:
                    bl.append([p, p + 1])
            want[c, w] = [tuple(x) for x in bl]
    assert got == want


def test_rolling_environment_matches_brute_force(spark):
    rows = [(r[1], r[2], r[3], float(r[0] % 7), r[0]) for r in made(120, 6)] + [("a", 5, 9, None, 500), ("a", None, 9, 1.0, 501)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long, v double, tag long")
    got = Counter((r["tag"], round(r["env"], 6)) for r in W.rolling_environment(df, "v", 20).collect())
    want = Counter()
    for c, s, _, _, t in rows:
        if c is not None and s is not None:
            f, e = max(0, s - 20), s + 20
            want[t, round(sum(v * max(0, min(e, b) - max(f, a)) for k, a, b, v, _ in rows if k == c and a is not None and b is not None and b > a and v is not None), 6)] += 1
    assert got == want


def test_fastq_by_line_numbers(spark, tmp_path):
    rnd = random.Random(7)
    files, want = {}, []
    for f in ("x.fq", "y.fq"):
        text = ""
        for i in range(300):
            bases = "".join(rnd.choice("ACGT") for _ in range(rnd.randrange(1, 40)))
            qual = rnd.choice("@+!I") + "".join(chr(rnd.randrange(33, 74)) for _ in bases[1:])
            want.append((f"{f}{i}", "some text" if i % 3 else "", bases, qual))
            text += f"@{f}{i}{' some text' if i % 3 else ''}\n{bases}\n+{'again' if i % 5 else ''}\n{qual}\n"
        files[f] = text
    files["y.fq"] += "@cut\nACGT\n+\n"
    files["x.fq"] = files["x.fq"].replace("\n", "\r\n")
    for f, t in files.items():
        (tmp_path / f).write_bytes(t.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")  # many blocks a file
    try:
        got = sorted(map(tuple, R.read_fastq(spark, str(tmp_path)).collect()))
        assert R.read_fastq(spark, str(tmp_path)).rdd.getNumPartitions() >= 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(want)
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "empty.fq").write_text("")
    assert R.read_fastq(spark, str(tmp_path / "e")).count() == 0


def test_sam_tags_keep_all_their_text(spark):
    long = "x" * 150_000
    line = "\t".join(["r", "0", "chr1", "5", "9", "4M", "*", "0", "0", "ACGT", "IIII", f"XX:Z:{long}", "NH:i:2", "NH:i:9"])
    r = R.parse_sam(spark.createDataFrame([(line,)], "value string")).first()
    assert r["tags"] == {"XX": long, "NH": "2"} and r["weight"] == 0.5


def test_balanced_sums_at_thousands_of_tasks(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("k"), F.lit(1.0).alias("w"), "id")
    plan = balance.plan_load(df, ["k"], tasks=5000)
    assert len(plan.bucket_task) == 80_000
    hot = [t for t in plan.heavy.values() if len(t) > 1000]
    assert len(hot) == 1 and len(set(hot[0])) == len(hot[0])
    small = balance.plan_load(df, ["k"], tasks=7)
    got = {r["k"]: (r["n"], r["w"]) for r in balance.balanced_sums(df, ["k"], {"w": F.col("w")}, small).collect()}
    assert got == {r["k"]: (r["n"], r["w"]) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()}


def test_shards_depend_on_the_row_alone(spark):
    df = spark.createDataFrame([(i, {"a": "b"}, [1, None]) for i in range(50)], "id long, m map<string,string>, l array<int>")
    a = {r["id"]: r["h"] for r in df.select("id", balance.row_hash(df).alias("h")).collect()}
    b = {r["id"]: r["h"] for r in df.repartition(7).select("id", balance.row_hash(df).alias("h")).collect()}
    assert a == b and len(set(a.values())) == 50


