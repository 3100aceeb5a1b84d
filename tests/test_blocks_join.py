import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import blocks as B
from strandloom.operators import join as J
from strandloom.operators import setops as S

EXONS = [(1000000, 1000100), (1001250, 1001350), (1002000, 1002200), (1005000, 1005200)]


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(v for v, _ in cols.values())], ", ".join(f"{k} {t}" for k, (_, t) in cols.items()))
    return df.select(expr.alias("r")).first()["r"]


def as_pairs(r):
    return [tuple(x) for x in r]


def test_transcript_positions(spark):
    x = (EXONS, B.BLOCKS)
    for pos, want in ((1000050, 50), (1001250, 100), (1001249, -1), (1002100, 300)):
        assert one(spark, B.to_transcript(F.col("x"), F.lit("+"), F.lit(pos)), x=x) == want
    assert one(spark, B.to_transcript(F.col("x"), F.lit("-"), F.lit(1005199)), x=x) == 0
    assert one(spark, B.to_genome(F.col("x"), F.lit("-"), F.lit(0)), x=x) == 1005199
    assert one(spark, B.to_genome(F.col("x"), F.lit("+"), F.lit(600)), x=x) is None


def test_block_algebra(spark):
    x = ([(601, 701), (101, 201), (401, 501), (150, 180)], B.BLOCKS)
    m = B.merge(F.col("x"))
    assert as_pairs(one(spark, m, x=x)) == [(101, 201), (401, 501), (601, 701)]
    assert one(spark, B.length(m), x=x) == 300 and one(spark, B.span(m), x=x) == 600
    assert one(spark, B.to_genome(m, F.lit("+"), F.lit(200)), x=x) == 601
    assert one(spark, B.to_transcript(m, F.lit("+"), F.lit(401)), x=x) == 100
    y = ([(0, 150), (450, 650)], B.BLOCKS)
    assert as_pairs(one(spark, B.intersect(m, F.col("y")), x=x, y=y)) == [(101, 150), (450, 501), (601, 650)]
    assert as_pairs(one(spark, B.subtract(m, F.col("y")), x=x, y=y)) == [(150, 201), (401, 450), (650, 701)]
    assert one(spark, B.overlap_bases(m, F.col("y")), x=x, y=y) == 49 + 51 + 49


def test_block_nulls_and_empties(spark):
    assert one(spark, B.merge(F.col("x")), x=(None, B.BLOCKS)) is None
    assert one(spark, B.merge(F.col("x")), x=([], B.BLOCKS)) == []
    assert one(spark, B.length(F.col("x")), x=([], B.BLOCKS)) == 0
    assert one(spark, B.subtract(F.col("x"), F.col("y")), x=([(1, 5)], B.BLOCKS), y=([], B.BLOCKS)) == [(1, 5)]


@pytest.mark.parametrize("cigar,want", [("36M", [(10, 46)]), ("5S9M10N2D3M", [(10, 19), (29, 34)]), ("3M2I4M", [(10, 17)]), ("bad", None), (None, None)])
def test_cigar(spark, cigar, want):
    r = one(spark, B.cigar_blocks(F.col("c"), F.lit(10)), c=(cigar, "string"))
    assert (r if r is None else as_pairs(r)) == want


def test_almost_equal_is_strict(spark):
    x, y = ([(0, 10)], B.BLOCKS), ([(3, 10)], B.BLOCKS)
    assert one(spark, B.almost_equal(F.col("x"), F.col("y"), 4), x=x, y=y) is True
    assert one(spark, B.almost_equal(F.col("x"), F.col("y"), 3), x=x, y=y) is False


SCHEMA = "id long, chrom string, start_pos long, end_pos long, strand string"


def made(rnd, n):
    out = []
    for i in range(n):
        a = rnd.randrange(0, 200_000)
        out.append((i, rnd.choice(["a", "b", None]), rnd.choice([a] * 20 + [None]), a + rnd.choice([1, 5, 50, 900, 1024, 1025, 20_000, 100_000, 0, -3]), rnd.choice(["+", "-", None])))
    return out


def ok(x):
    return x[1] and x[2] is not None and x[3] > x[2]


@pytest.fixture(scope="module")
def ab():
    rnd = random.Random(3)
    return made(rnd, 120), made(rnd, 120)


def test_overlap_join_matches_brute_force(spark, ab):
    A, Bb = ab
    a, b = spark.createDataFrame(A, SCHEMA), spark.createDataFrame(Bb, SCHEMA)
    want = sorted((x[0], y[0]) for x in A for y in Bb if ok(x) and ok(y) and x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert sorted(map(tuple, J.overlap_join(a, b).select("id", "id_r").collect())) == want
    hit = {x for x, _ in want}
    assert {r["id"] for r in J.overlap_join(a, b, "left_semi").collect()} == hit
    assert {r["id"] for r in J.overlap_join(a, b, "left_anti").collect()} == {x[0] for x in A} - hit
    assert J.overlap_join(a, b, "left").count() == len(want) + len(A) - len(hit)
    near = sorted((x[0], y[0]) for x in A for y in Bb if ok(x) and ok(y) and x[1] == y[1] and x[4] and x[4] == y[4] and x[2] < y[3] + 100 and y[2] - 100 < x[3])
    assert sorted(map(tuple, J.overlap_join(a, b, slack=100, strand=True).select("id", "id_r").collect())) == near


def test_overlap_join_empty(spark, ab):
    a, none = spark.createDataFrame(ab[0], SCHEMA), spark.createDataFrame([], SCHEMA)
    assert J.overlap_join(a, none).count() == 0 and J.overlap_join(none, a).count() == 0
    assert J.overlap_join(a, none, "left_anti").count() == len(ab[0])


def test_touching_ends_do_not_overlap(spark):
    t = [(i, "c", s, e, "+") for i, (s, e) in enumerate([(0, 10), (10, 20), (20, 30)])]
    q = spark.createDataFrame([(9, "c", 10, 20, "+")], SCHEMA)
    assert [r["id_r"] for r in J.overlap_join(q, spark.createDataFrame(t, SCHEMA)).collect()] == [1]


def test_nearest_matches_brute_force(spark, ab):
    A, Bb = ab
    Bb = [y for y in Bb if ok(y) and y[3] - y[2] < 60]

    def near(x):
        ys = [y for y in Bb if y[1] == x[1]]
        over = [y for y in ys if y[2] < x[3] and x[2] < y[3]]
        if over:
            return (x[0], min(over, key=lambda y: (y[2], y[3], y[0]))[0], 0)
        p = min((y for y in ys if y[3] <= x[2]), key=lambda y: (-y[3], y[0]), default=None)
        n = min((y for y in ys if y[2] >= x[3]), key=lambda y: (y[2], y[0]), default=None)
        if p and (not n or x[2] - p[3] <= n[2] - x[3]):
            return (x[0], p[0], x[2] - p[3])
        return n and (x[0], n[0], n[2] - x[3])

    got = sorted(map(tuple, J.nearest(spark.createDataFrame(A, SCHEMA), spark.createDataFrame(Bb, SCHEMA), "id", "id").collect()))
    assert got == sorted(v for v in (near(x) for x in A if ok(x)) if v)


def test_subtract_and_complement_cover_the_rest(spark, ab):
    A, Bb = ab
    a = [x for x in A if ok(x) and x[3] - x[2] < 2000]
    got = S.subtract(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(Bb, SCHEMA), "id").collect()
    want = 0
    for x in a:
        left = set(range(x[2], x[3]))
        for y in Bb:
            if ok(y) and y[1] == x[1]:
                left -= set(range(max(x[2], y[2]), min(x[3], y[3])))
        want += len(left)
    assert sum(r["end_pos"] - r["start_pos"] for r in got) == want
    sizes = spark.createDataFrame([("a", 400_000), ("c", 10)], "chrom string, length long")
    df = spark.createDataFrame(A, SCHEMA)
    gap = sum(r["end_pos"] - r["start_pos"] for r in S.complement(df, sizes).collect())
    full = S.base_coverage(df.filter("chrom = 'a'")).first()["bases"]
    assert gap == 400_000 - full + 10
