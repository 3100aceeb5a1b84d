import random
from collections import Counter

from pyspark.sql import functions as F

from strandloom.operators import balance, periods


def test_balanced_sums_with_hot_and_null_keys(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.5 else None if rnd.random() < 0.1 else f"k{rnd.randrange(50)}", rnd.choice([None, 1.0, 2.5]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, w double, _n long").repartition(6)
    plan = balance.plan_load(df, ["k"], tasks=5)
    assert any(len(t) > 1 for t in plan.heavy.values())
    got = {r["k"]: (r["n"], r["w"]) for r in balance.balanced_sums(df, ["k"], {"w": F.col("w")}, plan).collect()}
    n = Counter(k for k, _, _ in rows)
    w = Counter()
    for k, x, _ in rows:
        w[k] += x or 0
    assert {k: (v, w[k]) for k, v in n.items()} == got


def test_balanced_sums_empty(spark):
    df = spark.createDataFrame([], "k string, w double")
    assert balance.balanced_sums(df, ["k"], {"w": F.col("w")}).count() == 0


def test_balanced_join_kinds(spark):
    left = spark.createDataFrame([("a", i) for i in range(200)] + [("b", 1), (None, 2), ("c", 3)], "k string, v long")
    right = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), (None, 7)], "k string, v long")
    plan = balance.plan_load(left, ["k"], tasks=4)
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = balance.balanced_join(left, right, ["k"], how, plan)
        want = left.join(right.withColumnRenamed("v", "v_right"), "k", how)
        assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect())), how


def brute_periods(rows):
    out = []
    for c in {r[0] for r in rows if r[0] is not None}:
        iv = sorted((s, e) for k, s, e in rows if k == c and s is not None and e is not None and e > s)
        per = []
        for s, e in iv:
            if per and s <= per[-1][1]:
                per[-1][1] = max(per[-1][1], e)
            else:
                per.append([s, e])
        out += [("period", c, s, e) for s, e in per] + [("gap", c, a[1], b[0]) for a, b in zip(per, per[1:])]
    return sorted(out)


def test_periods_random(spark):
    rnd = random.Random(2)
    rows = []
    for _ in range(800):
        s = rnd.randrange(3000)
        rows.append((rnd.choice(["a", "a", "b", None]), rnd.choice([s, s, s, None]) if rnd.random() < 0.1 else s, s + rnd.randrange(-2, 12)))
    df = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long")
    got = sorted(map(tuple, periods.periods_and_gaps(df, "chrom").collect()))
    assert got == brute_periods(rows)


def test_periods_empty_and_touching(spark):
    schema = "chrom string, start_pos long, end_pos long, key string, pos long"
    assert periods.periods_and_gaps(spark.createDataFrame([], schema), "chrom").count() == 0
    df = spark.createDataFrame([("a", 0, 5, "x", 1), ("a", 5, 9, "x", 1), ("a", 5, 9, "x", 1), ("a", 9, 9, "x", 1)], schema)
    assert [tuple(r) for r in periods.periods_and_gaps(df, "chrom").collect()] == [("period", "a", 0, 9)]
