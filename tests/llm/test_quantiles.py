import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import quantiles as Q


@pytest.fixture(scope="module")
def values(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None]), rnd.choice([5.0, 5.0, rnd.lognormvariate(3, 2), None]), "x") for _ in range(3000)]
    return rows, spark.createDataFrame(rows, "g string, v double, pid string").repartition(7)


def test_exact_percentiles_match_numpy(values):
    rows, df = values
    probs = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    got = {(r["g"], r["prob"]): (r["n"], r["percentile"]) for r in Q.exact_percentiles(df, "g", "v", probs).collect()}
    for g in ("hot", "a", "b"):
        v = [x for k, x, _ in rows if k == g and x is not None]
        for p in probs:
            assert got[g, p][0] == len(v)
            assert got[g, p][1] == pytest.approx(np.percentile(v, p * 100), rel=1e-12)
    assert len(got) == 3 * len(probs)


def test_one_value_and_empty(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", None)], "g string, v double")
    assert [(r["g"], r["percentile"]) for r in Q.exact_percentiles(df, "g", "v", [0.5]).collect()] == [("a", 3.0)]
    assert Q.exact_percentiles(df.limit(0), "g", "v", [0.5]).count() == 0


def test_valid_values_once(spark):
    rows = [("r", "c", 2.0, 3), ("r", "c", 2.0, 1), ("r", "c", None, 0), ("s", "c", float("nan"), 1), ("s", "c", float("inf"), 1), ("t", "c", -1.0, 1), ("t", None, 4.0, 1), (None, "c", 4.0, 1)]
    df = spark.createDataFrame(rows, "row string, col string, value double, day int")
    got = sorted(map(tuple, Q.valid_values(df, "col", "value", ["row", "col"], ["day"]).collect()), key=repr)
    assert got == sorted([("r", "c", 1, 2.0), (None, "c", 1, 4.0)], key=repr)


def test_summaries_of_parts_within_bound(values):
    rows, df = values
    alpha = 0.01
    parts = df.withColumn("day", F.pmod(F.hash("v", F.rand(3)), F.lit(4)))
    s = Q.summaries(parts, ["g", "day"], "v", alpha).filter("g is not null")
    got = {(r["g"], r["prob"]): r["percentile"] for r in Q.summary_percentiles(s, "g", [0.1, 0.5, 0.9], alpha).collect()}
    for g in ("hot", "a", "b"):
        v = sorted(x for k, x, _ in rows if k == g and x is not None and x > 0)
        for p in (0.1, 0.5, 0.9):
            want = v[math.floor(p * (len(v) - 1))]
            assert abs(got[g, p] - want) <= alpha * want * (1 + 1e-9)
